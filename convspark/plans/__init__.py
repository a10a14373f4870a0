"""Registered queries: each composes operators over the driver tables and has
an equivalent DuckDB SQL oracle (where the operator is SQL-expressible)."""
