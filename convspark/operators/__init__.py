"""DataFrame -> DataFrame operators (joins, aggregations, windows, splits)."""
