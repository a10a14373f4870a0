"""Scans: the driver's parquet tables and the corpus file formats."""
