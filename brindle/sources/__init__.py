"""Reading tables and files, and writing results."""

from .sinks import json_rows, string_rows, text_table, write_table
from .tables import TABLES, TableId, batches, load, read_csv, read_parquet, register, scan

__all__ = ["TABLES", "TableId", "batches", "json_rows", "load", "read_csv", "read_parquet", "register", "scan", "string_rows", "text_table", "write_table"]
