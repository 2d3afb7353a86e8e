"""Readers and writers: the test tables, delimited files, native storage and table copies."""

from tessera.sources.files import copy_table, load_csv, open_tables, read_native, store_native, write_csv

__all__ = ["copy_table", "load_csv", "open_tables", "read_native", "store_native", "write_csv"]
