"""Spreadsheet-style formula columns, lookups and aggregates compiled to Spark."""
