"""Sinks: DDL, order of loading, SQLite."""
