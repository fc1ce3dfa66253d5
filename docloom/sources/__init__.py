"""Readers: Parquet tables, page texts, HTML links and the class dictionary."""
