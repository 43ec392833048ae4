"""Adloom: ingestion, field extraction and data quality for advertisement tables on Spark."""

__version__ = "0.1.0"
