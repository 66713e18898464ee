"""grovemark: scoring and querying structured records, and preparing corpora, on Spark."""

__version__ = "0.1.0"
