"""Document analytics on PySpark: ingestion, retrieval, scoring and answer evaluation."""

__version__ = "0.1.0"
