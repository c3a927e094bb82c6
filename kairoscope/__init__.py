"""Time-aware memory retrieval and data processing on PySpark."""
