"""kinweave: a Spark-first engine for multi-source record linkage."""

__version__ = "0.1.0"
