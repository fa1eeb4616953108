"""A document-recognition and batch-processing engine on Spark DataFrames."""

__version__ = "0.1.0"
