"""promptloom: batch text and prompt pipelines on Spark DataFrames."""

__version__ = "0.1.0"
