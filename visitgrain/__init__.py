"""Patient-visit analytics on Spark: plain functions from DataFrame to DataFrame."""

__version__ = "0.1.0"
