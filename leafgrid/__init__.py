"""Document layout analytics on Spark: boxes, labels, merged regions and rebuilt text as DataFrames."""

__version__ = "0.1.0"
