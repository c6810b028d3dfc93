"""Document-structure analytics on Spark: layout, markup, quality metrics and packaging as DataFrames."""

__version__ = "0.1.0"
