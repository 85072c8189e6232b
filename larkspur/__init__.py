"""larkspur: a relational analytics layer built on Spark DataFrames and Spark SQL."""

__version__ = "0.1.0"
