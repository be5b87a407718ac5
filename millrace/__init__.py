"""millrace: a strictly typed relational layer on Spark DataFrames and Spark SQL."""

__version__ = "0.1.0"
