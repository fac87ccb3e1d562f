"""Panel and time-series analytics on Spark DataFrames, with an optional training-data subpackage."""
