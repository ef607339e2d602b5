"""trendframe: trend analytics over catalogue and discussion feeds on Spark.

Every operator is a function from DataFrames (and parameters) to a
DataFrame, built from Spark's own expressions, joins, windows and
Structured Streaming. See ``README.md`` for the map of operators.
"""

__version__ = "0.1.0"
