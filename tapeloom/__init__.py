"""tapeloom: market time series as Spark DataFrames.

Features, targets, splits, point-in-time joins, metrics, portfolios, decision
rules and streams.  Every operator is a plain function from DataFrame to
DataFrame (or Column to Column); the ticker is a partition key, never a loop.
"""

__version__ = "0.1.0"
