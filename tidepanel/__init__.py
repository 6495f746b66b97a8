"""Cross-sectional panel analytics and portfolio backtests as Spark plans.

Data are long: one row per ordinal ``t``, ``date`` and ``ticker``. Operators are functions from DataFrames to
DataFrames; they stay lazy, and windows run by ticker (over time) or by ``t`` (across tickers).
"""
