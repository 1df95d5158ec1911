"""Spark-native analytics for stacks of two-dimensional measurements and the volumes behind them."""

__version__ = "0.1.0"
