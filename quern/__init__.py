"""quern: a Spark-native engine for records, text, vectors, graphs and time series."""

from .session import session

__all__ = ["session"]
