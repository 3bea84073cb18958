"""tabspark: a PySpark-native engine for tabular text data."""

__version__ = "0.1.0"
