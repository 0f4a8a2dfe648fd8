"""tidelog: a PySpark-native engine for querying and preparing log data."""

__version__ = "0.1.0"
