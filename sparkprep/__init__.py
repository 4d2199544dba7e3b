"""A PySpark-native engine for exploring, profiling, validating and converting semi-structured tables."""

__version__ = "0.1.0"
