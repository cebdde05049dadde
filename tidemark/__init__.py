"""A PySpark-native engine for decomposable time-series forecasting."""

__version__ = "0.1.0"
