"""keystride: Spark-native operators for irregular, keyed time series."""

__version__ = "0.1.0"
