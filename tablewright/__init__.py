"""tablewright: a Spark-native data-quality and analytics engine."""

__version__ = "0.1.0"
