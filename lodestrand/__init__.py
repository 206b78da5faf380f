"""Spark-native search, guarding, evaluation and ledger analytics over document collections."""

__version__ = "0.1.0"
