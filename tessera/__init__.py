"""tessera: a Spark-native engine for text evidence: ingest, score, relate, retrieve and evaluate."""

__version__ = "0.1.0"
