"""Tessera: a PySpark-native engine for prompt corpora, activation tables and training-data preparation."""
