"""Spark-native retrieval and analytics over page-structured document corpora."""
