"""Spark-native engine for auditing and curating collections of model-generated records."""
