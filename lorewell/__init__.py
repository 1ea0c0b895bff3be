"""A Spark-native engine for knowledge corpora and training text."""
