"""A Spark-native engine for context-dependent mutation data and training corpora."""
