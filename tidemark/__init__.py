"""A Spark-native engine for archived web records."""
