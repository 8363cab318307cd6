"""quarrymill: Spark-native operators for building and querying a retrieval corpus."""
