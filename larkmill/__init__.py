"""larkmill: a Spark-native engine for semantic-id recommendation analytics."""
