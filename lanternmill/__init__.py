"""lanternmill: a Spark-native engine for searching and enriching document archives."""
