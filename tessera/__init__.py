"""tessera: a Spark-native search, indexing and text-analytics engine."""
