"""groundmill: Spark-native preparation and evaluation of retrieval-grounded question answering data."""
