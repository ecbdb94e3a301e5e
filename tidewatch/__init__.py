"""A Spark-native engine for source sentiment, prices and signals."""
