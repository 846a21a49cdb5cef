"""A Spark-native federated query engine."""
