"""kinweave: a Spark-native entity-resolution analytics engine."""
