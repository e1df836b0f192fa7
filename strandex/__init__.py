"""strandex: Spark-native analytics over entities, relations and text."""
