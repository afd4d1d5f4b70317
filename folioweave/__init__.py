"""folioweave: Spark-native preparation of long documents for reading, narration and training."""
