"""webgleaner: Spark-native operators over tables of raw web data."""
