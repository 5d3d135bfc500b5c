"""Spark-native analytics over catalogues of machine-checkable claims."""
