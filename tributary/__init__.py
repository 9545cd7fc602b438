"""tributary: Spark-native analytics for measuring, routing and triaging classifiers."""
