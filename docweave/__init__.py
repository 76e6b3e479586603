"""docweave: Spark-native document linkage and graph analytics."""
