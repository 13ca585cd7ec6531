"""factloom: Spark-native comparison of facts extracted from multi-stage document sets."""
