"""waymark: a Spark-native engine for catalogs of named points in space."""
