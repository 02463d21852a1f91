"""almanax: a PySpark-native engine for satellite-navigation data and text corpora."""
