"""A PySpark-native analytics engine for database program code and text corpora."""
