"""A PySpark-native analytics engine for localisation corpora."""
