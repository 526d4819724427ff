"""cairn: a PySpark-native analytics library for content-addressed artifact caches."""
