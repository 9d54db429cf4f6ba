"""PySpark-native analytics over archives of service observations."""
