"""PySpark-native analytics over captured web observations."""
