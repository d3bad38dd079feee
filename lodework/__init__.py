"""lodework: Spark-native analytics over packed archives."""
