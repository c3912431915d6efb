"""trackloom: Spark-native analytics over observations from many sources."""
