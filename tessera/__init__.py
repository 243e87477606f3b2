"""tessera: a PySpark-native analytics library of DataFrame-to-DataFrame operators."""
