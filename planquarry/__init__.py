"""planquarry: a Spark-native library for drawing annotations, their evaluation, and training-data tables."""
