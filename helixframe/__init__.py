"""Spark-native analytics over keyed intervals, sparse activations and annotated sequences."""
