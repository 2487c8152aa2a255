"""Spark-native analysis of long multi-channel recordings and behaviour."""
