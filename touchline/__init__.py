"""Spark-native analytics over per-frame detection tables."""
