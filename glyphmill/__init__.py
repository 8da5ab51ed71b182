"""Spark-native extraction, quality-gating, geometry and corpus analytics."""
