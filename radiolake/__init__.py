"""Radiolake: Spark-native analytics over short-range radio telemetry."""
