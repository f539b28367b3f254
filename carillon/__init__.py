"""Spark-native analytics of struck-instrument recordings and other sampled signals."""

VERSION = "0.2.0"
