"""Spark-native analytics for reads in which methylated cytosines are sequenced as thymines."""
