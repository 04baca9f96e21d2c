"""Spark-native disaggregation of household mains power, and operators over sample tables."""
