"""Churn, conversion and lifetime-value models on pyspark.ml."""
