"""Spark-first building, selection and monitoring of temporal tabular features."""
