"""Spark-native auditing and evaluation of labelled, grouped data."""
