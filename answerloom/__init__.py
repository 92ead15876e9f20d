"""Spark-native building and evaluation of short-answer grading data."""
