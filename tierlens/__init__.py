"""Aspect-sentiment analytics over product reviews, as PySpark DataFrame operators."""
