"""Operators for preparing training data: each one is a Spark job over whole tables."""
