"""Retail price and basket analytics as lazy Spark DataFrame transformations."""
