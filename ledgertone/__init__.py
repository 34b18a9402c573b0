"""Catalog quality, measurement curves and training text on Spark."""
