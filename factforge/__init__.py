"""Spark jobs over engineering-drawing review data."""
