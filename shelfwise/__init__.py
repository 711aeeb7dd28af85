"""Shelfwise: product-recommendation analytics as Spark DataFrame jobs."""
