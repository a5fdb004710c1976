"""Capacity demand analytics as Spark jobs over a daily usage fact table."""
