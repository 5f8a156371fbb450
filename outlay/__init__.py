"""Spend analytics as Spark DataFrame plans."""
