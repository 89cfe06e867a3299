"""Retail location analytics as Spark DataFrame operators."""
