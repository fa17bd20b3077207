"""Retail decision analytics as plain Spark DataFrame operators."""
