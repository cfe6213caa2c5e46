"""Meter analytics as Spark DataFrame operators."""
