"""Ventara: commercial sales analytics as lazy PySpark DataFrame operators."""
