"""Automatic analytics on tables, as PySpark DataFrame operators."""
