"""Brightfield: directory analytics on PySpark."""
