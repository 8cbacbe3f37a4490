"""Governed lakehouse analytics written with the PySpark DataFrame API."""
