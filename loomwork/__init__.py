"""Loomwork: single-table analytics on Spark."""
