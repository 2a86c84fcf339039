"""Inventory reconciliation on Spark: operators over tables with one row for each file or object."""
