"""Cohort and survey analytics as plain PySpark DataFrame transformations."""

from cohortloom.sources.warehouse import Warehouse

__all__ = ["Warehouse"]
