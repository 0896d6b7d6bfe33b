"""Inventory analytics on Spark: load, join, measure, report and export."""

from shelfwise.params import Params
from shelfwise.star import Star

__all__ = ["Params", "Star"]
