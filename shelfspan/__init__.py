"""Capacity analytics as Spark DataFrame plans.

How full is every storage location, branch, area and the whole network?  Physical
capacity, planned (reallocation) capacity and actual stock are conformed into a
small star schema and rolled up, checked, filtered and ranked with Spark only.
"""

from shelfspan.config import FilterSpec, ModelConfig

__all__ = ["FilterSpec", "ModelConfig"]
