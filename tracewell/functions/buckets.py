"""Bucket expressions of the histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_bucket(x: Column, base: float = 1.5) -> Column:
    """floor(log_base(x)), 0 below base."""
    return F.greatest(F.floor(F.log(F.greatest(x, F.lit(1)).cast("double")) / F.lit(math.log(base))), F.lit(0)).cast("long")


def step_bucket(x: Column, step: int) -> Column:
    """floor(x / step) for x >= 0, and -1 for what has no value (a cold access)."""
    return F.when(x.isNull() | (x < 0), F.lit(-1)).otherwise(F.floor(x / step)).cast("long")
