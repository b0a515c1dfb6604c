"""Missing values: a layer may hold NULL, NaN and infinities, and none of them is a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column | str) -> Column:
    """``x`` where it is a finite number, else NULL."""
    x = F.col(x) if isinstance(x, str) else x
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
