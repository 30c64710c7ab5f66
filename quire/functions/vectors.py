"""Column builders for vectors: squared L2, argmax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squared_l2(a, b) -> Column:
    """Exact squared L2 distance, accumulated left to right in double."""
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) *
                   (x.cast("double") - y.cast("double"))),
        F.lit(0.0).cast("double"), lambda acc, d: acc + d)


def argmax(v) -> Column:
    """0-based index of the first maximum (NumPy ``argmax``); null for empty."""
    c = _col(v)
    return F.when(F.size(c) > 0, F.array_position(c, F.array_max(c)) - 1)
