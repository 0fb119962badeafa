"""Column expressions over dense vectors stored as ``array<double>``.

All of them are built-in higher-order functions, so they run inside the JVM
per row with no Python round trip and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import col_or_name


def as_double_array(c) -> Column:
    """``array<float>`` -> ``array<double>`` before any arithmetic."""
    return col_or_name(c).cast("array<double>")


def squared_l2(a, b) -> Column:
    """Sum of squared element differences (NULL when widths differ)."""
    a, b = col_or_name(a), col_or_name(b)
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
        F.lit(0.0).cast("double"),
        lambda acc, z: acc + z,
    )


def l2_distance(a, b) -> Column:
    """Euclidean distance ``||a - b||``."""
    return F.sqrt(squared_l2(a, b))


def keep_last(c, m: int) -> Column:
    """Last ``m`` elements of a vector (P10: drop leading keypoint columns)."""
    return F.slice(col_or_name(c), -m, m)


def vector_literal(values) -> Column:
    """A driver-side vector of bounded width as a constant ``array<double>``."""
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def dense(column, width: int):
    """Arrow list column (no nulls) as a numpy matrix, straight from its value
    buffer; rows of another length are an error."""
    import numpy as np
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), width)
