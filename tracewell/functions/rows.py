"""Explode an array of structs into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_structs(frame: DataFrame, keep: Sequence[str], array: Column | str,
                    ordinal: str | None = None) -> DataFrame:
    """One row per element with its fields as columns, and its 1-based position if named.

    The outer form is used on purpose: for the inner one the optimizer adds a filter on the size of
    the array below the generator, which computes a long array expression twice.
    """
    rows = frame.select(*keep, F.posexplode_outer(array).alias("_o", "_r")) \
        .where(F.col("_o").isNotNull())
    position = [] if ordinal is None else [(F.col("_o") + 1).alias(ordinal)]
    return rows.select(*keep, *position, "_r.*")
