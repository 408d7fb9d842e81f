"""Pairs of neighbours inside groups by grid cell: an equi-join on (keys, cell) instead of a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box_pairs(left: DataFrame, right: DataFrame, keys: list[str], cell: float, test: Column) -> DataFrame:
    """Pairs of boxes that share a cell and pass the test, as structs `a` and `b`, each pair once: in the cell that holds
    the lower corner of what the two have in common. Any cell size gives the same pairs."""

    def tiled(df: DataFrame, name: str) -> DataFrame:
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
        return df.select(*keys, span("x_min", "x_max").alias("_cx"), F.struct(*df.columns).alias(name)).select(*keys, "_cx", F.explode(F.sequence(F.floor(F.col(f"{name}.y_min") / cell), F.floor(F.col(f"{name}.y_max") / cell))).alias("_cy"), name)

    joined = tiled(left, "a").join(tiled(right, "b"), [*keys, "_cx", "_cy"])
    owner = (F.col("_cx") == F.floor(F.greatest("a.x_min", "b.x_min") / cell)) & (F.col("_cy") == F.floor(F.greatest("a.y_min", "b.y_min") / cell))
    return joined.where(owner & test).select(*keys, "a", "b")


def point_pairs(left: DataFrame, right: DataFrame, keys: list[str], radius: float, test: Column, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Pairs of points at most `radius` apart along each axis that pass the test, as structs `a` and `b`."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = lambda c: F.explode(F.array(*[cell(c) + k for k in (-1, 0, 1)]))
    a = left.select(*keys, cell(x).alias("_cx"), cell(y).alias("_cy"), F.struct(*left.columns).alias("a"))
    b = right.select(*keys, near(x).alias("_cx"), F.struct(*right.columns).alias("b"), cell(y).alias("_y0")).select(*keys, "_cx", F.explode(F.array(*[F.col("_y0") + k for k in (-1, 0, 1)])).alias("_cy"), "b")
    return a.join(b, [*keys, "_cx", "_cy"]).where(test).select(*keys, "a", "b")
