"""Groups given as lengths of consecutive rows: which rows belong to which (IO8, J19)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions per block of the interval join.
BLOCK = 1024


def offsets(groups: DataFrame, by: Sequence[str], order: str, length: str) -> DataFrame:
    """groups with first and end: the half-open range of positions of each, in ascending order within `by`.

    The window holds the lengths of one file's groups, not their rows. Lengths of null count as 0.
    """
    n = F.coalesce(F.col(length), F.lit(0))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(n).over(w)
    return groups.withColumn("end", end).withColumn("first", F.col("end") - n)


def paint(rows: DataFrame, position: str, ranges: DataFrame, by: Sequence[str], value: str, none: int = -1) -> DataFrame:
    """rows with `value` of the range (first <= position < end) they lie in, `none` outside all ranges.

    Ranges don't overlap. They are cut into blocks of positions, so rows meet only the ranges that touch their block.
    """
    blocks = F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("end") - 1) / BLOCK)))
    r = ranges.where(F.col("end") > F.col("first")).select(*by, value, "first", "end", blocks.alias("_b"))
    p = rows.withColumn("_b", F.floor(F.col(position) / BLOCK))
    hit = p.join(r, [*by, "_b"]).where((F.col(position) >= F.col("first")) & (F.col(position) < F.col("end")))
    found = hit.select(*by, position, value).distinct()
    return rows.join(found, [*by, position], "left").withColumn(value, F.coalesce(value, F.lit(none)))
