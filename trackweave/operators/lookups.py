"""Joins by identifier: lookups, exchanges, counts of matches, carry-over of vanished particles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup(queries: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str], missing=-1) -> DataFrame:
    """queries with the table's values by key, `missing` where the key is null, negative or not there.

    The table holds one row per key. The order of queries is theirs to carry, as a column. Null values of a key that
    is there stay null.
    """
    found = table.select(*keys, *values, F.lit(True).alias("_found"))
    joined = queries.join(found, list(keys), "left")
    return joined.select(
        *queries.columns, *[F.when(F.col("_found"), F.col(v)).otherwise(F.lit(missing)).alias(v) for v in values]
    )


def locate(queries: DataFrame, table: DataFrame, key: str, value: str, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Many-to-many lookup (J4): (queries with n_found, one row per query row and match).

    Match counts come from the table's counts per key, so a hot key is counted before the join; matches are the
    result itself. Queries without match have n_found 0. A null key matches nothing.
    """
    keys = [*by, key]
    counts = table.groupBy(*keys).agg(F.count("*").alias("n_found"))
    counted = queries.join(counts, keys, "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    return counted, queries.join(table.select(*keys, value), keys)


def carry_over(rows: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """rows with fresh values where the key is still in the table, their former ones else."""
    fresh = table.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    joined = rows.join(fresh, list(keys), "left")
    return joined.withColumns({v: F.coalesce(f"_{v}", v) for v in values}).drop(*[f"_{v}" for v in values])


def duplicates(rows: DataFrame, keys: Sequence[str], owner: str) -> DataFrame:
    """(keys, n_owners) of the keys that more than one owner holds (J13, K1). Counts, not pairs of owners."""
    owned = rows.select(*keys, owner).distinct()
    return owned.groupBy(*keys).agg(F.count("*").alias("n_owners")).where("n_owners > 1")


def previous(rows: DataFrame, key: str, index: str, values: Sequence[str]) -> DataFrame:
    """rows joined with the same key's row of the snapshot before, as prev_<value>; inner join."""
    before = rows.select(key, (F.col(index) + 1).alias(index), *[F.col(v).alias(f"prev_{v}") for v in values])
    return rows.join(before, [key, index])


def as_of(requests: DataFrame, history: DataFrame, key: str, at: str, values: Sequence[str]) -> DataFrame:
    """requests (key, at, ...) with the values of the key's last row whose time is not after `at`.

    The distinct times of a key, asked for or known, are one row each; a window over these carries the last known values
    forward, and the requests are joined with it by key and time. So a window holds no more rows than there are times,
    however often a key is asked for. Of several history rows of a key and time the greatest counts. `at` is the time
    column's name on both sides. Keys without an earlier row, null keys and null times get nulls.
    """
    known = history.groupBy(key, at).agg(F.max(F.struct(*values)).alias("_v"))
    asked = requests.select(key, at, F.lit(None).cast(known.schema["_v"].dataType).alias("_v"))
    times = asked.unionByName(known).groupBy(key, at).agg(F.max("_v").alias("_v")).where(F.col(key).isNotNull() & F.col(at).isNotNull())
    filled = times.withColumn("_v", F.last("_v", True).over(Window.partitionBy(key).orderBy(at)))
    return requests.join(filled, [key, at], "left").select(*requests.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def parent_edges(nodes: DataFrame, node: str, parent: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per child with a parent that exists: the values of both, the parent's as parent_<value>."""
    up = nodes.select(*by, F.col(node).alias(parent), *[F.col(v).alias(f"parent_{v}") for v in values])
    return nodes.where(F.col(parent) >= 0).select(*by, node, parent, *values).join(up, [*by, parent])
