"""Orphan references: signed reference and existence counts per key, kept up by change deltas.

The state of one target table holds, per (period, key), a signed count of references for each referring field, a signed
count of existence, and the time of the key's newest in-time change. A referring row counts +1, one that is taken back -1.
A batch changes a key's existence by +1 or -1 where its newest change is newer than the state's and alive or withdrawn
against it. All merge with sum and max, so deltas may come in any order and in any batches, are combined before the
shuffle, and a key that holds a third of all references is no heavier than others. A key with a positive reference count
whose existence count is zero is an orphan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """`column` of `rows` points at the target's key in the same period; `name` is what the report calls it. `sign` names
    a column of +1 (a reference made) and -1 (one taken back); without it every row is +1."""

    name: str
    rows: DataFrame
    column: str
    sign: str | None = None

    def part(self, condition: Column) -> Reference:
        return Reference(self.name, self.rows.where(condition), self.column, self.sign)


def _periods(df: DataFrame, periods: DataFrame) -> DataFrame:
    """df with the closing time and null key of its period; a period that is not listed has neither."""
    dim = periods.groupBy(F.col("snapshot_id").cast("long").alias("snapshot_id")).agg(
        F.max("closed_at").alias("_closed_at"), F.max("null_group_id").alias("_null_key")
    )
    return df.join(dim, "snapshot_id", "left")


def reference_deltas(references: Sequence[Reference], periods: DataFrame) -> DataFrame:
    """+1 per referring row, or its sign. Null, negative and the period's null key refer to nothing; every delivery counts."""
    out: DataFrame | None = None
    for i, ref in enumerate(references):
        sign = (F.lit(1) if ref.sign is None else F.col(ref.sign)).cast("long").alias("_sign")
        keyed = ref.rows.select("snapshot_id", F.col(ref.column).cast("long").alias("key"), sign).where("key >= 0")
        rows = (
            _periods(keyed, periods)
            .where(F.col("_null_key").isNull() | (F.col("key") != F.col("_null_key")))
            .select(
                "snapshot_id",
                "key",
                *[(F.col("_sign") if i == j else F.lit(0).cast("long")).alias(f"refs_{j}") for j in range(len(references))],
                F.lit(0).cast("long").alias("existence"),
                F.lit(None).cast("long").alias("change"),
                F.lit(None).cast("long").alias("late"),
            )
        )
        out = rows if out is None else out.unionByName(rows)
    assert out is not None, "at least one reference is needed"
    return out


def existence_deltas(
    targets: DataFrame, key: str, periods: DataFrame, n_refs: int, withdrawn: str | None = None
) -> DataFrame:
    """One change of existence per delivered target row, stamped with its time.

    The stamp is twice the delivery time in microseconds plus 1 where the row is alive, so the greatest stamp is the
    last change and a live row wins over a withdrawal of the same microsecond. Only rows delivered by the period's
    closing time change existence; later ones are remembered apart (`late`) to tell late targets from missing ones.
    """
    alive = F.lit(1) if withdrawn is None else F.when(F.col(withdrawn), 0).otherwise(1)
    keyed = targets.select(
        "snapshot_id",
        F.col(key).cast("long").alias("key"),
        "delivered_at",
        (F.unix_micros("delivered_at") * 2 + alive).alias("_stamp"),
    ).where("key >= 0")
    in_time = F.col("delivered_at") <= F.col("_closed_at")
    return _periods(keyed, periods).select(
        "snapshot_id",
        "key",
        *[F.lit(0).cast("long").alias(f"refs_{j}") for j in range(n_refs)],
        F.lit(0).cast("long").alias("existence"),
        F.when(in_time, F.col("_stamp")).alias("change"),
        F.when(~F.coalesce(in_time, F.lit(False)), F.col("_stamp")).alias("late"),
    )


def merge_state(*parts: DataFrame) -> DataFrame:
    """The state after all deltas in `parts`; a former state is itself such a part.

    Its `existence` is the former count plus `delta`, what these deltas change it by: -1, 0 or 1.
    """
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    refs = [c for c in every.columns if c.startswith("refs_")]
    sums = every.groupBy("snapshot_id", "key").agg(
        *[F.sum(c).alias(c) for c in refs], F.sum("existence").alias("_before"), F.max("change").alias("change"), F.max("late").alias("late")
    )
    delta = F.coalesce(F.col("change") % 2, F.lit(0)) - F.col("_before")
    return sums.withColumns({"delta": delta, "existence": F.col("_before") + delta}).select("snapshot_id", "key", *refs, "existence", "change", "late", "delta")


def revisions(before: DataFrame, after: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(snapshot_id, column, sign): what turns the references of one version of a table into those of the next.

    Both hold one row per snapshot_id and keys. A row that came or went counts +1 or -1; where its reference changed, the
    former one counts -1 and the new one +1; null equals null.
    """
    by = ["snapshot_id", *keys]
    b = before.select(*by, F.col(column).alias("_b"), F.lit(True).alias("_in_b"))
    a = after.select(*by, F.col(column).alias("_a"), F.lit(True).alias("_in_a"))
    both = a.join(b, by, "full_outer")
    same = F.col("_in_a") & F.col("_in_b") & F.col("_a").eqNullSafe(F.col("_b"))
    two = F.array(
        F.when(F.col("_in_a"), F.struct(F.col("_a").alias(column), F.lit(1).alias("sign"))),
        F.when(F.col("_in_b"), F.struct(F.col("_b").alias(column), F.lit(-1).alias("sign"))),
    )
    changed = both.where(~F.coalesce(same, F.lit(False)))
    return changed.select("snapshot_id", F.explode(F.array_compact(two)).alias("r")).select("snapshot_id", "r.*")


def existence_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed changes of existence between two states: +1 appeared, -1 withdrawn. Keys without change are left out."""
    b = before.select("snapshot_id", "key", F.col("existence").alias("_before"))
    return (
        after.select("snapshot_id", "key", F.col("existence").alias("_after"))
        .join(b, ["snapshot_id", "key"], "left")
        .select("snapshot_id", "key", (F.col("_after") - F.coalesce("_before", F.lit(0))).cast("int").alias("delta"))
        .where("delta <> 0")
    )


def orphans(state: DataFrame, names: Sequence[str]) -> DataFrame:
    """(ref_field, snapshot_id, ref_key, n_refs, cause) per field and key with references but no valid target.

    cause: `withdrawn` if the last in-time row withdrew the key, `late` if all its rows came after the closing time,
    `missing` if there is none.
    """
    cause = (
        F.when(F.col("change").isNotNull(), "withdrawn").when(F.col("late").isNotNull(), "late").otherwise("missing")
    )
    fields = F.explode(
        F.array(*[F.struct(F.lit(n).alias("f"), F.col(f"refs_{i}").alias("n")) for i, n in enumerate(names)])
    )
    some = " OR ".join(f"refs_{i} > 0" for i in range(len(names)))
    return (
        state.where("existence <= 0")
        .where(some)
        .select("snapshot_id", F.col("key").alias("ref_key"), cause.alias("cause"), fields.alias("r"))
        .where("r.n > 0")
        .select(F.col("r.f").alias("ref_field"), "snapshot_id", "ref_key", F.col("r.n").alias("n_refs"), "cause")
    )


def orphan_references(
    references: Sequence[Reference],
    targets: DataFrame,
    key: str,
    periods: DataFrame,
    withdrawn: str | None = None,
    batches: Sequence[Column] = (),
) -> DataFrame:
    """Orphans of one target table, from an empty state. See `orphans` for the columns.

    `batches` are conditions on the rows of all tables; each batch's deltas are applied to the state after those before
    it. A row for which no condition holds comes in the last batch of all; a row is in the first one that holds. Empty tables give no
    rows; a null or unlisted period has no closing time, so no target is valid in it.
    """
    state: DataFrame | None = None
    left = F.lit(True)
    for condition in [*batches, F.lit(True)]:
        now = left & F.coalesce(condition, F.lit(False))
        left = left & ~F.coalesce(condition, F.lit(False))
        deltas = [
            reference_deltas([r.part(now) for r in references], periods),
            existence_deltas(targets.where(now), key, periods, len(references), withdrawn),
        ]
        state = merge_state(*deltas) if state is None else merge_state(state.drop("delta"), *deltas)
    assert state is not None
    return orphans(state, [r.name for r in references])
