"""The reference ledger kept up batch by batch (problem 1 as a stream)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackweave.operators.references import merge_state


class Ledger:
    """The state table under `path`: one version per batch, of which the newest complete one counts.

    A batch's deltas are merged with the version before it into a new one; repeating a batch writes the same version
    again, so a restarted stream counts nothing twice. Only the version before the last is kept besides it. A batch
    whose former version is missing, though there are others, is an error: it would lose all counts before it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _folder(self, batch: int) -> str:
        return f"{self.path}/version={batch}"

    def _exists(self, batch: int) -> bool:
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._folder(batch)}/_SUCCESS")
        return done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done)

    def state(self, batch: int) -> DataFrame | None:
        return self.spark.read.parquet(self._folder(batch)) if self._exists(batch) else None

    def versions(self) -> list[int]:
        """The complete versions there are."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        found = [int(n.split("=")[1]) for n in names if n.startswith("version=")]
        return sorted(v for v in found if self._exists(v))

    def apply(self, deltas: DataFrame, batch: int) -> None:
        before = self.state(batch - 1)
        if before is None and (other := [v for v in self.versions() if v != batch]):
            raise ValueError(f"batch {batch} needs the state of batch {batch - 1}; there are {other}")
        merged = merge_state(deltas) if before is None else merge_state(before.drop("delta"), deltas)
        merged.write.mode("overwrite").parquet(self._folder(batch))
        old = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._folder(batch - 2))
        old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    def sink(self, to_deltas: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: to_deltas turns a batch of rows into deltas."""
        return lambda rows, batch: self.apply(to_deltas(rows), batch)
