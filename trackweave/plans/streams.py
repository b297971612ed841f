"""Queries that run as streams over the delivered tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.runtime import ensure_checkpoint_dir
from trackweave.sources.relations import snapshots
from trackweave.sources.tables import read
from trackweave.streaming.peaks import running_peaks


def stream_peaks(s: SparkSession, d: str) -> DataFrame:
    """Running peak masses of all tracks, from the catalogue's deliveries read as a stream in one pass."""
    ensure_checkpoint_dir(s)
    base = f"{s.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    schema = read(s, d, "subhalos").schema
    times = F.broadcast(snapshots(s, d).select("snapshot_id", "snapshot_index"))
    rows = s.readStream.schema(schema).parquet(f"{d}/subhalos.parque[t]")  # a pattern, as it may be a file or a folder
    rows = rows.join(times, "snapshot_id").select("track_id", "snapshot_index", "delivered_at", F.col("m_bound").alias("value"))
    query = (
        running_peaks(rows)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state")
        .trigger(once=True)  # all files at hand in one batch, so every track's snapshots come in order
        .start()
    )
    query.awaitTermination()
    return s.read.parquet(f"{base}/out").select("track_id", "snapshot_index", "peak", "peak_at")


QUERIES = {"stream_peaks": stream_peaks}
ORACLES = {
    "stream_peaks": """WITH s AS (SELECT track_id, snapshot_index, CASE WHEN NOT isnan(m_bound) THEN m_bound END AS m FROM (SELECT x.*, t.snapshot_index,
        row_number() OVER (PARTITION BY x.snapshot_id, x.track_id ORDER BY x.delivered_at DESC) AS rn FROM subhalos x
        JOIN snapshots t ON t.snapshot_id = x.snapshot_id WHERE x.track_id >= 0) WHERE rn = 1),
      p AS (SELECT track_id, snapshot_index, max(m) OVER w AS peak FROM s WINDOW w AS (PARTITION BY track_id ORDER BY snapshot_index))
      SELECT p.track_id, p.snapshot_index, p.peak, coalesce((SELECT max(s.snapshot_index) FROM s WHERE s.track_id = p.track_id AND s.m = p.peak
        AND s.snapshot_index <= p.snapshot_index), -1)::INTEGER AS peak_at FROM p""",
}
