"""What every operator needs from the session: lineage cuts, checked broadcasts, dimension tables."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast, always after counting them.
BROADCAST_ROWS = 100_000
_TABLES: list[str] = []
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, wherever it was imported from.

    The archive is written into the folder for checkpoints, which all machines share.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    ensure_checkpoint_dir(spark)
    package, archive = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    path = f"{sc.getCheckpointDir()}/trackweave.zip"
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where, True)
    stream.write(bytearray(archive.getvalue()))
    stream.close()
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; where none is named, a local master (tests) gets a folder of
    its own, and a cluster, whose machines couldn't see such a folder, is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", "")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="trackweave-"))


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and go on from it, so that lost executors cost no recomputation.

    Unlike a checkpoint, the table has its true size, so that later joins are planned by it; a checkpoint would hand on
    the estimate of its former plan, which a loop of joins multiplies without end. With partition_by, readers that
    filter that column read their part only.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    if not _TABLES:
        atexit.register(_release_at_exit)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables written by `cut` in this process, once no frame that reads them is needed; returns how many."""
    jvm, n = spark.sparkContext._jvm, len(_TABLES)
    for path in _TABLES:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _TABLES.clear()
    return n


def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            release(spark)
    except Exception:  # the session ended first: its folder is the user's to clear
        pass


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to hold at most `rows` rows, else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def params(df: DataFrame, rows: int = 1_000) -> list:
    """The rows of a parameter table of at most `rows` rows; a larger table is refused, not cut."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"a parameter table may hold {rows} rows at most")
    return got
