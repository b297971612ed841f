"""Binary snapshots in record blocks and group tables, as data sources split by rows (IO10, IO11).

A snapshot file holds a header record and records of positions, velocities, ids, masses and thermal energies, each
between two length markers; types follow one another within a record. Either byte order and 4- or 8-byte numbers are
recognised from the markers. Every partition reads its own rows of one file by seeking, so large files are shared out.
"""

from __future__ import annotations

import glob
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the public file format: header length and fields.
HEADER_BYTES, TYPES = 256, 6
HEADER = np.dtype(
    [
        ("npart", "i4", TYPES), ("mass", "f8", TYPES), ("time", "f8"), ("redshift", "f8"), ("flag_sfr", "i4"), ("flag_feedback", "i4"),
        ("npart_total", "i4", TYPES), ("flag_cooling", "i4"), ("num_files", "i4"), ("box_size", "f8"), ("omega_m", "f8"),
        ("omega_l", "f8"), ("h", "f8"),
    ]
)
SLICE = 1_000_000
SCHEMA = "particle_id long, x double, y double, z double, vx double, vy double, vz double, mass double, u double, type int"


def header(path: str) -> tuple[np.void, str]:
    """The header record of a file and its byte order."""
    with open(path, "rb") as f:
        raw = f.read(4 + HEADER.itemsize)
    for order in "<>":
        if len(raw) == 4 + HEADER.itemsize and np.frombuffer(raw, f"{order}i4", 1)[0] == HEADER_BYTES:
            return np.frombuffer(raw, HEADER.newbyteorder(order), 1, 4)[0], order
    raise ValueError(f"{path} doesn't start with a header record")


def layout(path: str) -> tuple[np.void, str, list[tuple[int, int]]]:
    """Header, byte order and (start, bytes) of the records after the header."""
    head, order = header(path)
    records, at = [], HEADER_BYTES + 8
    with open(path, "rb") as f:
        size = f.seek(0, 2)
        while at < size:
            f.seek(at)
            n = int(np.frombuffer(f.read(4), f"{order}u4")[0])
            f.seek(at + 4 + n)
            if f.read(4) != np.array(n, f"{order}u4").tobytes():
                raise ValueError(f"{path}: the markers of the record at {at} differ")
            records.append((at + 4, n))
            at += n + 8
    return head, order, records


class Slice(InputPartition):
    def __init__(self, path: str, kind: int, first: int, count: int) -> None:
        self.path, self.kind, self.first, self.count = path, kind, first, count


class BlockReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = sorted(p for part in options["path"].split(",") for p in glob.glob(part))
        if not self.paths:
            raise ValueError(f"no file matches {options['path']}")
        self.periodic = options.get("periodic", "true") == "true"
        self.ids = options.get("ids", "true") == "true"
        self.unsigned = options.get("unsigned", "false") == "true"
        self.slice = int(options.get("slice", SLICE))

    def partitions(self) -> list[Slice]:
        out = []
        for path in self.paths:
            n = header(path)[0]["npart"]
            out += [Slice(path, k, a, min(self.slice, int(n[k]) - a)) for k in range(TYPES) for a in range(0, int(n[k]), self.slice)]
        return out

    def _id_start(self, path: str) -> int:
        return sum(int(header(p)[0]["npart"].sum()) for p in self.paths[: self.paths.index(path)])

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        head, order, records = layout(part.path)
        n, total = head["npart"].astype(np.int64), int(head["npart"].sum())
        before = int(n[: part.kind].sum()) + part.first

        def rows(record: int, kind: str, skip: int, width: int, of: int) -> np.ndarray:
            start, size = records[record]
            each = size // (of * width)
            dtype = np.dtype(f"{order}{kind}{each}")
            got = np.fromfile(part.path, dtype, part.count * width, offset=start + skip * width * each)
            return got.reshape(part.count, width) if width > 1 else got

        xyz = rows(0, "f", before, 3, total).astype(float)
        box = float(head["box_size"])
        if self.periodic and box > 0:
            xyz = (xyz / box - np.floor(xyz / box)) * box
        vel = rows(1, "f", before, 3, total).astype(float) * np.sqrt(float(head["time"]))
        nxt = 2
        if self.ids:
            ids = rows(nxt, "u" if self.unsigned else "i", before, 1, total).astype(np.int64)
            nxt += 1
        else:
            ids = self._id_start(part.path) + before + np.arange(part.count)
        single = [k for k in range(TYPES) if head["mass"][k] == 0 and head["npart_total"][k]]
        if part.kind in single:
            skip = int(sum(n[k] for k in single if k < part.kind)) + part.first
            mass = rows(nxt, "f", skip, 1, int(n[single].sum())).astype(float)
        else:
            mass = np.full(part.count, float(head["mass"][part.kind]))
        nxt += bool(n[single].sum())
        u = np.zeros(part.count)
        if part.kind == 0 and nxt < len(records):
            u = rows(nxt, "f", part.first, 1, int(n[0])).astype(float)
        columns = [ids, *xyz.T, *vel.T, mass, u, np.full(part.count, part.kind, np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])


class BlockSource(DataSource):
    """Options: path (files or patterns, with commas), periodic, ids (whether there is an id record), unsigned, slice."""

    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))


class GroupTable(DataSourceReader):
    """Lengths of groups from table files, or the member ids they count off from id files."""

    def __init__(self, options: dict, ids: bool) -> None:
        self.paths = sorted(glob.glob(options["path"]))
        if not self.paths:
            raise ValueError(f"no file matches {options['path']}")
        self.version, self.ids = int(options.get("version", 3)), ids
        self.width, self.mask = int(options.get("id_bytes", 4)), int(options.get("mask", 0))

    def _head(self, path: str) -> tuple[int, int, int]:
        """Groups, ids and bytes of the head of a file."""
        v3 = [("n", "<i4"), ("all", "<i4"), ("ids", "<i4"), ("all_ids", "<i8"), ("files", "<i4")]
        v2 = [("n", "<i4"), ("ids", "<i4"), ("all", "<i4"), ("files", "<i4")]
        dtype = np.dtype(v3 if self.version == 3 else v2)
        head = np.fromfile(path, dtype, 1)[0]
        if int(head["files"]) != len(self.paths):
            raise ValueError(f"{path} counts {head['files']} files, there are {len(self.paths)}")
        return int(head["n"]), int(head["ids"]), dtype.itemsize + 4 * (self.ids and self.version == 3)

    def partitions(self) -> list[Slice]:
        out, start = [], 0
        for path in self.paths:
            n = self._head(path)[self.ids]
            out += [Slice(path, start, a, min(SLICE, n - a)) for a in range(0, n, SLICE)]
            start += n
        return out

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        head = self._head(part.path)[2]
        place = pa.array(part.kind + part.first + np.arange(part.count))
        if not self.ids:
            yield pa.RecordBatch.from_arrays([place, pa.array(np.fromfile(part.path, "<i4", part.count, offset=head + 4 * part.first).astype(np.int64))], ["group_id", "length"])
            return
        raw = np.fromfile(part.path, f"<i{self.width}", part.count, offset=head + self.width * part.first).astype(np.int64)
        yield pa.RecordBatch.from_arrays([place, pa.array(raw & self.mask if self.mask else raw)], ["position", "particle_id"])


class GroupLengths(DataSource):
    """Options: path (pattern of table files), version (2 or 3)."""

    @classmethod
    def name(cls) -> str:
        return "group_lengths"

    def schema(self) -> str:
        return "group_id long, length long"

    def reader(self, schema) -> GroupTable:
        return GroupTable(dict(self.options), False)


class GroupIds(DataSource):
    """Options: path (pattern of id files), version, id_bytes (4 or 8), mask (bits of an id to keep, 0 for all)."""

    @classmethod
    def name(cls) -> str:
        return "group_ids"

    def schema(self) -> str:
        return "position long, particle_id long"

    def reader(self, schema) -> GroupTable:
        return GroupTable(dict(self.options), True)


def register(spark: SparkSession) -> None:
    for source in (BlockSource, GroupLengths, GroupIds):
        spark.dataSource.register(source)
