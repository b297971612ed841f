"""Running peaks of tracks as a stream of catalogue deliveries (W10 with restart, section 2.11)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "track_id long, snapshot_index int, value double, peak double, peak_at int"
STATE = "last int, peak double, peak_at int"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, peak, at = state.get if state.exists else (-1, -math.inf, -1)
    rows = pd.concat(list(batches)).sort_values(["snapshot_index", "delivered_at"]).drop_duplicates("snapshot_index", keep="last")
    if len(rows) and int(rows["snapshot_index"].iloc[0]) <= last:
        raise ValueError(f"track {key[0]}: snapshot {rows['snapshot_index'].iloc[0]} comes after {last}")
    out = []
    for i, v in zip(rows["snapshot_index"], rows["value"]):
        if v is not None and not math.isnan(v) and v >= peak:  # the last of equal peaks counts
            peak, at = float(v), int(i)
        last = int(i)
        out.append((key[0], last, v, peak if at >= 0 else None, at))
    state.update((last, peak, at))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def running_peaks(stream: DataFrame) -> DataFrame:
    """(track_id, snapshot_index, value, peak, peak_at) from a stream of track_id, snapshot_index, delivered_at, value.

    State per track is its last snapshot and its peak. Of repeated deliveries in one batch the last counts; snapshots
    must come in order, so one at or before a track's last is an error, not skipped. Null and NaN values are no peak.
    A track has one row per snapshot and batch, so no group grows with the data.
    """
    rows = stream.where("track_id >= 0").select("track_id", "snapshot_index", "delivered_at", "value")
    return rows.groupBy("track_id").applyInPandasWithState(_update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
