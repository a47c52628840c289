"""Idle time-outs and throttling, as scans over ranges with carried state.

A user's events or a stream's frames may be a third of all rows, so they are not gathered.
Rows are sorted into ranges; each range is summed up by what it does to the state it is
entered with; the states at the ranges' borders follow from the sums alone, a few short
rows; then all ranges are finished side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FRAME_GAP_MS, IDLE_HOURS
from .keep import saved


def _ranged(rows: DataFrame, *order: str) -> DataFrame:
    """Rows sorted into ranges (_range) that are the same in every reading."""
    return saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))


def sessions(events: DataFrame, hours: int = IDLE_HOURS) -> DataFrame:
    """Events (user_id, ts, event_id) with a session number: a new one after more than ``hours`` without an event."""
    return _numbered(_ranged(events, "user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], "ts", lambda now, before: now - before > F.expr(f"INTERVAL {hours} HOURS"), "session")


def _numbered(ranged: DataFrame, key: str, order: list[str], value: str, parts, name: str) -> DataFrame:
    """Rows of a key in runs numbered from 1; ``parts`` (value, value before) tells where a run begins. Null keys are one key."""
    bare = F.struct(F.col(key).alias("k"))  # a struct is equal to itself with a null inside
    rows = ranged.withColumn("_key", bare)
    piece = Window.partitionBy("_range", "_key").orderBy(*order)
    new = F.coalesce(parts(F.col(value), F.lag(value).over(piece)), F.lit(False))
    rows = rows.withColumn("_new", new.cast("long")).withColumn("_within", F.sum("_new").over(piece))
    sums = rows.groupBy("_range", "_key").agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.sum("_new").alias("_runs"))
    whole = Window.partitionBy("_key").orderBy("_range")  # a row for each range at most
    first = F.coalesce(parts(F.col("_low"), F.lag("_high").over(whole)), F.lag(F.lit(1)).over(whole).isNull())
    sums = sums.withColumn("_first", first.cast("long"))
    before = F.coalesce(F.sum(F.col("_first") + F.col("_runs")).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_first")
    out = rows.join(sums.select("_range", "_key", before.alias("_before")), ["_range", "_key"])
    return out.withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).select(*(c for c in ranged.columns if c != "_range"), name)


class _Chains:
    """Frames sorted by group and time: where each group begins and ends, and of each frame the next one that could be taken after it (n: none in its group)."""

    def __init__(self, key: list[np.ndarray], ts: np.ndarray, gap: int):
        n = len(ts)
        new = np.ones(n, bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
        self.ts, self.gap = ts, gap
        self.first = np.flatnonzero(new)
        self.end = np.append(self.first[1:], n)
        self.group = np.cumsum(new) - 1
        base = ts - ts[self.first][self.group]
        # groups follow each other on one line, more than a gap apart
        span = base[self.end - 1] + gap + 1
        self.shift = np.cumsum(span) - span
        self.line = base + self.shift[self.group]
        nxt = np.searchsorted(self.line, self.line + gap)
        self.nxt = np.where(nxt < self.end[self.group], nxt, n)

    def ends(self) -> np.ndarray:
        """Of each frame, if it is taken: the last one taken in its group."""
        n = len(self.ts)
        end, nxt = np.arange(n), self.nxt.copy()
        while (on := np.flatnonzero(nxt < n)).size:  # twice as far each time
            end[on], nxt[on] = end[nxt[on]], nxt[nxt[on]]
        return end

    def ways_in(self) -> np.ndarray:
        """The frames that may be taken first in their group, whatever came before: those within the gap from its first frame, and the one after."""
        near = self.line - self.shift[self.group] < self.gap
        near[1:] &= (self.line[1:] != self.line[:-1])
        after = np.searchsorted(self.line, self.shift + self.gap)
        return np.union1d(np.flatnonzero(near), after[after < self.end])

    def taken(self, start: np.ndarray) -> np.ndarray:
        """All frames taken from those that are taken first, one a group."""
        n, out = len(self.ts), []
        while start.size:
            out.append(start)
            start = self.nxt[start]
            start = start[start < n]
        return np.sort(np.concatenate(out)) if out else start


def throttled(frames: DataFrame, gap_ms: int = FRAME_GAP_MS) -> DataFrame:
    """Frames (stream, ts_ms, frame_id) that are taken: each at least ``gap_ms`` after the last one taken.

    Which frame is taken depends on the one before. A range of a stream is entered at one of
    the few frames that lie within the gap from its first, or at the one after; for each the
    range's last frame taken is worked out beforehand. Null times are never taken.
    """
    names = ["stream", "ts_ms", "frame_id"]
    rows = frames.select(*names).where("ts_ms IS NOT NULL")
    if gap_ms <= 0:
        return rows
    ranged = _ranged(rows, *names).withColumn("_of", F.to_json(F.struct("stream")))  # never null
    piece = ["_of", "_range"]

    def ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not (held := [b[["_of", "_range", "ts_ms"]] for b in batches]):
            return
        pdf = pd.concat(held, ignore_index=True)  # the times of one range
        c = _Chains([pdf["_of"].to_numpy()], pdf["ts_ms"].to_numpy(np.int64), gap_ms)
        at = c.ways_in()
        yield pd.DataFrame({"_of": pdf["_of"].iloc[at], "_range": pdf["_range"].iloc[at], "entry": c.ts[at], "exit": c.ts[c.ends()[at]]})

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, last, place, entered = None, None, None, False
        for b in batches:
            out = []
            for s, r, entry, end in zip(b["_of"], b["_range"], b["entry"], b["exit"], strict=True):
                if s != stream:
                    stream, last, place = s, None, None
                if r != place:
                    place, entered = r, False
                if not entered and (last is None or entry >= last + gap_ms):
                    out.append((s, r, entry))
                    last, entered = end, True
            yield pd.DataFrame(out, columns=["_of", "_range", "entry"]).astype({"_of": "object", "_range": "int32", "entry": "int64"})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)):
            return
        table = pa.Table.from_batches(held)
        pdf = table.select([*piece, "ts_ms", "_row"]).to_pandas()
        # before the frames of a piece stands the time of the one to be taken first, if any
        head = pdf["_row"].to_numpy() == 0
        entry, place = pdf[head], np.flatnonzero(~head)
        pdf = pdf.iloc[place]
        c = _Chains([pdf["_of"].to_numpy(), pdf["_range"].to_numpy()], pdf["ts_ms"].to_numpy(np.int64), gap_ms)
        at = pdf.iloc[c.first][piece].merge(entry[[*piece, "ts_ms"]], "left", on=piece)["ts_ms"]
        some = np.flatnonzero(at.notna())
        start = np.searchsorted(c.line, at.to_numpy()[some].astype(np.int64) - c.ts[c.first][some] + c.shift[some])
        yield from table.select(names).take(place[c.taken(start)]).to_batches()

    # one row for each way into a range; these alone are walked stream by stream
    found = ranged.mapInPandas(ways, "_of string, _range int, entry long, exit long")
    entries = found.repartition("_of").sortWithinPartitions(*piece, "entry").mapInPandas(carry, "_of string, _range int, entry long")
    heads = entries.select(F.lit(None).cast(rows.schema["stream"].dataType).alias("stream"), F.col("entry").cast(rows.schema["ts_ms"].dataType).alias("ts_ms"), F.lit(None).cast(rows.schema["frame_id"].dataType).alias("frame_id"), *piece, F.lit(0).alias("_row"))
    both = heads.unionByName(ranged.withColumn("_row", F.lit(1)).select("stream", "ts_ms", "frame_id", *piece, "_row"))
    return both.repartition(*piece).sortWithinPartitions(*piece, "_row", "ts_ms", "frame_id").mapInArrow(walk, rows.schema)
