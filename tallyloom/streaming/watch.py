"""Files as a stream, and debouncing of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import stores

MANIFEST = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, pattern: str = "*", most: int = 1000) -> DataFrame:
    """New files of a folder and its subfolders as (path, modificationTime, length, content); hidden, temporary and foreign files are left out."""
    from ..sources import files

    found = spark.readStream.format("binaryFile").schema(MANIFEST).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", most).load(folder)
    return found.where(files.wanted(F.col("path")))


def per_file(callback: Callable[[str, str], None]) -> Callable[[DataFrame, int], None]:
    """A callback for run() that calls callback(path, event_type) for each file of a micro-batch, in order of change.

    Only names and kinds of events come to the driver, one at a time. A batch that is replayed calls again.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        kind = F.col("event_type") if "event_type" in batch.columns else F.lit("created")
        for row in batch.select("path", kind.alias("kind"), "modificationTime").orderBy("modificationTime", "path").toLocalIterator():
            callback(row["path"], row["kind"])

    return on_batch


def run(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, every: str = "2 seconds") -> StreamingQuery:
    """Calls callback(batch, id) for each micro-batch; once: all files that are there, then stop."""
    writer = stream.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def _kept(at: np.ndarray, last: int | None, gap: int) -> tuple[np.ndarray, int]:
    """Which of a key's events, in order of time, are kept after one kept at `last`, and the time of the last kept."""
    keep, i = np.zeros(len(at), bool), 0
    if last is not None:
        i = int(np.searchsorted(at, last + gap))
    while i < len(at):
        keep[i], last = True, int(at[i])
        i = max(i + 1, int(np.searchsorted(at, last + gap)))
    return keep, last


def _ways(at: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends, exits) of a slice of a key's times in order: the first event kept at or after time t lies in the first stretch that ends at or after t, and from there events are kept until the next can be from `exit` on.

    Each event's successor is the first event a gap later; successors of successors double their reach until they leave the slice.
    """
    n = len(at)
    after = np.searchsorted(at, at + gap)
    jump = np.where(after < n, after, np.arange(n))
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    exits = at[jump] + gap
    ends = np.append(np.flatnonzero(np.diff(exits)), n - 1)
    return at[ends], exits[ends]


def _stretches(keys: pa.Array) -> list[tuple[int, int]]:
    """(from, to) of each run of equal keys."""
    codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)] if len(codes) else []
    return list(zip(cuts, cuts[1:], strict=False))


def _edges(gap: int) -> Callable:
    """The first and the last key of each slice with their ways; keys between them are whole in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, times, place, nth = None, [], None, 0

        def row() -> pa.RecordBatch:
            ends, exits = _ways(np.concatenate(times), gap)
            return pa.record_batch({"key": pa.array([key]), "slice": pa.array([place], pa.int32()), "ends": pa.array([ends], pa.list_(pa.int64())), "exits": pa.array([exits], pa.list_(pa.int64()))})

        for batch in batches:
            at = batch.column("__at").to_numpy()
            for i, j in _stretches(batch.column("__key")):
                own = batch.column("__key")[i].as_py()
                if own != key:
                    if nth == 1:
                        yield row()
                    key, times, nth = own, [], nth + 1
                times.append(at[i:j])
                place = batch.column("__slice")[i].as_py()
        if nth:
            yield row()

    return run


def _entered(table: pa.Table) -> pa.Table:
    """For the slices of a key in order the time from which on each can keep an event."""
    table = table.sort_by("slice")
    upto, out = None, []
    for ends, exits in zip(table.column("ends"), table.column("exits"), strict=True):
        out.append(upto)
        ends, exits = ends.values.to_numpy(), exits.values.to_numpy()
        way = 0 if upto is None else int(np.searchsorted(ends, upto))
        upto = upto if way == len(ends) else int(exits[way])
    return pa.table({"slice": table.column("slice"), "key": table.column("key"), "upto": pa.array(out, pa.int64())})


def debounced(events: DataFrame, keys: list[str], ts: str = "ts", seconds: float = 2.0, tie: str = "event_id") -> DataFrame:
    """Events that are kept if one is dropped less than `seconds` after the last one kept of its key.

    Events are sorted in slices by key and time, and a key of any number of events spans many of them. What a slice keeps of
    a key depends on one time only, from which on it can keep events: each slice tells where every such time leads to
    (for the two keys at its edges, others are whole in it), these are followed from slice to slice, and then each slice is
    gone through once. Null keys are keys; events without a time are dropped.
    """
    gap = int(seconds * 1e6)
    known = events.where(F.col(ts).isNotNull()).withColumn("__key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})).withColumn("__at", F.unix_micros(F.col(ts).cast("timestamp")))
    names = events.columns
    order = ["__key", "__at", tie]
    dealt = stores.stored(known.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__slice", F.spark_partition_id()))
    edges = dealt.select("__key", "__at", "__slice").mapInArrow(_edges(gap), "key string, slice int, ends array<long>, exits array<long>")
    told = edges.groupBy("key").applyInArrow(_entered, "slice int, key string, upto long").where("upto is not null")
    # two rows a slice at most
    enter = {(r["slice"], r["key"]): r["upto"] - gap for r in told.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            at, keep = batch.column("__at").to_numpy(), np.zeros(batch.num_rows, bool)
            for i, j in _stretches(batch.column("__key")):
                own = batch.column("__key")[i].as_py()
                if own != key:
                    key, last = own, enter.get((batch.column("__slice")[i].as_py(), own))
                keep[i:j], last = _kept(at[i:j], last, gap)
            yield batch.filter(pa.array(keep)).select(names)

    return dealt.mapInArrow(run, events.schema)


def first_rows(stream: DataFrame, key: list[str], at: str, within: str = "1 day") -> DataFrame:
    """A stream without rows whose key came before, in any micro-batch; a row's time is `at`.

    The state holds the keys of the last `within` only and is part of the query's checkpoint, so a restart
    knows them. Rows later than that are dropped as late; null keys are keys.
    """
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(key)


def new_rows(stream: DataFrame, known: DataFrame, key: list[str], at: str, within: str = "1 day") -> DataFrame:
    """first_rows() of those rows whose key isn't in a table of known keys (a static frame)."""
    return first_rows(stream.join(known.select(*key).distinct(), key, "left_anti"), key, at, within)


def debounced_stream(events: DataFrame, key: str, ts: str = "ts", seconds: float = 2.0) -> DataFrame:
    """The same on a stream: the time of the last kept event is the state of a key, dropped a day after it.

    A key's events of one micro-batch are put in order of time together.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        # a micro-batch's events of a key come in any order
        batch = pd.concat(list(batches)).sort_values(ts, kind="stable")
        keep, last = _kept(batch[ts].astype("datetime64[us]").astype("int64").to_numpy(), last, int(seconds * 1e6))
        yield batch[keep]
        if last is not None:
            state.update((last,))
            state.setTimeoutDuration(86_400_000)

    return events.groupBy(key).applyInPandasWithState(step, events.schema, "last long", "append", "ProcessingTimeTimeout")
