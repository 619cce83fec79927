"""Spark helpers of this subpackage: blocks of documents, stored cuts of lineage, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key that a task takes without harm. Where a key has more, keys with more than 1 / HUBS of all rows are hot; there are fewer than HUBS.
CROWD, HUBS = 100_000, 10_000
#: Bytes of text for each bucket that gathers something from all blocks.
BUCKET = 64 << 20
#: Where the C library has it, the call that returns freed memory.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def released() -> None:
    """Gives back what a Python worker no longer holds: it stays for other tasks, whose memory is that of the executor too."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def trimmed(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of one group that gives back its memory after each."""

    def after(table):
        out = run(table)
        released()
        return out

    return after


def trimmed_both(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two groups."""

    def after(left, right):
        out = run(left, right)
        released()
        return out

    return after


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(df: DataFrame, text_col: str) -> int:
    """How many buckets share what all blocks of a table send: one for BUCKET bytes of text, 4 for each shuffle partition at least."""
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(4 * parts(df.sparkSession), -(-total // BUCKET))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.

    It is spark.checkpoint.dir; where that is unset a temporary folder, on one machine only (tests).
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        told = context.getConf().get("spark.checkpoint.dir")
        if not told and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(told or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, batch: int | None = None) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder; its lineage ends here.

    batch: most rows that go to a Python worker at once while it is computed, for rows with several whole texts.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    shared_folder(df.sparkSession)
    before = conf.get(name)
    if batch is not None and not 0 < int(before) <= batch:
        conf.set(name, str(batch))
    try:
        return df.checkpoint()
    finally:
        conf.set(name, before)


def cleaned(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of steps that nothing refers to any more: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Tables:
    """Tables of steps that follow each other, in a folder of their own in the shared one; drop() ends those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.names = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}", []

    def put(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """df as a table, in one folder for each value of the column `by`."""
        self.names.append(f"{self.folder}/{len(self.names)}")
        (df.write.partitionBy(by) if by else df.write).parquet(self.names[-1])
        return self.spark.read.schema(df.schema).parquet(self.names[-1])

    def drop(self, but: int = 1) -> None:
        """Deletes all tables but the last ones."""
        for i, name in enumerate(self.names[: len(self.names) - but]):
            if name:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
                self.names[i] = ""


def _digest(digest: xxhash.xxh3_64, column: pa.Array) -> None:
    """Feeds all lengths and bytes of a text column, null as empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    digest.update(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).tobytes())
    _, offsets, data = column.buffers()
    if data is not None and len(column):
        ends = np.frombuffer(offsets, np.int64 if wide else np.int32)
        digest.update(memoryview(data)[int(ends[column.offset]) : int(ends[column.offset + len(column)])])


def blocks(batches: Iterable[pa.RecordBatch], text: str, most: int, also: str | None = None) -> Iterator[tuple[int, pa.Table]]:
    """The rows of a task in blocks of about `most` bytes of text, each with a key.

    A single longer row is a block of its own. The key hashes the place of the block, its whole
    texts and, on request, another column, so that a job that meets the blocks twice sees at once
    if the second pass was dealt other rows.
    """
    released()
    part, count = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []
    size = 0

    def close() -> tuple[int, pa.Table]:
        nonlocal held, size, count
        table = pa.Table.from_batches(held)
        digest = xxhash.xxh3_64(f"{part} {count} {table.num_rows}")
        for chunk in table.column(text).chunks:
            _digest(digest, chunk)
        for chunk in table.column(also).chunks if also else ():
            _digest(digest, chunk.cast(pa.string()))
        held, size, count = [], 0, count + 1
        return np.uint64(digest.intdigest()).astype(np.int64).item(), table

    for batch in batches:
        if not batch.num_rows:
            continue
        lens = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            fit = int(np.searchsorted(np.cumsum(lens[at:]), max(most - size, 0), side="right"))
            if not fit:
                if held:
                    yield close()
                    continue
                fit = 1
            held.append(batch.slice(at, fit))
            size += int(lens[at : at + fit].sum())
            at += fit
            if size >= most:
                yield close()
    if held:
        yield close()


def spread_join(rows: DataFrame, table: DataFrame, key: str | list[str], told: tuple[int, int] | None = None) -> DataFrame:
    """The inner join of rows to table, which has one row a key with the number n of its rows, without gathering a hot key.

    told: (rows, most rows of a key), else counted here. Where no key has more than CROWD rows this is a
    plain join. Else the keys with more than 1 / HUBS of all rows are met by a broadcast of their rows of
    table, fewer than HUBS, so that rows of a hot key stay where they are; all other keys are met by a
    shuffle, with 1 / HUBS of all rows a key at most. n is dropped.
    """
    total, widest = told or table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if widest <= CROWD:
        return rows.join(table.drop("n"), key)
    hot = F.col("n") > F.lit(total / HUBS)
    few = F.broadcast(table.where(hot).drop("n"))
    rest = rows.join(few.select(key), key, "left_anti").join(table.where(~hot).drop("n"), key)
    return rows.join(few, key).unionByName(rest)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) a node, root the least node.

    Alternates the large-star and small-star steps until all edges are those of stars, from a node to the
    least of its component: every step is an aggregation with map-side combine and a join that leaves the
    edges of a hub where they are. Each round is a table of the shared folder, dropped when the next is
    there; only counts come to the driver. Loops and null ends are dropped, repeated edges are one.
    """
    tables = Tables(edges.sparkSession)
    now = tables.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    ends = lambda df: df.union(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = lambda df: df.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))

    def told(df: DataFrame) -> tuple[int, int, int]:
        """(ends, most ends of a node, nodes that are neither a least one nor have one edge only)"""
        per = ends(df).groupBy("u").agg(F.count("*").alias("n"), F.count_if(F.col("u") > F.col("v")).alias("up"))
        zero = F.lit(0)
        return tuple(per.agg(F.coalesce(F.sum("n"), zero), F.coalesce(F.max("n"), zero), F.count_if((F.col("up") > 0) & (F.col("n") > 1))).first())

    for _ in range(rounds):
        total, widest, open_ = told(now)
        if not open_:
            break
        both = ends(now)
        lows = least(both).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both.where("v > u"), lows, "u", (total, widest)).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        lows = least(large)
        small = spread_join(large, lows, "u", (total, widest)).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = tables.put(small.union(lows.select("u", F.col("m").alias("v"))).distinct())
        tables.drop()
    else:
        raise RuntimeError(f"components() did not settle in {rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
