"""Operator 8: embedding near-duplicates by iterative quantisation.

Every vector is divided by its largest absolute component first, so that tiny and huge ones neither
vanish nor overflow. Equal ones then are one class. A rotation is learned on a bounded sample (`SAMPLE` classes by hash
order and `BYTES` of vectors, all that the driver ever sees): the principal axes, turned until the signs of the coordinates
lose least, so that bits are balanced and near vectors differ in few of them. Every class gets a
code of 64 bits; vectors of fewer than 64 components get several rotations. Vectors of each length are
coded and compared among themselves; lengths that are rare in the sample get a fit on `FEW` classes of their own.
A projection is tried on the sample, each vector with a copy turned to the least cosine. Where less than `SURE` of the
copies meet (data all around one direction, or in few dimensions), it is learned around 0 instead of the mean and with
fewer rounds, as many rounds turn the rotations of a few dimensions alike; the last resort are rotations without a round.

Multi-index Hamming tables hold each 16-bit part of a code under its own value and all values one
bit away, so two codes that differ in at most two bits of a part meet; of the places where they
meet the first is the one that yields the pair, so each pair appears once. Where codes meet, a
sketch of 128 random hyperplanes of the vectors themselves tells far pairs apart: a pair at the least
cosine differs in acos(cosine) / pi of its bits, and pairs beyond that by six standard deviations
are dropped (a chance of 1e-8 for a pair at the threshold, less for closer ones). The rest is
ranked by the cosine of the original vectors in double precision; links below the threshold are
never returned.

A pair at cosine 0.9 differs in a bit with chance 0.14 and so meets in one of four tables with chance 0.97,
closer pairs nearly always. The tests measure recall against brute force.

A value of a table that more than `LOT` codes share is cut in chunks, and each pair of chunks is a cell of
its own, so that a hot value is compared by many tasks. Links of distinct vectors are pairs of
classes: a group of equal vectors costs one row, a group of n different near vectors up to
n * (n - 1) / 2, as every vector's links have to be counted.

Defined results: vectors that are null, zero, or hold null or non-finite components link with
nothing and are their own component; vectors of different lengths never link; null ids get a row
with their links and the component of their class; repeated rows link with each other; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import components, spread_join, stored
from .text import ragged

THRESHOLD, BITS, PART, SKETCH = 0.9, 64, 16, 128
#: Classes that rotations are fitted on and their bytes, at most; the share of them a length needs, classes and lengths sampled beside that.
SAMPLE, BYTES, SHARE, FEW, LENGTHS = 20_000, 128 << 20, 0.01, 500, 256
#: Fits that are tried in turn: whether around the mean, and rounds.
FITS = ((True, 40), (False, 40), (False, 4), (False, 2), (False, 1), (False, 0))
#: Share of pairs at the threshold that a learned projection has to bring together, and vectors it is tried on.
SURE, TRIED = 0.95, 2000
#: Codes of one value compared in a task, and pairs compared at once.
LOT, STEP = 8192, 1 << 21
ROWS = "key long, cid long, code long, low long, high long"

Model = tuple[np.ndarray, np.ndarray]


def _turns(low: np.ndarray | None, width: int, rounds: int = 0) -> np.ndarray:
    """Rotations of `width` coordinates side by side until there are BITS columns, fitted to low in so many rounds."""
    out = []
    for i in range(-(-BITS // width)):
        turn, _ = np.linalg.qr(np.random.default_rng(8 + i).standard_normal((width, width)))
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
            turn = (left @ right).T
        out.append(turn)
    return np.concatenate(out, axis=1)[:, :BITS]


def learn(sample: np.ndarray, centred: bool = True, rounds: int = 40) -> Model:
    """(mean, projection) of ITQ: principal axes, then rotations that alternate signs and Procrustes fits.

    Not centred, the axes are those of the vectors around 0 and all bits are signs of angles.
    """
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(0) if centred else np.zeros(unit.shape[1])
    _, axes = np.linalg.eigh((unit - mean).T @ (unit - mean) / len(unit))
    axes = axes[:, ::-1][:, : min(BITS, len(mean))]
    return mean, axes @ _turns((unit - mean) @ axes, axes.shape[1], rounds)


@lru_cache(maxsize=16)
def unlearned(size: int) -> Model:
    """The projection of a length that is beyond the LENGTHS most frequent ones: random axes and rotations."""
    axes, _ = np.linalg.qr(np.random.default_rng(size).standard_normal((size, min(BITS, size))))
    return np.zeros(size), axes @ _turns(None, axes.shape[1])


@lru_cache(maxsize=16)
def _planes(size: int) -> np.ndarray:
    return np.random.default_rng(128).standard_normal((size, SKETCH))


def _packed(on: np.ndarray) -> np.ndarray:
    """Rows of 64 booleans as 64-bit numbers."""
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64)[:, 0]


def codes(vectors: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code of each vector and the two halves of its sketch."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ _planes(vectors.shape[1]) >= 0
    return _packed((unit - model[0]) @ model[1] >= 0), _packed(near[:, :64]), _packed(near[:, 64:])


def _replicas(models: dict[int, Model]) -> Callable:
    flips = np.append(0, 1 << np.arange(PART)).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens = pa.compute.list_value_length(batch.column(1)).to_numpy()
            for size in np.unique(lens).tolist():
                own = batch.filter(pa.array(lens == size))
                v = own.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                code, low, high = codes(v, models.get(size) or unlearned(size))
                n = BITS // PART * len(flips)
                part = code[:, None] >> np.arange(0, BITS, PART, dtype=np.uint64) & np.uint64((1 << PART) - 1)
                place = np.uint64(size << 20) + (np.arange(BITS // PART, dtype=np.uint64) << np.uint64(PART))
                keys = ((part[:, :, None] ^ flips) + place[None, :, None]).reshape(-1)
                same = lambda x: pa.array(np.repeat(x, n).view(np.int64))  # noqa: E731, B023
                yield pa.record_batch({"key": pa.array(keys.view(np.int64)), "cid": same(own.column(0).to_numpy()), "code": same(code), "low": same(low), "high": same(high)})

    return run


def meet(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each pair of codes, both held under its key, has its first meeting there.

    Codes two bits apart in a part share two values: each code with the lowest of the two bits turned.
    """
    mask, width = np.uint64((1 << PART) - 1), np.uint64(PART)
    z = a ^ b
    part = key >> width & np.uint64(0xF)
    ok = np.ones(len(z), bool)
    for p in range(BITS // PART - 1):
        ok &= (np.bitwise_count(z >> np.uint64(p * PART) & mask) > 2) | (np.uint64(p) >= part)
    x, y = a >> part * width & mask, b >> part * width & mask
    own = x ^ y
    apart, lowest = np.bitwise_count(own), own & (~own + np.uint64(1))
    place = np.where(apart == 2, np.minimum(x ^ lowest, y ^ lowest), x & y)
    return ok & (apart <= 2) & (place == (key & mask))


def _pairs(most: int) -> Callable:
    """Pairs (a, b) of rows sorted by key and cell whose sketches differ in at most `most` bits."""

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, ids, code, low, high, chunk, cell, many = (table.column(n).to_numpy() for n in ("key", "cid", "code", "low", "high", "chunk", "cell", "many"))
        keys, code, low, high = (x.view(np.uint64) for x in (keys, code, low, high))
        n = len(keys)
        starts = np.flatnonzero((np.diff(keys, prepend=~keys[:1]) != 0) | (np.diff(cell, prepend=cell[:1] - 1) != 0))
        size = np.diff(np.append(starts, n))
        left = np.repeat(starts + size, size) - np.arange(n) - 1  # partners after each row in its run
        load, at = np.cumsum(left), 0
        while at < n:
            upto = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + STEP, side="right")))
            one = np.repeat(np.arange(at, upto), left[at:upto])
            two = ragged(np.arange(at, upto) + 1, left[at:upto])
            at = upto
            near = np.bitwise_count(low[one] ^ low[two]) + np.bitwise_count(high[one] ^ high[two]) <= most
            one, two = one[near], two[near]
            # a cell of two chunks compares these with each other, a cell of one chunk within it
            ok = meet(keys[one], code[one], code[two]) & ((chunk[one] != chunk[two]) | (cell[one] // many[one] == cell[one] % many[one]))
            yield pa.record_batch({"a": pa.array(ids[one[ok]]), "b": pa.array(ids[two[ok]])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last run of a batch waits for the next batch."""
        held: list[pa.RecordBatch] = []
        mark = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, cell = batch.column("key").to_numpy(), batch.column("cell").to_numpy()
            fresh = np.flatnonzero((np.diff(keys, prepend=keys[:1]) != 0) | (np.diff(cell, prepend=cell[:1]) != 0))
            last = int(fresh[-1]) if len(fresh) else 0
            if held and (last or mark != (keys[0], cell[0])):
                yield from compared(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif last:
                yield from compared(pa.Table.from_batches([batch.slice(0, last)]))
            held.append(batch.slice(last))
            mark = keys[-1], cell[-1]
        if held:
            yield from compared(pa.Table.from_batches(held))

    return run


def _ranked(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(n).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for n in ("x", "y"))
            lens = pa.compute.list_value_length(batch.column("x")).to_numpy()
            total = lambda v: np.add.reduceat(v, np.cumsum(lens) - lens)  # noqa: E731, B023
            cosine = total(x * y) / np.sqrt(total(x * x)) / np.sqrt(total(y * y))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(cosine)], names=["a", "b", "cosine"]).filter(pa.array(cosine >= threshold))

    return run


def chance(vectors: np.ndarray, model: Model, threshold: float) -> float:
    """The share of vectors that meet a copy of theirs, turned at random to a cosine of threshold, in a table."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    off = np.random.default_rng(9).standard_normal(unit.shape)
    off -= (off * unit).sum(1, keepdims=True) * unit
    off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-12)
    z = codes(unit, model)[0] ^ codes(threshold * unit + math.sqrt(1 - threshold**2) * off, model)[0]
    apart = [np.bitwise_count(z >> np.uint64(p) & np.uint64((1 << PART) - 1)) for p in range(0, BITS, PART)]
    return float((np.min(apart, axis=0) <= 2).mean())


def fitted(sample: np.ndarray, threshold: float) -> Model:
    """The first of FITS that brings enough of the pairs at the threshold together, else the one that brings most."""
    best = (-1.0, None)
    for centred, rounds in FITS:
        model = learn(sample, centred, rounds)
        share = chance(sample[:TRIED], model, threshold)
        if share >= SURE:
            return model
        best = max(best, (share, model), key=lambda x: x[0])
    return best[1]


def models(classes: DataFrame, threshold: float) -> dict[int, Model]:
    """A learned projection for each length, from one sample of all classes and one for each length that it holds too little of."""
    found: dict[int, Model] = {}

    def fit(sample: pa.Array, least: float) -> None:
        lens = pa.compute.list_value_length(sample).to_numpy()
        for n in np.unique(lens).tolist():
            if (lens == n).sum() > least:
                found[n] = fitted(sample.filter(pa.array(lens == n)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n), threshold)

    sizes = classes.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(LENGTHS).collect()
    longest = max((r["size"] for r in sizes), default=1)
    sample = classes.orderBy(F.xxhash64("cid")).limit(min(SAMPLE, max(FEW, BYTES // (8 * longest)))).select("vector").toArrow().column(0).combine_chunks()
    fit(sample, max(1, SHARE * len(sample)))
    rest = {r["size"] for r in sizes if r["n"] > 1} - set(found)
    if rest:
        order = Window.partitionBy(F.size("vector")).orderBy(F.xxhash64("cid"))
        few = min(FEW, max(2, BYTES // (8 * sum(rest))))
        own = classes.where(F.size("vector").isin(*rest)).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= few)
        fit(own.select("vector").toArrow().column(0).combine_chunks(), 0)
    return found


def links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, cosine) for pairs of rows (cid, vector) of one length with a cosine of at least threshold."""
    p = math.acos(threshold) / math.pi
    most = math.ceil(SKETCH * p + 6 * math.sqrt(SKETCH * p * (1 - p)))
    spread = classes.select("cid", "vector").mapInArrow(_replicas(models(classes, threshold)), ROWS)
    hot = spread.groupBy("key").agg(F.ceil(F.count("*") / LOT).alias("many")).where("many > 1")
    cut = spread.join(hot, "key", "left").withColumn("many", F.coalesce("many", F.lit(1)))
    cells = cut.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("many"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)))
    dealt = cells.withColumn("cell", F.least("chunk", "other") * F.col("many") + F.greatest("chunk", "other")).drop("other")
    pairs = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_pairs(most), "a long, b long")
    side = lambda end, name: classes.select(F.col("cid").alias(end), F.col("vector").alias(name))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_ranked(threshold), "a long, b long, cosine double")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of df."""
    vector = F.col(vector_col)
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    most = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    # -0.0 is 0.0, so that equal vectors are one class
    plain = F.transform("vector", lambda x: F.when(x.cast("double") / F.col("most") == 0, F.lit(0.0)).otherwise(x.cast("double") / F.col("most")))
    rows = df.select(F.col(id_col).alias("id"), F.when(F.coalesce(sound, F.lit(False)), vector).alias("vector"), most.alias("most"))
    rows = rows.select("id", plain.alias("vector"))
    rows = stored(rows.withColumn("cid", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))))
    classes = stored(rows.where("cid is not null").groupBy("vector").agg(F.min("cid").alias("cid"), F.min("id").alias("least"), F.count("*").alias("copies")))
    linked = stored(links(classes, threshold).select("a", "b"))
    ends = linked.union(linked.select("b", "a")).toDF("cid", "other")
    reach = ends.join(classes.select(F.col("cid").alias("other"), "copies"), "other").groupBy("cid").agg(F.sum("copies").alias("near"))
    roots = components(linked).withColumnsRenamed({"node": "cid"})
    named = classes.select("cid", "least", "copies").join(roots, "cid", "left").join(reach, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = stored(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = spread_join(named, least, "root").select("cid", "component_id", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = rows.select("id", "cid").join(named, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_itq_neighbors: links and component of every vector of `embeddings`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
