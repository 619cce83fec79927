"""Operator 12: exact top-k search by a Voronoi kNN join.

The components of a vector become integers, floor(1024 * x), and scores are their inner products. All vectors get one more
component, sqrt(M^2 - |x|^2) for data (M: the greatest length of all) and 0 for queries, so that the greatest inner product
is the least distance. Pivots are the centres of a bounded sample of the queries (`SAMPLE` rows by hash order, all that the
driver ever sees of vectors); a query belongs to the cell of its nearest pivot. One pass over all rows gives each cell's summary: its radius U
(the farthest of its queries) and the k + 1 least distances from its pivot to any row. No query of the cell has its k-th neighbour beyond d + U,
d the greatest of these, so rows farther from the pivot than 2 U + d can't be among its results.

Neighbouring cells are put together in groups of some `QUERIES` queries; a row goes once to each group of which a cell needs it,
and a group's rows are dealt over slices of `SLICE` rows at most, each of which meets the group's queries in blocks. A cell
with very many queries is several groups. The best of all slices are a query's results. Distances only prune, with a margin
for rounding; scores are exact: in double precision where all sums stay below 2^50, else in Python's integers.

In many dimensions with vectors all around, no bound tells near from far and each group needs all rows, as any exact
method would; where vectors lie in clusters most rows go to the groups of their clusters only.

Defined results: vectors that are null, or hold null or non-finite components (or such that 1024 * x is not finite), take no
part; vectors of different lengths don't meet; rows without an id are no queries but are candidates, after all ids in ties; repeated
rows are queries and candidates of their own; scores beyond 64 bits count as the greatest or least long; empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import stored

TOP, EVERY, SCALE = 10, 100, 1024
#: Query rows that pivots are fitted on, at most; queries of the sample for a pivot, most pivots of a length, rounds of the fit.
SAMPLE, PER_PIVOT, PIVOTS, ROUNDS = 4096, 8, 256, 5
#: Queries of a group and groups, about; rows of a slice; rows that meet the queries at once.
QUERIES, GROUPS, SLICE, STEP = 1024, 4096, 65_536, 4096
#: Distances are in units of M; what rounding can change of them.
MARGIN = 1e-6
GREATEST = (1 << 63) - 1
ROWS = "key long, id long, vector array<double>, asks boolean"

Pivots = dict[int, np.ndarray]


def _lengths(column: pa.Array) -> np.ndarray:
    return pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows, matrix) for each length of vector in a batch."""
    lens = _lengths(batch.column("vector"))
    for size in np.unique(lens).tolist():
        own = batch.filter(pa.array(lens == size))
        yield size, own, own.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, size)


def fit(sample: np.ndarray, much: float) -> np.ndarray:
    """Pivots of a length: centres of a sample of its queries, in units of much."""
    x = sample / much
    count = min(PIVOTS, max(1, len(x) // PER_PIVOT))
    centres = x[np.random.default_rng(12).choice(len(x), count, replace=False)]
    for _ in range(ROUNDS):
        near = _far(x, centres, 0.0).argmin(1)
        n = np.bincount(near, minlength=count)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _far(x: np.ndarray, centres: np.ndarray, more) -> np.ndarray:
    """Distances of vectors, with `more` as the square of one more component, from pivots that have 0 there."""
    square = np.square(x).sum(1, keepdims=True) + more + np.square(centres).sum(1)[None, :] - 2 * x @ centres.T
    return np.sqrt(np.maximum(square, 0))


class Cells:
    """Distances to the pivots of all lengths; a length that the sample lacks has one pivot, 0."""

    def __init__(self, pivots: Pivots, much: float):
        self.pivots, self.much = pivots, much

    def at(self, size: int) -> np.ndarray:
        return self.pivots.get(size, np.zeros((1, size)))

    def data(self, matrix: np.ndarray) -> np.ndarray:
        x = matrix / self.much
        return _far(x, self.at(matrix.shape[1]), np.maximum(1 - np.square(x).sum(1, keepdims=True), 0))

    def queries(self, matrix: np.ndarray) -> np.ndarray:
        return _far(matrix / self.much, self.at(matrix.shape[1]), 0.0)


SUMMARY = "size int, cell int, n long, radius double, least array<double>"


def _summaries(cells: Cells, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, np.ndarray] = {}
        radius: dict[int, np.ndarray] = {}
        many: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, own, matrix in _by_length(batch):
                held = np.concatenate([least.get(size, np.zeros((0, len(cells.at(size))))), cells.data(matrix)])
                least[size] = np.partition(held, k, axis=0)[: k + 1] if len(held) > k + 1 else held
                far = cells.queries(matrix[own.column("asks").to_numpy(zero_copy_only=False)])
                near = far.argmin(1)
                if size not in radius:
                    radius[size], many[size] = np.zeros(far.shape[1]), np.zeros(far.shape[1], np.int64)
                np.maximum.at(radius[size], near, far[np.arange(len(near)), near])
                many[size] += np.bincount(near, minlength=far.shape[1])
        for size, held in least.items():
            n = held.shape[1]
            yield pa.record_batch({"size": pa.array([size] * n, pa.int32()), "cell": pa.array(range(n), pa.int32()), "n": pa.array(many[size]), "radius": pa.array(radius[size]), "least": pa.array(held.T.tolist(), pa.list_(pa.float64()))})

    return run


class Plan:
    """Which cells a row reaches, and the groups of cells."""

    def __init__(self, cells: Cells, summaries: list, k: int):
        self.cells, self.reach, self.first, self.parts, self.sorted = cells, {}, {}, {}, {}
        total = sum(r["n"] for r in summaries)
        self.most, self.groups = max(QUERIES, -(-total // GROUPS)), 0
        by_size: dict[int, list] = {}
        for r in summaries:
            by_size.setdefault(r["size"], []).append(r)
        for size, own in by_size.items():
            count = len(cells.at(size))
            n, reach = np.zeros(count, np.int64), np.full(count, -1.0)
            for r in own:
                n[r["cell"]] = r["n"]
                if r["n"]:
                    reach[r["cell"]] = 2 * r["radius"] + (r["least"][k] if len(r["least"]) > k else np.inf) + MARGIN
            self.reach[size], self.first[size], self.parts[size] = reach, np.zeros(count, np.int64), np.ones(count, np.int64)
            self._deal(size, asked := np.flatnonzero(n), n)
            if len(asked):
                order = asked[np.argsort(self.first[size][asked], kind="stable")]
                self.sorted[size] = order, np.flatnonzero(np.diff(self.first[size][order], prepend=-1))

    def _deal(self, size: int, own: np.ndarray, n: np.ndarray) -> None:
        """Cells in halves along their widest axis until they have few enough queries; one that has too many is several groups."""
        if not len(own):
            return
        if n[own].sum() <= self.most or len(own) == 1:
            parts = int(-(-n[own].sum() // (2 * self.most)))
            self.first[size][own], self.parts[size][own] = self.groups, parts
            self.groups += parts
            return
        at = self.cells.at(size)[own]
        order = own[np.argsort(at[:, at.var(0).argmax()], kind="stable")]
        half = min(max(1, int(np.searchsorted(np.cumsum(n[order]), n[order].sum() / 2))), len(order) - 1)
        self._deal(size, order[:half], n)
        self._deal(size, order[half:], n)

    def needed(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, groups): each row once for each group that needs it."""
        size = matrix.shape[1]
        if size not in self.sorted:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order, starts = self.sorted[size]
        near = self.cells.data(matrix)[:, order] <= self.reach[size][order]
        row, at = np.nonzero(np.logical_or.reduceat(near, starts, axis=1))
        first, parts = self.first[size][order[starts[at]]], self.parts[size][order[starts[at]]]
        row = np.repeat(row, parts)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        return row, np.repeat(first, parts) + inner

    def own(self, matrix: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The group of each query."""
        cell = self.cells.queries(matrix).argmin(1)
        size = matrix.shape[1]
        return self.first[size][cell] + key % self.parts[size][cell]


def _counts(plan: Plan) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(plan.groups, np.int64)
        for batch in batches:
            for _, _, matrix in _by_length(batch):
                n += np.bincount(plan.needed(matrix)[1], minlength=plan.groups)
        own = np.flatnonzero(n)
        yield pa.record_batch({"grp": pa.array(own.astype(np.int32)), "n": pa.array(n[own])})

    return run


SENT = "grp int, slice int, asked boolean, key long, id long, vector array<double>"


def _replicas(plan: Plan, slices: np.ndarray) -> Callable:
    """Rows for the slices of groups: asked for rows that a group needs, not asked for its queries, which come first."""

    def sent(own: pa.RecordBatch, row: np.ndarray, grp: np.ndarray, part: np.ndarray, asked: bool) -> pa.RecordBatch:
        own = own.take(pa.array(row))
        return pa.record_batch({"grp": pa.array(grp.astype(np.int32)), "slice": pa.array(part.astype(np.int32)), "asked": pa.array(np.full(len(row), asked)), "key": own.column("key"), "id": own.column("id"), "vector": own.column("vector")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own, matrix in _by_length(batch):
                key = own.column("key").to_numpy()
                row, grp = plan.needed(matrix)
                for i in range(0, len(row), STEP):
                    r, g = row[i : i + STEP], grp[i : i + STEP]
                    yield sent(own, r, g, key[r] % slices[g], True)
                row = np.flatnonzero(own.column("asks").to_numpy(zero_copy_only=False))
                if len(row):
                    grp = plan.own(matrix[row], key[row])
                    n = slices[grp]
                    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    row, grp = np.repeat(row, n), np.repeat(grp, n)
                    for i in range(0, len(row), STEP):
                        yield sent(own, row[i : i + STEP], grp[i : i + STEP], part[i : i + STEP], False)

    return run


class Best:
    """The k best of all rows seen so far for the queries of a slice: scores descending, ids ascending."""

    def __init__(self, key: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.key, self.ids, self.matrix, self.k = key, ids, matrix, k
        self.score = np.full((len(key), 0), 0, np.int64)
        self.found = np.zeros((len(key), 0), np.int64)

    def meet(self, key: np.ndarray, ids: np.ndarray, data: np.ndarray) -> None:
        """One block of rows, ids with GREATEST for those without one."""
        order = np.argsort(ids, kind="stable")
        key, ids, data = key[order], ids[order], data[order]
        m, low = len(key), -GREATEST - 1
        bound = data.shape[1] * np.abs(self.matrix).max(initial=0) * np.abs(data).max(initial=0)
        if bound < 1 << 50:
            score = (self.matrix @ data.T).astype(np.int64)
            # one number for score and place: greater scores first, then smaller ids
            both = score * m + np.arange(m - 1, -1, -1)[None, :]
        else:
            whole = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
            score = np.clip(whole(self.matrix) @ whole(data.T) if data.shape[1] else np.zeros((len(self.key), m), object), -GREATEST, GREATEST).astype(np.int64)
            both = np.empty_like(score)
            np.put_along_axis(both, np.argsort(-score, axis=1, kind="stable"), np.arange(m, 0, -1)[None, :].repeat(len(score), 0), 1)
        both[self.key[:, None] == key[None, :]] = low
        k = min(self.k, m)
        at = np.argpartition(both, m - k, axis=1)[:, m - k :] if m > k else np.arange(m)[None, :].repeat(len(both), 0)
        none = np.take_along_axis(both, at, 1) == low
        fresh = np.where(none, low, np.take_along_axis(score, at, 1))
        score, found = np.concatenate([self.score, fresh], axis=1), np.concatenate([self.found, ids[at]], axis=1)
        order = np.lexsort((found, ~score), axis=1)[:, : self.k]
        self.score, self.found = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)

    def rows(self) -> Iterator[pa.RecordBatch]:
        q, i = np.nonzero(self.score > -GREATEST - 1)
        ids = self.found[q, i]
        if len(q):
            yield pa.record_batch({"key": pa.array(self.key[q]), "query_id": pa.array(self.ids[q]), "vec_id": pa.array(ids, mask=ids == GREATEST), "score": pa.array(self.score[q, i])})


def _solve(k: int) -> Callable:
    """The best of each slice, from rows sorted by group and slice, queries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, asking, best = None, [], None

        def ready() -> Best:
            table = pa.Table.from_batches(asking).combine_chunks()
            size = int(_lengths(table.column("vector").chunk(0))[0])
            return Best(table.column("key").to_numpy(), table.column("id").to_numpy(), table.column("vector").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, size), k)

        for batch in batches:
            grp, part = batch.column("grp").to_numpy(), batch.column("slice").to_numpy()
            cuts = np.append(np.flatnonzero((np.diff(grp, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0)), len(grp)) if len(grp) else np.zeros(1, int)
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = batch.slice(i, j - i)
                if place != (grp[i], part[i]):
                    if best:
                        yield from best.rows()
                    place, asking, best = (grp[i], part[i]), [], None
                asked = own.column("asked").to_numpy(zero_copy_only=False)
                cut = int(np.searchsorted(asked, True))
                if cut:
                    asking.append(own.slice(0, cut))
                if cut < own.num_rows and asking:
                    best = best or ready()
                    for at in range(cut, own.num_rows, STEP):
                        some = own.slice(at, STEP)
                        ids = some.column("id").fill_null(GREATEST).to_numpy()
                        best.meet(some.column("key").to_numpy(), ids, some.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
        if best:
            yield from best.rows()

    return run


def integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY) -> DataFrame:
    """(key, id, vector, asks): the vectors that take part, as whole numbers, with a key for each row; stored."""
    # floor() gives a long; doubles from 2^53 on are whole numbers already
    whole = F.transform(F.transform(F.col(vector_col), lambda x: x.cast("double") * SCALE), lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), whole.alias("vector")).where(sound)
    asks = F.coalesce(F.col("id") % every == 0, F.lit(False))
    return stored(rows.select(F.monotonically_increasing_id().alias("key"), "id", "vector", asks.alias("asks")))


def replicated(rows: DataFrame, k: int = TOP) -> DataFrame | None:
    """The rows of SENT: every group's queries and the rows that it needs, by slice. None where there are no queries or rows."""
    most = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    scaled = F.aggregate(F.transform("vector", lambda x: F.pow(x / F.col("most"), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    norm = F.when(F.col("most") > 0, F.col("most") * F.sqrt(scaled)).otherwise(0.0)
    much = rows.withColumn("most", most).agg(F.max(norm).alias("much")).first()["much"]
    if much is None:
        return None
    much = min(much, np.finfo(np.float64).max) or 1.0
    sample = rows.where("asks").orderBy(F.xxhash64("key")).limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks()
    lens = _lengths(sample)
    pivots = {n: fit(sample.filter(pa.array(lens == n)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n), much) for n in np.unique(lens).tolist() if n}
    cells = Cells(pivots, much)
    told = rows.mapInArrow(_summaries(cells, k), SUMMARY).groupBy("size", "cell")
    told = told.agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.slice(F.array_sort(F.flatten(F.collect_list("least"))), 1, k + 1).alias("least"))
    plan = Plan(cells, told.collect(), k)  # a row for each pivot
    if not plan.groups:
        return None
    slices = np.ones(plan.groups, np.int64)
    for r in rows.mapInArrow(_counts(plan), "grp int, n long").groupBy("grp").agg(F.sum("n").alias("n")).collect():  # a row for each group, some 2 * GROUPS at most
        slices[r["grp"]] = -(-r["n"] // SLICE)
    return rows.mapInArrow(_replicas(plan, slices), SENT)


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of df for each row whose id is divisible by `every`."""
    rows = integers(df, id_col, vector_col, every)
    sent = replicated(rows, k)
    found = "key long, query_id long, vec_id long, score long"
    if sent is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    each = sent.repartition("grp", "slice").sortWithinPartitions("grp", "slice", "asked").mapInArrow(_solve(k), found)
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12_voronoi_knn: the ten best of `embeddings` for every hundredth vector."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
