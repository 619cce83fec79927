"""Operator 10: mixing sources to target weights by cube-method balanced sampling.

Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and share the sum of all sizes;
a target stops at `most` times its source's size and the excess is shared again by weight. A source
with target r times its size takes each document floor(r) times, and once more with the
inclusion probability r - floor(r). Which documents get that extra copy is a balanced sample: the
flight phase of the cube method moves the probabilities along directions that keep the sums of
tokens and of documents, until all but two documents of a block are decided. The undecided
ones of all blocks form new blocks, round after round. The flight of a source's last block leaves `LEFT` documents
of its whole range of sizes beside; these and the two undecided ones are the landing problem: of all their
outcomes that keep the number of documents to less than one, the one nearest to the balance of words. No
decision of the flight is taken back.

Blocks hold about `BLOCK` documents of one source by the hash of their key, so a source of any size is
spread; a round passes on at most two documents a block, so the rounds are few (the logarithm
of the source's documents to the base BLOCK / 2). All coins are hashes of keys: reruns agree, in any partitioning.

Defined results: null texts have size 0; a source of size 0 has target 0 and takes nothing; null
ids and repeated rows are units of their own (rows equal in id, source, size and text are
interchangeable); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import stored
from .text import mix64

WEIGHTS, MOST, BLOCK, SEED = (1, 2, 3), 3.0, 4096, 10
#: Documents of a last block that the flight leaves to the landing.
LEFT = 12
LOT = 100_000


def words_in(text_col: str = "text"):
    """The number of words of a text, counted in the JVM."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): water filling over one row a source.

    With sources in order of the level at which they are full, most * size / weight, the level that
    the rest would get if all before are full falls below a source's own level exactly from the
    first source on that isn't full.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # binary order of UTF-8 is code point order
    place = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    level = Window.orderBy(F.col("full"), F.col("source").cast("binary").asc_nulls_last())
    before, rest, whole = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    filled = (
        per.withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("full", F.col("cap") / F.col("weight"))
        .withColumn("offer", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("level", -F.min(F.when(F.col("offer") <= F.col("full"), F.struct("full", (-F.col("offer")).alias("less")))).over(whole)["less"])
    )
    return filled.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def flight(chance: np.ndarray, size: np.ndarray, coins: np.ndarray) -> np.ndarray:
    """Moves inclusion chances until at most two are fractional, keeping their sum and that of chance * size.

    Takes three undecided units at a time; the direction is the null vector of the two balancing
    rows on them. A step decides at least one of the three, and the mean over its two outcomes
    is the old chance.
    """
    p, x, eps = chance.tolist(), size.tolist(), 1e-9
    held: list[int] = []
    for k in range(len(p)):
        if p[k] <= eps or p[k] >= 1 - eps:
            continue
        held.append(k)
        if len(held) < 3:
            continue
        i, j, m = held
        u = (x[m] - x[j], x[i] - x[m], x[j] - x[i])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[h]) / v if v > 0 else p[h] / -v) for h, v in zip(held, u, strict=True) if v)
        down = min((p[h] / v if v > 0 else (1 - p[h]) / -v) for h, v in zip(held, u, strict=True) if v)
        step = up if coins[k] * (up + down) < down else -down
        for h, v in zip(held, u, strict=True):
            p[h] = min(1.0, max(0.0, p[h] + step * v))
        held = [h for h in held if eps < p[h] < 1 - eps]
    out = np.array(p)
    return np.where(out <= eps, 0.0, np.where(out >= 1 - eps, 1.0, out))


def landing(chance: np.ndarray, size: np.ndarray, coins: np.ndarray) -> np.ndarray:
    """Decides what the flight left, by the outcome that costs least.

    Outcomes keep the sum of chances to less than one document; of those the one whose sum of sizes is nearest to
    that of chance * size is taken, of equals the one that comes first in an order by coin.
    """
    out, open_ = chance.copy(), np.flatnonzero((chance > 0) & (chance < 1))
    if not len(open_):
        return out
    open_ = open_[np.argsort(coins[open_], kind="stable")]
    taken = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
    off = np.abs(taken.sum(1) - chance[open_].sum())
    words = np.abs(taken @ size[open_] - (chance * size)[open_].sum())
    out[open_] = taken[np.lexsort((off, words, off >= 1 - 1e-9))[0]]
    return out


def final(chance: np.ndarray, size: np.ndarray, coins: np.ndarray) -> np.ndarray:
    """Flight and landing of a last block, whose documents come in order of size."""
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    beside = open_[np.unique(np.linspace(0, len(open_) - 1, min(LEFT, len(open_))).astype(int))] if len(open_) else open_
    flown = np.setdiff1d(open_, beside)
    p = chance.copy()
    p[flown] = flight(chance[flown], size[flown], coins[flown])
    return landing(p, size, coins)


def _coins(keys: pd.Series, salt: int) -> np.ndarray:
    return mix64(keys.to_numpy(np.int64).view(np.uint64) ^ np.uint64(SEED * 1_000_003 + salt)).astype(np.float64) / 2.0**64


def _flown(salt: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # from large to small: what stays open at the end are small documents
        rows = rows.assign(coin=_coins(rows["key"], salt)).sort_values(["size", "coin", "key", "nth"], ascending=[False, True, True, True]).drop(columns="coin").reset_index(drop=True)
        coins = _coins(rows["key"], salt + 1)
        chance, size = rows["chance"].to_numpy(), rows["size"].to_numpy(np.float64)
        return rows.assign(chance=(final if last else flight)(chance, size, coins))

    return run


def mix(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds source_size, target, copies and taken to units (source, size, key, nth).

    (key, nth) must name a unit of its source; key is a long that also seeds its coins.
    """
    goal = targets(units.select("source", "size"), weights, most)
    counted = units.groupBy("source").agg(F.count("*").alias("n"))
    known = goal.join(counted, goal.source.eqNullSafe(counted.source)).select(goal["*"], "n").withColumnRenamed("source", "s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ready = (
        units.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("sure", F.floor(ratio + 1e-12).cast("long"))
        .withColumn("chance", F.greatest(ratio - F.col("sure"), F.lit(0.0)))
        .withColumn("block", F.pmod(F.xxhash64("key", "nth"), F.ceil(F.col("n") / BLOCK)))
    )
    schema, settled, salt = ready.schema, [], 0
    most_blocks = known.agg(F.max(F.ceil(F.col("n") / BLOCK))).first()[0] or 0
    while True:
        last = most_blocks <= 1
        flown = stored(ready.groupBy("source", "block").applyInPandas(_flown(salt, last), schema))
        if last:
            settled.append(flown)
            break
        open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
        settled.append(flown.where(~open_))
        # the two that a block left go on to a block that gathers BLOCK / 2 blocks
        ready = flown.where(open_).withColumn("block", F.floor(F.col("block") / (BLOCK // 2)).cast("long"))
        schema, salt = ready.schema, salt + 3
        most_blocks = -(-most_blocks // (BLOCK // 2))
    done = reduce(DataFrame.unionByName, settled)
    copies = F.col("sure") + F.round("chance").cast("long")
    return done.withColumn("copies", copies).withColumn("taken", F.col("size") * copies).drop("n", "sure", "chance", "block")


def _keyed(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, size, key, row): key hashes id and text."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    return df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(text_col).alias("size"), F.xxhash64(id_col, text_col).alias("key"), row)


def times(df: DataFrame, n: str, name: str) -> DataFrame:
    """Each row n times, numbered from 1, in lots so that no row holds a long list."""
    lots = df.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(LOT).cast("long"))))
    return lots.withColumn(name, F.explode(F.sequence(F.col("lot") + 1, F.least(F.col("lot") + LOT, n)))).drop("lot")


def _units(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, size, key, nth): nth numbers the rows of one key and source, which are counted and not gathered."""
    per = _keyed(df, id_col, source_col, text_col).groupBy("id", "source", "size", "key").agg(F.count("*").alias("rows"))
    return stored(times(per, "rows", "nth").drop("rows"))


def weigh(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """(id_col, size, source_size, target, copies, taken) for each row of df."""
    mixed = mix(_units(df, id_col, source_col, text_col), **options)
    return mixed.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", "taken")


def take(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: each row of df as often as it is taken, with the columns of df.

    Rows equal in id, text and source share what is taken of them evenly, in the order of a hash of all columns.
    """
    mixed = mix(_units(df, id_col, source_col, text_col), **options)
    taken = mixed.groupBy("key", "source").agg(F.sum("copies").alias("copies")).where("copies > 0").toDF("k", "s", "copies")
    alike = _keyed(df, id_col, source_col, text_col).groupBy("key", "source", F.xxhash64("row").alias("kind")).agg(F.any_value("row").alias("row"), F.count("*").alias("rows"))
    own = Window.partitionBy("key", "source")
    upto, whole = F.sum("rows").over(own.orderBy("kind")), F.sum("rows").over(own)
    met = alike.withColumn("upto", upto).withColumn("whole", whole).join(taken, (F.col("key") == F.col("k")) & F.col("source").eqNullSafe(F.col("s")))
    part = lambda n: F.floor(F.col("copies") * n / F.col("whole"))
    shared = met.withColumn("copies", (part(F.col("upto")) - part(F.col("upto") - F.col("rows"))).cast("long")).where("copies > 0")
    return times(shared.select("row", "copies"), "copies", "nth").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_cube_mixing: the words taken of every document."""
    return weigh(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies")
