"""What is known already: hash tables that are not shuffled again, and a screen before them.

A ledger of hashes is a table in buckets of its key; rows that come meet it bucket by bucket, so that only they are
shuffled. Before that a screen, a bitmap of fixed size over the known hashes, tells most new keys apart without any
join: a key whose bit is not set is new for certain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a screen; 2^23 are 256 rows of 4 KB, which is what a broadcast of it holds at most.
BITS = 1 << 23
SLICE = 32_768


def save(df: DataFrame, name: str, key: Sequence[str], buckets: int = 64, mode: str = "overwrite") -> None:
    """A table of the catalog in buckets of its key, sorted in each."""
    df.write.mode(mode).bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)


def unknown(incoming: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key isn't known. Where known is a table in buckets of the key, its side has no exchange."""
    return incoming.join(known.select(*key), list(key), "left_anti")


def _place(key: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BITS)) + 1


def screen(known: DataFrame, key: Sequence[str]) -> DataFrame:
    """(part, bits): the places of all known keys as bitmaps of 4 KB, 256 rows at most. Screens of parts are put together by merged()."""
    at = _place(key)
    return known.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def merged(screens: DataFrame) -> DataFrame:
    """One screen from the rows of several, say of the batches so far."""
    return screens.groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits"))


def screened(incoming: DataFrame, screen_: DataFrame, key: Sequence[str], name: str = "maybe_known") -> DataFrame:
    """Adds whether a key may be known; never false for one that is. Keys with a null are new."""
    at = F.bitmap_bit_position(_place(key))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = incoming.join(F.broadcast(screen_.select(F.col("part").alias("__part"), F.col("bits").alias("__bits"))), F.bitmap_bucket_number(_place(key)) == F.col("__part"), "left")
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    mark = F.pow(F.lit(2), at % 8).cast("int")
    bit = F.when(F.col("__bits").isNotNull(), byte.bitwiseAND(mark) > 0)
    return met.withColumn(name, whole & F.coalesce(bit, F.lit(False))).drop("__part", "__bits")


def unknown_screened(incoming: DataFrame, known: DataFrame, screen_: DataFrame, key: Sequence[str]) -> DataFrame:
    """unknown(), with the join for those keys only that the screen can't tell."""
    told = screened(incoming, screen_, key)
    return told.where("NOT maybe_known").unionByName(unknown(told.where("maybe_known"), known, key)).drop("maybe_known")


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
