"""Header dictionary, fuzzy header matches, learned mappings and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

LEAST = 0.5


def entries() -> list[tuple[str, str | None, str, str, int]]:
    """(layer, software, header, target, rank) of the whole dictionary; rank is its order."""
    rows: list[tuple[str, str | None, str, str]] = []
    for software, fields in fixed.SOFTWARE_HEADERS.items():
        rows += [("software", software, h, t) for h, t in fields.items()]
    for layer, table in (("urdu", fixed.URDU_HEADERS), ("roman_urdu", fixed.ROMAN_URDU_HEADERS)):
        rows += [(layer, None, h, t) for h, t in table.items()]
    rows += [("general", None, h, t) for t, hs in fixed.GENERAL_HEADERS for h in hs]
    return [(*r, i) for i, r in enumerate(rows)]


def dictionary(spark: SparkSession) -> DataFrame:
    """The dictionary as a frame; a few hundred fixed rows, so joins may broadcast it."""
    return spark.createDataFrame(entries(), "layer string, software string, header string, target string, rank int")


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def exact(headers: DataFrame) -> DataFrame:
    """(header, software, target, layer, confidence) of distinct headers (header, software); null without a match.

    Layers in order: software, Urdu, Roman Urdu, general, and the general one by letters and digits alone.
    """
    known = F.broadcast(dictionary(headers.sparkSession).withColumnsRenamed({"software": "s", "header": "h"}))
    asked = headers.select("header", "software").distinct().withColumn("key", F.lower(F.trim("header")))
    same = (F.col("key") == F.col("h")) & (F.col("s").isNull() | (F.col("s") == F.col("software")))
    met = asked.join(known, same).select("header", "software", "target", "layer", "rank")
    general = known.where("layer = 'general'").withColumn("p", _plain(F.col("h")))
    loose = asked.withColumn("p", _plain(F.col("key"))).where("p <> ''").join(F.broadcast(general), "p").select("header", "software", "target", F.lit("normalised").alias("layer"), "rank")
    order = F.create_map(*(F.lit(x) for pair in ((k, i) for i, k in enumerate(fixed.LAYER_CONFIDENCE)) for x in pair))
    confidence = F.create_map(*(F.lit(x) for pair in fixed.LAYER_CONFIDENCE.items() for x in pair))
    best = met.unionByName(loose).groupBy("header", "software").agg(F.min(F.struct(order[F.col("layer")].alias("o"), "rank", "target", "layer")).alias("b")).withColumnsRenamed({"header": "h", "software": "s"})
    back = asked.join(best, F.col("header").eqNullSafe(F.col("h")) & F.col("software").eqNullSafe(F.col("s")), "left")
    return back.select("header", "software", F.col("b")["target"].alias("target"), F.col("b")["layer"].alias("layer"), confidence[F.col("b")["layer"]].alias("confidence"))


def bigrams(c: Column) -> Column:
    return F.when(F.length(c) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of bigrams, from arrays of them."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def fuzzy(headers: DataFrame, least: float = LEAST) -> DataFrame:
    """(header, target, score, confidence): the most similar dictionary header, first entry wins ties, null below least.

    Headers and dictionary are exploded into bigrams and joined on them, so only pairs that share
    one are looked at; the work is on distinct headers.
    """
    known = dictionary(headers.sparkSession).where("layer in ('general', 'software')")
    rank = F.when(F.col("layer") == "general", 0).otherwise(100_000) + F.col("rank")
    right = known.withColumn("grams", bigrams(F.col("header"))).select("target", rank.alias("rank"), F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    asked = headers.select("header").distinct()
    left = asked.withColumn("grams", bigrams(F.lower(F.trim("header")))).select("header", F.size("grams").alias("m"), F.explode("grams").alias("gram"))
    pairs = left.join(F.broadcast(right), "gram").groupBy("header", "target", "rank", "m", "n").agg(F.count("*").alias("both"))
    scored = pairs.withColumn("score", F.col("both") / (F.col("m") + F.col("n") - F.col("both"))).where(F.col("score") >= least)
    best = scored.groupBy("header").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"), "target")).alias("b"))
    return asked.join(best, "header", "left").select("header", F.col("b")["target"].alias("target"), F.round(F.col("b")["score"], 6).alias("score"), F.round(0.85 * F.col("b")["score"], 2).alias("confidence"))


def coverage(mapped: DataFrame, by: str) -> DataFrame:
    """Share of a file's headers that are mapped with a confidence of at least one half."""
    ok = F.col("target").isNotNull() & (F.col("confidence") >= LEAST)
    return mapped.groupBy(by).agg(F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("coverage"))


def learned(headers: DataFrame, mappings: DataFrame) -> DataFrame:
    """Learned mapping of each (source_software, original_column)."""
    return headers.join(mappings, ["source_software", "original_column"], "left")


def upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Mappings after an update: a confirmed one is never replaced by an unconfirmed one; else replaced and counted."""
    keys = ["source_software", "original_column"]
    c, i = current.alias("c"), incoming.alias("i")
    both = c.join(i, keys, "full")
    held = F.col("i.mapped_to").isNull() | (F.coalesce(F.col("c.confirmed_by_user"), F.lit(False)) & ~F.coalesce(F.col("i.confirmed_by_user"), F.lit(False)))
    pick = lambda n: F.when(held, F.col(f"c.{n}")).otherwise(F.col(f"i.{n}")).alias(n)
    seen = F.when(F.col("i.mapped_to").isNull(), F.col("c.times_seen")).when(F.col("c.mapped_to").isNull(), F.lit(1)).when(held, F.col("c.times_seen")).otherwise(F.col("c.times_seen") + 1)
    return both.select(*keys, pick("mapped_to"), pick("confidence"), pick("confirmed_by_user"), seen.cast("int").alias("times_seen"))


def validated(suggestions: DataFrame, valid: DataFrame, most: int = 50) -> DataFrame:
    """Adds rejected_because to suggestions (header, target): length, reserved, unknown target, or null if it is fine."""
    known = valid.select(F.col("target").alias("known")).distinct()
    met = suggestions.join(known, F.col("target") == F.col("known"), "left")
    reason = F.when(F.length("target") > most, "length").when(F.lower("target").isin(*fixed.RESERVED_NAMES), "reserved").when(F.col("known").isNull(), "unknown target")
    return met.withColumn("rejected_because", reason).drop("known")
