"""Withholding tax by category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed


def categories(spark: SparkSession) -> DataFrame:
    """(known, section_key, rank): a fixed table of some seventy rows."""
    rows = [(c, k) for k, cs in fixed.SECTION_CATEGORIES for c in cs]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "known string, section_key string, rank int")


def sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.SECTIONS), "section_key string, section string, section_name string, rate_filer double, rate_non_filer double, annex_c string")


def classify(names: DataFrame) -> DataFrame:
    """(category, section_key, section, name, rates, annex) of distinct categories.

    An exact entry with a section wins; else the first entry in order that contains the category or is
    contained in it; entries without a section don't match, a blank category isn't classified.
    """
    spark = names.sparkSession
    known = F.broadcast(categories(spark).where("section_key is not null"))
    asked = names.select("category").distinct().withColumn("low", F.lower(F.trim("category")))
    met = asked.where("low <> ''").join(known, (F.col("low") == F.col("known")) | F.contains(F.col("low"), F.col("known")) | F.contains(F.col("known"), F.col("low")))
    best = met.groupBy("category").agg(F.min(F.struct((F.col("low") != F.col("known")).alias("inexact"), "rank", "section_key"))["section_key"].alias("section_key"))
    full = asked.join(best, "category", "left").join(F.broadcast(sections(spark)), "section_key", "left")
    return full.select("category", "section_key", "section", "section_name", "rate_filer", "rate_non_filer", F.coalesce("annex_c", F.lit("Other")).alias("annex_c"))


def withholding(df: DataFrame, is_filer: bool = True) -> DataFrame:
    """Adds section_key and wht, the tax on amount by category, 0 where none applies."""
    rate = F.col("rate_filer" if is_filer else "rate_non_filer")
    known = classify(df).select(F.col("category").alias("c"), "section_key", rate.alias("rate"))
    joined = df.join(known, F.col("category").eqNullSafe(F.col("c")), "left")
    tax = F.round(F.col("amount").cast("decimal(18,2)") * F.col("rate").cast("decimal(6,4)"), 2).cast("double")
    return joined.withColumn("wht", F.coalesce(tax, F.lit(0.0))).drop("c", "rate")
