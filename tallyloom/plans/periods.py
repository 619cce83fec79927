"""Month summaries kept up to date by batch.

What a batch adds to a month is a partial sum, in a partition by month and batch. A batch replaces its own partial
sums; the months that it had or has are added up anew from their partitions alone, and only their summaries, and those of the
months after them, whose change they are, are rewritten. The work follows the batch, not the lake; the result is that of
medallion.full_summaries() over all gold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import medallion as M
from ..sources import sinks

PARTIALS = "fiscal_year string, category string, income decimal(28,2), expenses decimal(28,2), total decimal(28,2), n long, year_month string, ingestion_batch_id string"
SUMMARIES = "fiscal_year string, total_income double, total_expenses double, net_amount double, transaction_count long, vs_prior_period_pct double, anomaly_flag boolean, period_start date, period_end date, category_breakdown string, period_type string, year_month string"
KEYS = ["year_month", "ingestion_batch_id"]


def partials(gold: DataFrame) -> DataFrame:
    """What each batch adds to each month, by category."""
    money = lambda c: F.sum(c.cast("decimal(18,2)")).cast("decimal(28,2)")
    name = F.coalesce(S.trimmed(F.col("category")), F.lit("Uncategorised"))
    per = gold.groupBy("fiscal_year", name.alias("category"), *KEYS)
    told = per.agg(money(F.col("amount_credit")).alias("income"), money(F.col("amount_debit")).alias("expenses"), money(F.col("amount_debit") + F.col("amount_credit")).alias("total"), F.count("*").alias("n"))
    return told.select(*sinks.names(PARTIALS))


def months(parts: DataFrame) -> DataFrame:
    """Summaries without the change, from partial sums."""
    categories = parts.where("n > 0").groupBy("year_month", "fiscal_year", "category").agg(*(F.sum(c).alias(c) for c in ("income", "expenses", "total", "n")))
    pairs = F.array_sort(F.collect_list(F.struct("category", F.col("total").cast("double").alias("total"))))
    money = lambda c: F.sum(c).cast("double")
    per = categories.groupBy("year_month", "fiscal_year").agg(money("income").alias("total_income"), money("expenses").alias("total_expenses"), (F.sum("income") - F.sum("expenses")).cast("double").alias("net_amount"), F.sum("n").alias("transaction_count"), F.to_json(F.map_from_entries(pairs)).alias("category_breakdown"))
    ym = F.col("year_month")
    return per.select("*", S.period_start(ym).alias("period_start"), S.period_end(ym).alias("period_end"), F.lit("monthly").alias("period_type"))


def changed(rows: DataFrame, limit: float = 50.0) -> DataFrame:
    """Adds the change against the month before that is present, and the flag; one row a month."""
    prior = F.lag("net_amount").over(Window.partitionBy("period_type").orderBy("year_month"))
    change = F.when(prior != 0, F.round((F.col("net_amount") - prior) / F.abs(prior) * 100, 2))
    return rows.withColumn("vs_prior_period_pct", change).withColumn("anomaly_flag", F.coalesce(F.abs("vs_prior_period_pct") > limit, F.lit(False)))


def refresh(spark: SparkSession, lake: str, gold: DataFrame, batches: Sequence[str]) -> list[str]:
    """Brings `partials` and `summaries` of a lake up to date with the gold rows of batches, all that these have; returns the months that were rewritten.

    Names of months come to the driver, and the summaries that change.
    """
    at, sums = f"{lake}/partials", f"{lake}/summaries"
    fresh = partials(gold)
    known = sinks.table(spark, at, PARTIALS)
    had = {tuple(r) for r in known.where(F.col("ingestion_batch_id").isin(*batches)).select(*KEYS).distinct().collect()}
    has = {tuple(r) for r in fresh.select(*KEYS).distinct().collect()}
    sinks.replace_partitions(fresh, at, KEYS)
    for month, batch in had - has:
        sinks.remove(spark, sinks.partition(at, year_month=month, ingestion_batch_id=batch))
    touched = sorted({m for m, _ in had | has})
    if not touched:
        return []
    told = months(sinks.table(spark, at, PARTIALS).where(F.col("year_month").isin(touched)))
    others = sinks.table(spark, sums, SUMMARIES).where(~F.col("year_month").isin(touched))
    whole = changed(others.drop("vs_prior_period_pct", "anomaly_flag").unionByName(told))
    present = {r["year_month"] for r in told.select("year_month").distinct().collect()}
    # a month whose predecessor changed, came or went away has another change
    calendar = sorted({r["year_month"] for r in others.select("year_month").distinct().collect()} | set(touched))
    after = {b for a, b in zip(calendar, calendar[1:], strict=False) if a in touched and b not in touched}
    again = sorted(present | after)
    rows = whole.where(F.col("year_month").isin(again)).select(*sinks.names(SUMMARIES))
    # the rows are those of a few months; they are read before their partitions are replaced
    sinks.replace_partitions(spark.createDataFrame(rows.collect(), SUMMARIES), sums, ["period_type", "year_month"])
    for month in set(touched) - present:
        sinks.remove(spark, sinks.partition(sums, period_type="monthly", year_month=month))
    return again
