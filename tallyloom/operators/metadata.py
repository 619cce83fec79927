"""Aggregates of a ledger that may leave it: totals, averages, trends, parties, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _money(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("decimal(18,2)")), F.lit(0)).cast("double")


def _of(direction: str) -> Column:
    return F.when(F.col("direction") == direction, F.col("amount"))


def totals(df: DataFrame) -> DataFrame:
    """Income, expenses, net and row count; without a direction column all is expense."""
    if "direction" not in df.columns:
        df = df.withColumn("direction", F.lit("debit"))
    sums = df.agg(_money(_of("credit")).alias("income"), _money(_of("debit")).alias("expenses"), F.count("*").alias("transaction_count"))
    return sums.withColumn("net", F.round(F.col("income") - F.col("expenses"), 2))


def averages(df: DataFrame) -> DataFrame:
    """Mean amount of all rows, credits and debits to two places, 0 without rows; means are of exact sums."""
    mean = lambda c: F.coalesce(F.round(F.sum(c.cast("decimal(18,2)")).cast("double") / F.count(c), 2), F.lit(0.0))
    return df.agg(mean(F.col("amount")).alias("avg_transaction"), mean(_of("credit")).alias("avg_income"), mean(_of("debit")).alias("avg_expense"))


def trends(df: DataFrame) -> DataFrame:
    """Income, expenses, net and count by month, in order."""
    per = df.groupBy(F.date_format("txn_date", "yyyy-MM").alias("month")).agg(_money(_of("credit")).alias("income"), _money(_of("debit")).alias("expenses"), F.count("*").alias("count"))
    return per.withColumn("net", F.round(F.col("income") - F.col("expenses"), 2)).orderBy("month")


def top_parties(df: DataFrame, n: int = 10) -> DataFrame:
    """The n parties of the largest sums, ties by name."""
    per = df.where("party_name is not null").groupBy("party_name").agg(_money(F.col("amount")).alias("total"), F.count("*").alias("count"))
    return per.orderBy(F.desc("total"), "party_name").limit(n)


def categories(df: DataFrame) -> DataFrame:
    per = df.where("category is not null").groupBy("category").agg(_money(F.col("amount")).alias("total"), F.count("*").alias("count"))
    return per.orderBy(F.desc("total"), "category")


#: Parts in which parties are ranked before the best of all are taken.
SALTS = 64


def document(df: DataFrame, n: int = 10) -> DataFrame:
    """One row: totals and averages as structs, trends and top parties as arrays (one row a month, n rows), in one pass over the ledger.

    Grouping sets give the sums of all rows, of each month and of each party; parties are ranked in parts.
    """
    if "direction" not in df.columns:
        df = df.withColumn("direction", F.lit("debit"))
    base = df.select(F.date_format("txn_date", "yyyy-MM").alias("month"), "party_name", "amount", _of("credit").alias("i"), _of("debit").alias("e"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))
    sums = [f(c).alias(f"{p}{c}") for c in ("amount", "i", "e") for p, f in (("s", exact), ("n", F.count))]
    per = base.groupingSets([[], [F.col("month")], [F.col("party_name")]], "month", "party_name").agg(F.grouping_id().alias("gid"), F.count("*").alias("count"), *sums)
    whole, months, parties = (F.col("gid") == g for g in (3, 1, 2))
    money = lambda c: F.coalesce(F.col(f"s{c}"), F.lit(0)).cast("double")
    mean = lambda c: F.coalesce(F.round(F.col(f"s{c}").cast("double") / F.col(f"n{c}"), 2), F.lit(0.0))
    net = F.round(money("i") - money("e"), 2)
    salted = Window.partitionBy("gid", F.when(parties, F.pmod(F.xxhash64("party_name"), F.lit(SALTS)))).orderBy(F.desc_nulls_last("samount"), "party_name")
    few = per.where(~parties | F.col("party_name").isNotNull()).withColumn("nth", F.row_number().over(salted)).where(~parties | (F.col("nth") <= n))
    one = lambda *c: F.max(F.when(whole, F.struct(*c)))
    listed = lambda cond, *c: F.collect_list(F.when(cond, F.struct(*c)))
    told = few.agg(
        one(money("i").alias("income"), money("e").alias("expenses"), F.col("count").alias("transaction_count"), net.alias("net")).alias("totals"),
        one(mean("amount").alias("avg_transaction"), mean("i").alias("avg_income"), mean("e").alias("avg_expense")).alias("averages"),
        F.array_sort(listed(months, "month", money("i").alias("income"), money("e").alias("expenses"), "count", net.alias("net"))).alias("trends"),
        listed(parties, (-money("amount")).alias("less"), "party_name", money("amount").alias("total"), "count").alias("parties"),
    )
    best = F.transform(F.slice(F.array_sort("parties"), 1, n), lambda p: F.struct(p["party_name"].alias("party_name"), p["total"].alias("total"), p["count"].alias("count")))
    zero = F.lit(0.0)
    return told.select(
        F.coalesce("totals", F.struct(zero.alias("income"), zero.alias("expenses"), F.lit(0).cast("long").alias("transaction_count"), zero.alias("net"))).alias("totals"),
        F.coalesce("averages", F.struct(zero.alias("avg_transaction"), zero.alias("avg_income"), zero.alias("avg_expense"))).alias("averages"), "trends", F.array_sort(best).alias("top_parties"),
    )
