"""The order of day and month in a column of dates, told by the column itself.

03/04/2024 is 3 April or 4 March. A first pass counts, for each file, how many of its dates can be read day first and
month first; the order that reads more of them holds for the whole file in a second pass. Files that tell nothing
stay day first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S

DAY_FIRST, MONTH_FIRST = "dmy", "mdy"


def votes(df: DataFrame, date: str, by: Sequence[str]) -> DataFrame:
    """(by, day_first, month_first, date_order): one row a file, counted with map-side sums."""
    fits = lambda shape: F.count_if(S.parse_date(F.col(date), (shape,)).isNotNull())
    counted = df.groupBy(*by).agg(fits("d/M/yyyy").alias("day_first"), fits("M/d/yyyy").alias("month_first"))
    return counted.withColumn("date_order", F.when(F.col("month_first") > F.col("day_first"), MONTH_FIRST).otherwise(DAY_FIRST))


def ordered(df: DataFrame, told: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds date_order to rows by their file, day first for files without a vote; null names are names."""
    orders = told.select(*(F.col(c).alias(f"__{c}") for c in by), "date_order")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    met = df.join(orders, same if same else F.lit(True), "left")
    return met.withColumn("date_order", F.coalesce("date_order", F.lit(DAY_FIRST))).drop(*(f"__{c}" for c in by))


def parse(date: Column, order: Column, formats: Sequence[str] = fixed.DATE_FORMATS) -> Column:
    """A date by the formats, with the month first where the order says so."""
    swap = {"d/M/yyyy": "M/d/yyyy", "M/d/yyyy": "d/M/yyyy"}
    return F.when(order == MONTH_FIRST, S.parse_date(date, tuple(swap.get(f, f) for f in formats))).otherwise(S.parse_date(date, formats))


def inferred(df: DataFrame, date: str, by: Sequence[str], formats: Sequence[str] = fixed.DATE_FORMATS, name: str = "txn_date") -> DataFrame:
    """Adds a date column and date_order: the dates of each file by the order that fits most of them."""
    known = ordered(df, votes(df, date, by), by)
    return known.withColumn(name, parse(F.col(date), F.col("date_order"), formats))
