"""Canonical ledger frame: naming, amounts, cleaning, deduplication."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from . import dates
from .medallion import settled


class SchemaError(ValueError):
    """A required column is missing; `field` names it."""

    def __init__(self, field: str):
        super().__init__(f"no column for {field}")
        self.field = field


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", unicodedata.normalize("NFC", name).strip().lower()).strip("_")


def detect_columns(names: Sequence[str], aliases: dict[str, Sequence[str]] = fixed.COLUMN_ALIASES) -> dict[str, str | None]:
    """For each canonical field the original header that maps to it, or None."""
    by: dict[str, str] = {}
    for n in names:
        by.setdefault(slug(n), n)
    return {field: next((by[a] for a in ([field, *options] if field in by else options) if a in by), None) for field, options in aliases.items()}


def rename(df: DataFrame) -> DataFrame:
    """Canonical names for the columns that have an alias, slugs for the rest; a field is taken once."""
    found = {v: k for k, v in detect_columns(df.columns).items() if v is not None}
    used: set[str] = set()
    out = []
    for c in df.columns:
        name = found.get(c) or slug(c) or "column"
        while name in used:
            name += "_"
        used.add(name)
        out.append(F.col(f"`{c}`").alias(name))
    return df.select(*out)


def require(df: DataFrame) -> DataFrame:
    """df, if it has a date, a description and an amount or a debit or credit column."""
    for field in fixed.REQUIRED_COLUMNS:
        if field not in df.columns:
            raise SchemaError(field)
    if not {"amount", "debit", "credit"} & set(df.columns):
        raise SchemaError("amount")
    return df


def derive_amount(df: DataFrame, sign_rule: str = "ledger") -> DataFrame:
    """Adds amount >= 0 and direction, from debit and credit or from the sign of amount.

    sign_rule: `ledger` takes a positive amount as a debit, `bank` as a credit.
    """
    zero = F.lit(0.0)
    if {"debit", "credit"} & set(df.columns):
        side = lambda c: F.coalesce(S.number(F.translate(F.col(c).cast("string"), ", ", "")), zero) if c in df.columns else zero
        debit, credit = side("debit"), side("credit")
        merged = df.withColumn("amount", F.abs(F.when(debit != 0, debit).otherwise(credit)))
        return merged.withColumn("direction", F.when(debit != 0, "debit").otherwise("credit")).drop("debit", "credit")
    value = S.number(F.translate(F.col("amount").cast("string"), ", ", ""))
    up, down = ("debit", "credit") if sign_rule == "ledger" else ("credit", "debit")
    return df.withColumn("direction", F.when(value >= 0, up).when(value < 0, down)).withColumn("amount", F.abs(value))


def usable() -> Column:
    return F.col("txn_date").isNotNull() & F.col("description").isNotNull() & (F.coalesce(F.col("amount"), F.lit(0.0)) > 0)


def normalise(df: DataFrame, default_currency: str = "PKR", formats: Sequence[str] = fixed.DATE_FORMATS, sign_rule: str = "ledger", date_order: str = "dmy", file_col: str | None = None) -> DataFrame:
    """Any frame with recognisable headers as the canonical ledger; rows that can't be used are dropped.

    date_order: `dmy`, `mdy` for files that write the month first, or `vote`: the order that reads most of the dates
    of a file (file_col), or of all rows.
    """
    if date_order not in ("dmy", "mdy", "vote"):
        raise ValueError("date_order is dmy, mdy or vote")
    formats = fixed.MONTH_FIRST_FORMATS if date_order == "mdy" else formats
    named = derive_amount(require(rename(df)), sign_rule)
    if dict(named.dtypes)["txn_date"] in ("date", "timestamp"):
        date = F.col("txn_date")
    elif date_order == "vote":
        by = [slug(file_col)] if file_col else []
        named = dates.ordered(named, dates.votes(named, "txn_date", by), by)
        date = dates.parse(F.col("txn_date"), F.col("date_order"), formats)
    else:
        date = S.parse_date(F.col("txn_date"), formats)
    optional = lambda c: F.col(c).cast("string") if c in named.columns else F.lit(None).cast("string")
    code = F.coalesce(F.upper(F.trim(optional("currency"))), F.lit(default_currency))
    # settled: the filter reads the date and the amount instead of working them out again
    full = settled(named, __date=date.cast("date"), __amount=F.col("amount"))
    full = full.select(F.col("__date").alias("txn_date"), F.col("description").cast("string").alias("description"), optional("party_name").alias("party_name"), optional("reference").alias("reference"), F.col("__amount").alias("amount"), F.col("direction"), code.alias("currency"))
    return full.where(usable())


def keep_first(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The first row of each key in a stated order; a hash key spreads even a hot group's rows only by key, so pre-hash wide keys."""
    w = Window.partitionBy("__key").orderBy(*order)
    return df.withColumn("__key", key).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__key", "__n")


def ledger_key(compat: bool = True) -> Column:
    """Fingerprint of a ledger row; without compat direction and currency are part of it."""
    more = () if compat else (F.col("direction"), F.col("currency"))
    return S.row_hash(F.col("txn_date"), F.col("description"), F.col("amount"), F.col("party_name"), F.col("reference"), *more)


def fill_missing(df: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(S.trimmed(F.col(c)), F.lit("")) == ""
    return df.withColumn("description", F.when(blank("description"), "No description").otherwise(F.col("description"))).withColumn("party_name", F.when(blank("party_name"), "Unknown").otherwise(F.col("party_name")))


def clean(df: DataFrame, order: Sequence[str], dedupe: bool = True, fill: bool = True, currencies: bool = True) -> DataFrame:
    """Dedupe, fill and normalise currencies, each on request."""
    df = keep_first(df, ledger_key(), order) if dedupe else df
    df = fill_missing(df) if fill else df
    return df.withColumn("currency", S.currency(F.col("currency"))) if currencies else df


def cleaning_report(df: DataFrame, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """One row of counts of what clean() with the same order changes; duplicates come from a count of keys, not a sort."""
    blank = lambda c: F.coalesce(S.trimmed(F.col(c)), F.lit("")) == ""
    keyed = df.withColumn("k", ledger_key())
    per = keyed.groupBy("k").agg(F.count("*").alias("n"), F.min(F.struct(*order, blank("description").alias("d"), blank("party_name").alias("p"), (S.currency(F.col("currency")) != F.col("currency")).alias("c"))).alias("first"))
    return per.agg(
        F.sum("n").alias("rows_before"), (F.sum("n") - F.count("*")).alias("duplicates"), F.count("*").alias("rows_after"),
        F.count_if(F.col("first")["d"]).alias("filled_descriptions"), F.count_if(F.col("first")["p"]).alias("filled_parties"), F.count_if(F.coalesce(F.col("first")["c"], F.lit(False))).alias("currencies_changed"),
    )
