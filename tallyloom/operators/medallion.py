"""Raw rows to silver, quarantine and gold, and the monthly summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from . import dates

GOLD_LEAST, SILVER_LEAST = 0.7, 0.3


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns by a generator of one row.

    Later filters stay above it and later columns refer to its output, so that a long chain of
    rules is computed once a row and never multiplied out by the optimiser.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def numbered(df: DataFrame, order: Sequence[str], name: str = "number", ranges: int = 64) -> DataFrame:
    """Adds the place of each row in an order, from 1, without sorting all rows in one task.

    Rows are dealt by ranges of the first column of the order, whose bounds come from at most a thousand of its
    values; each range is numbered by itself and shifted by the rows before it.
    """
    first = F.col(order[0])
    some = df.select(first.alias("v")).where("v is not null").distinct().orderBy(F.xxhash64("v")).limit(1000).collect()
    values = sorted(r["v"] for r in some)
    bounds = [values[len(values) * i // ranges] for i in range(1, ranges)] if values else []
    before = F.size(F.filter(F.array(*(F.lit(b) for b in dict.fromkeys(bounds))), lambda b: b <= first)) if bounds else F.lit(0)
    dealt = df.withColumn("__range", F.when(first.isNull(), -1).otherwise(before))
    counts = dealt.groupBy("__range").agg(F.count("*").alias("n"))
    # one row a range
    shifts = counts.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__shift"))
    placed = dealt.withColumn(name, F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return placed.join(F.broadcast(shifts), "__range").withColumn(name, F.col(name) + F.col("__shift")).drop("__range", "__shift")


def bronze(df: DataFrame, batch: str, source_type: str = "csv", software: str | Column = "manual_csv", order: Sequence[str] = (), file_col: str | None = None, number_col: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Every row verbatim as JSON with its headers, a row number from 1 in its file, and status `pending`.

    number_col holds row numbers that were read with the rows; else rows are numbered by order, within their file or
    over all of them, or as they come. Both columns stay out of the JSON, and so do those of `keep`, which go on as they are.
    """
    columns = [c for c in df.columns if c not in (file_col, number_col, *keep)]
    file = F.col(file_col) if file_col else F.lit("inline")
    if number_col:
        placed = df.withColumn("__number", F.col(number_col))
    elif file_col:
        placed = df.withColumn("__number", F.row_number().over(Window.partitionBy(file).orderBy(*(order or [F.monotonically_increasing_id()]))))
    else:
        placed = numbered(df, order, "__number") if order else numbered(df.withColumn("__at", F.monotonically_increasing_id()), ["__at"], "__number")
    raw = F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), {"ignoreNullFields": "false"})
    return placed.select(
        file.alias("source_file"), F.col("__number").cast("int").alias("source_row_number"), raw.alias("raw_content"), F.to_json(F.array(*map(F.lit, columns))).alias("raw_headers"),
        F.lit(batch).alias("ingestion_batch_id"), F.lit(source_type).alias("source_type"), (software if isinstance(software, Column) else F.lit(software)).alias("source_software"), F.lit("pending").alias("processing_status"), *keep,
    ).withColumn("bronze_id", F.sha2(F.concat_ws("|", "ingestion_batch_id", "source_file", "source_row_number"), 256))


def fields_of(raw: Column) -> Column:
    """A raw JSON object as a map whose keys are lower-cased and trimmed; the last of equal keys wins."""
    entries = F.map_entries(F.from_json(raw, "map<string,string>"))
    named = F.transform(entries, lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))

    def mapped(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda e: e["key"])
        last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == e["key"]))
        # keys are rarely equal
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_entries(pairs)).otherwise(F.map_from_entries(last))

    return S.let(named, mapped)


def first_field(m: Column, keys: Sequence[str]) -> Column:
    """The trimmed value of the first key that is present, even if it is empty; null if none is."""
    first = F.get(F.filter(S.literals(keys), lambda k: F.map_contains_key(m, k)), F.lit(0))
    return F.trim(F.try_element_at(m, first))


def part_field(m: Column, parts: Sequence[str]) -> Column:
    """The value of the first entry whose key contains a part, parts by priority."""
    pick = lambda p: F.get(F.filter(F.map_entries(m), lambda e: F.contains(e["key"], F.lit(p))), F.lit(0))["value"]
    return F.coalesce(*map(pick, parts))


def classified(rows: DataFrame) -> DataFrame:
    """Silver columns, quality score and quarantine reason for every bronze row."""
    m, raw = F.col("fields"), F.col("raw_content")
    broken = F.when(raw.isNull() | F.try_parse_json(raw).isNull(), "invalid_json").when(F.substring(F.trim(raw), 1, 1) != "{", "invalid_json_structure")
    parsed = settled(rows, fields=fields_of(raw), broken=broken)
    keys = {"date_text": fixed.DATE_KEYS, "description": fixed.DESCRIPTION_KEYS, "vendor": fixed.VENDOR_KEYS, "debit_text": fixed.DEBIT_KEYS, "credit_text": fixed.CREDIT_KEYS, "amount_text": fixed.AMOUNT_KEYS}
    named = settled(parsed, **{n: first_field(m, k) for n, k in keys.items()}, language_detected=S.language(F.concat_ws(" ", F.map_values(m))))
    masked, kinds = S.mask(F.col("description"))
    typed = settled(named, transaction_date=S.parse_date(F.col("date_text")), debit=S.parse_amount(F.col("debit_text")), credit=S.parse_amount(F.col("credit_text")), signed=S.parse_amount(F.col("amount_text")), description_masked=masked, pii_types=kinds, low=F.lower("description"))
    explicit, zero = F.col("debit_text").isNotNull() | F.col("credit_text").isNotNull(), F.lit(0.0)
    side = lambda c, mine: F.abs(F.when(explicit, F.coalesce(F.col(c), zero)).otherwise(F.when(mine, F.col("signed")).otherwise(zero)))
    money = settled(typed, amount_debit=side("debit", F.col("signed") < 0), amount_credit=side("credit", F.col("signed") >= 0), category=S.lowered_category(F.col("low"))["category"]).drop("low")
    said = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    score = S.quality_score(F.col("transaction_date").isNotNull(), (F.col("amount_debit") != 0) | (F.col("amount_credit") != 0), said("description"), said("vendor"), F.size("pii_types") > 0)
    scored = money.withColumn("quality_score", score)
    reasons = F.concat_ws("; ", F.when(F.col("transaction_date").isNull(), "date_parse_failed"), F.when(F.col("quality_score") < SILVER_LEAST, F.format_string("low_quality_score(%s)", F.col("quality_score").cast("string"))))
    return scored.withColumn("reason", F.coalesce("broken", F.when(reasons != "", reasons)))


def silver(rows: DataFrame) -> DataFrame:
    """Rows of classified() that pass."""
    good = rows.where("reason is null")
    return good.select(
        F.sha2(F.concat(F.lit("silver|"), "bronze_id"), 256).alias("silver_id"), "bronze_id", "ingestion_batch_id", "transaction_date", S.year_month(F.col("transaction_date")).alias("year_month"), S.fiscal_year(F.col("transaction_date")).alias("fiscal_year"),
        "description", "description_masked", "vendor", "category", "amount_debit", "amount_credit", (F.col("amount_credit") - F.col("amount_debit")).alias("net_amount"), F.lit("PKR").alias("currency"),
        "language_detected", (F.size("pii_types") > 0).alias("pii_masked"), F.array_join("pii_types", ",").alias("pii_types_found"), "quality_score",
    )


def quarantine(rows: DataFrame) -> DataFrame:
    """Rows of classified() that don't, with the reason."""
    return rows.where("reason is not null").select("bronze_id", "ingestion_batch_id", "reason", "raw_content")


def mark_duplicates(silver_rows: DataFrame) -> DataFrame:
    """Fills is_duplicate and duplicate_of from the first row of equal date, description, amounts and vendor."""
    key = S.row_hash(F.col("transaction_date"), F.col("description"), F.col("net_amount"), F.col("vendor"), F.lit(""))
    first = silver_rows.withColumn("k", key).groupBy("k").agg(F.min("silver_id").alias("first"))
    marked = silver_rows.withColumn("k", key).join(first, "k").drop("k")
    return marked.withColumn("is_duplicate", F.col("silver_id") != F.col("first")).withColumn("duplicate_of", F.when(F.col("is_duplicate"), F.col("first"))).drop("first")


def unpromoted(silver_rows: DataFrame, gold_rows: DataFrame, batch: str | None = None) -> DataFrame:
    """Silver rows, of one batch on request, that aren't in gold yet."""
    rows = silver_rows if batch is None else silver_rows.where(F.col("ingestion_batch_id") == batch)
    return rows.join(gold_rows.select("silver_id"), "silver_id", "left_anti")


def eligible(least: float = GOLD_LEAST) -> Column:
    """Of a silver row: it goes to gold."""
    return (F.coalesce("quality_score", F.lit(0.0)) >= least) & F.col("transaction_date").isNotNull()


def promoted(rows: DataFrame, least: float = GOLD_LEAST) -> DataFrame:
    """Silver rows with a score of at least `least`, as gold rows."""
    good = rows.where(eligible(least))
    tax = S.tax_class(F.col("category"))
    return good.select(
        "silver_id", "bronze_id", "transaction_date", "year_month", "fiscal_year", "description_masked", "vendor", "category", F.when(F.col("category").isNotNull(), 0.9).otherwise(0.5).alias("category_confidence"), "amount_debit", "amount_credit", "net_amount", "currency",
        S.embedding_text(F.col("transaction_date"), F.col("amount_debit"), F.col("amount_credit"), F.col("currency"), F.col("vendor"), F.col("category")).alias("embedding_text"), tax.alias("fbr_category"), tax.isNotNull().alias("fbr_tax_applicable"), "quality_score",
    )


def monthly(rows: DataFrame, tenant: str | None = None, limit: float = 50.0) -> DataFrame:
    """Income, expenses, net and count of each month, the change against the month before that is present, and an anomaly flag.

    rows: year_month, fiscal_year, amount_debit, amount_credit and the tenant column. Sums are
    decimal; the window runs over one row a month.
    """
    keys = [tenant] if tenant else []
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))
    per = rows.groupBy(*keys, "year_month", "fiscal_year").agg(money("amount_credit").alias("i"), money("amount_debit").alias("e"), F.count("*").alias("transaction_count"))
    w = Window.partitionBy(*keys).orderBy("year_month") if keys else Window.partitionBy(F.lit(0)).orderBy("year_month")
    net = (F.col("i") - F.col("e")).cast("double")
    told = per.select(*keys, "year_month", "fiscal_year", F.col("i").cast("double").alias("total_income"), F.col("e").cast("double").alias("total_expenses"), net.alias("net_amount"), "transaction_count")
    prior = F.lag("net_amount").over(w)
    change = F.when(prior != 0, F.round((F.col("net_amount") - prior) / F.abs(prior) * 100, 2))
    return told.withColumn("vs_prior_period_pct", change).withColumn("anomaly_flag", F.coalesce(F.abs("vs_prior_period_pct") > limit, F.lit(False)))


def breakdown(rows: DataFrame) -> DataFrame:
    """(year_month, category, total) with missing categories as Uncategorised, and the same as one JSON object a month."""
    name = F.coalesce(S.trimmed(F.col("category")), F.lit("Uncategorised"))
    total = F.sum((F.col("amount_debit") + F.col("amount_credit")).cast("decimal(18,2)")).cast("double")
    return rows.groupBy("year_month", name.alias("category")).agg(total.alias("total"))


def breakdown_json(rows: DataFrame) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("category", "total")))
    return breakdown(rows).groupBy("year_month").agg(F.to_json(F.map_from_entries(pairs)).alias("category_breakdown"))


def summaries(rows: DataFrame, tenant: str | None = None) -> DataFrame:
    """monthly() with period bounds."""
    ym = F.col("year_month")
    return monthly(rows, tenant).withColumn("period_type", F.lit("monthly")).withColumn("period_start", S.period_start(ym)).withColumn("period_end", S.period_end(ym))


def full_summaries(rows: DataFrame) -> DataFrame:
    """summaries() with the breakdown of each month by category as one JSON object."""
    return summaries(rows).join(breakdown_json(rows), "year_month", "left")


def lineage(gold_rows: DataFrame, silver_rows: DataFrame, bronze_rows: DataFrame) -> DataFrame:
    """gold -> silver -> bronze by id."""
    return gold_rows.select("silver_id", "embedding_text").join(silver_rows.select("silver_id", "bronze_id"), "silver_id").join(bronze_rows.select("bronze_id", "source_file", "source_row_number"), "bronze_id")


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table."""
    frames = [df.agg(F.count("*").alias("row_count")).withColumn("table_name", F.lit(name)) for name, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def layer_statistics(rows: DataFrame, least: float = GOLD_LEAST) -> DataFrame:
    """statistics() of the layers that classified() rows make up, in one pass: its rules run once a row, not once for each layer."""
    good = F.col("reason").isNull()
    counts = {"bronze": F.count("*"), "silver": F.count_if(good), "quarantine": F.count_if(~good), "gold": F.count_if(good & eligible(least))}
    told = rows.agg(*(c.alias(n) for n, c in counts.items()))
    return told.select(F.inline(F.array(*(F.struct(F.col(n).alias("row_count"), F.lit(n).alias("table_name")) for n in counts))))


def batch_counts(rows: DataFrame, least: float = GOLD_LEAST) -> DataFrame:
    """Processed, normalised, quarantined, eligible and average score of each batch of classified()."""
    good = F.col("reason").isNull()
    return rows.groupBy("ingestion_batch_id").agg(
        F.count("*").alias("processed"), F.count_if(good).alias("normalised"), F.count_if(~good).alias("quarantined"), F.count_if(good & (F.col("quality_score") >= least)).alias("eligible"),
        F.round(F.sum(F.when(good, F.round(F.col("quality_score") * 10).cast("long"))) / F.count_if(good) / 10.0, 4).alias("average_quality"),
    )


def file_votes(rows: DataFrame) -> DataFrame:
    """The order of day and month that the dates of each source_file of bronze rows tell."""
    read = settled(settled(rows.select("source_file", "raw_content"), fields=fields_of(F.col("raw_content"))), date_text=F.trim(part_field(F.col("fields"), fixed.DATE_PARTS)))
    return dates.votes(read, "date_text", ["source_file"])


def file_rows(rows: DataFrame) -> DataFrame:
    """The file-to-gold variant: keys by part, debit unless the type says credit, its own masks and keywords.

    Dates are read day first, or as a column date_order of the rows says.
    """
    m = F.col("fields")
    parsed = settled(rows, fields=fields_of(F.col("raw_content")))
    whole = {f"{k}_text": F.try_element_at(m, F.lit(k)) for k in ("debit", "dr", "credit", "cr")}
    parts = {"date_text": fixed.DATE_PARTS, "description": fixed.DESCRIPTION_PARTS, "vendor": fixed.VENDOR_PARTS, "amount_text": fixed.AMOUNT_PARTS, "type_text": fixed.TYPE_PARTS}
    named = settled(parsed, **whole, **{n: F.trim(part_field(m, p)) for n, p in parts.items()})
    side = lambda keys: F.abs(F.coalesce(*(F.nullif(S.parse_amount_or_zero(F.col(f"{k}_text")), F.lit(0.0)) for k in keys), F.lit(0.0)))
    masked, kinds = S.mask(F.col("description"), "pipeline")
    text = F.col("date_text")
    read_date = dates.parse(text, F.col("date_order"), fixed.SHORT_DATE_FORMATS) if "date_order" in rows.columns else S.parse_date(text, fixed.SHORT_DATE_FORMATS)
    base = settled(
        named, transaction_date=read_date, d=side(("debit", "dr")), c=side(("credit", "cr")), a=F.abs(S.parse_amount_or_zero(F.col("amount_text"))),
        is_credit=F.contains(F.lower(F.coalesce("type_text", F.lit(""))), F.lit("credit")), description_masked=masked, pii_types=kinds, category=S.keyword_category(F.coalesce("description", F.lit("")))["category"],
    )
    explicit = (F.col("d") != 0) | (F.col("c") != 0)
    money = settled(base, amount_debit=F.when(explicit, F.col("d")).when(~F.col("is_credit"), F.col("a")).otherwise(0.0), amount_credit=F.when(explicit, F.col("c")).when(F.col("is_credit"), F.col("a")).otherwise(0.0))
    said = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    score = S.quality_score(F.col("transaction_date").isNotNull(), (F.col("amount_debit") != 0) | (F.col("amount_credit") != 0), said("description"), said("vendor"), F.size("pii_types") > 0)
    scored = settled(money, quality_score=score)
    judged = settled(scored, reason=F.when(F.col("transaction_date").isNull(), "date_parse_failed").when(F.col("quality_score") < SILVER_LEAST, "low_quality_score"))
    return judged.drop(*whole, "date_text", "amount_text", "type_text")


def file_gold(rows: DataFrame) -> DataFrame:
    """Gold rows of file_rows()."""
    sentence = S.embedding_text(F.col("transaction_date"), F.col("amount_debit"), F.col("amount_credit"), F.lit("PKR"), F.col("vendor"), F.col("category"), "pipeline")
    good = rows.where((F.col("quality_score") >= GOLD_LEAST) & F.col("reason").isNull())
    tax = F.col("tax")
    good = settled(good, tax=S.keyword_category(F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("category", F.lit("")))))
    return good.select(
        "bronze_id", "ingestion_batch_id", "transaction_date", S.year_month(F.col("transaction_date")).alias("year_month"), S.fiscal_year(F.col("transaction_date")).alias("fiscal_year"), "description_masked", "vendor", "category",
        F.when(F.col("category").isNotNull(), 0.9).otherwise(0.5).alias("category_confidence"), "amount_debit", "amount_credit", sentence.alias("embedding_text"), tax["category"].alias("fbr_category"), tax["taxable"].alias("fbr_tax_applicable"), "quality_score",
    )
