"""Registered queries of the ledger engine: a function for Spark and SQL for DuckDB, side by side.

All run over the whole ledger of adapter.ledger(), its raw form adapter.bronze(), or the tables as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from ..operators import dates, gates, mapping, membership, metadata, privacy, tax, tenants
from ..operators import ledger as L
from ..operators import medallion as M
from ..sources import files, stores
from ..streaming import watch
from . import adapter as A
from . import periods

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ordered_case(pairs, other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {value}" for cond, value in pairs) + f" ELSE {other} END"


# Scalar functions --------------------------------------------------------------------------------


@registered("f1_parse_date", f"{A.LEDGER} SELECT row_id, strftime({A.date_sql('raw_date')}, '%Y-%m-%d') AS d8, strftime({A.date_sql('raw_date', A.SHORT_FORMATS)}, '%Y-%m-%d') AS d4 FROM ledger")
def f1(spark, d):
    """dates by eight and by four formats."""
    date = lambda f: F.date_format(S.parse_date(F.col("raw_date"), f), "yyyy-MM-dd")
    return A.ledger(spark, d).select("row_id", date(fixed.DATE_FORMATS).alias("d8"), date(fixed.SHORT_DATE_FORMATS).alias("d4"))


@registered("f4_parse_amount", f"{A.LEDGER} SELECT row_id, {A.amount_sql('raw_amount')} AS silver, {A.gate_amount_sql('raw_amount')} AS gate, {A.zero_amount_sql('raw_amount')} AS pipeline FROM ledger")
def f4(spark, d):
    """amounts by the three rules."""
    c = F.col("raw_amount")
    return A.ledger(spark, d).select("row_id", S.parse_amount(c).alias("silver"), S.parse_amount_gate(c).alias("gate"), S.parse_amount_or_zero(c).alias("pipeline"))


@registered(
    "f7_periods",
    f"""{A.LEDGER} SELECT row_id, {A.fiscal_sql("txn_date")} AS fiscal_year, strftime(txn_date, '%Y-%m') AS year_month, strftime(date_trunc('month', txn_date), '%Y-%m-%d') AS period_start,
        strftime(last_day(txn_date), '%Y-%m-%d') AS period_end, strftime(txn_date, '%-d %b %Y') AS human, strftime(txn_date, '%d %b %Y') AS padded FROM ledger""",
)
def f7(spark, d):
    """Fiscal year, month, period bounds, dates for people."""
    c, ym = F.col("txn_date"), S.year_month(F.col("txn_date"))
    ends = F.date_format(S.period_start(ym), "yyyy-MM-dd").alias("period_start"), F.date_format(S.period_end(ym), "yyyy-MM-dd").alias("period_end")
    return A.ledger(spark, d).select("row_id", S.fiscal_year(c).alias("fiscal_year"), ym.alias("year_month"), *ends, S.human_date(c).alias("human"), S.human_date(c, padded=True).alias("padded"))


URDU_SQL = "[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]"


def language_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{URDU_SQL}') AND regexp_matches({x}, '[a-zA-Z]') THEN 'mixed' WHEN regexp_matches({x}, '{URDU_SQL}') THEN 'ur' ELSE 'en' END"


@registered("f10_language", f"{A.LEDGER} SELECT row_id, {language_sql('description')} AS language FROM ledger")
def f10(spark, d):
    return A.ledger(spark, d).select("row_id", S.language(F.col("description")).alias("language"))


def masked_sql(x: str, rules) -> tuple[str, str]:
    kinds, now = [], f"coalesce({x}, '')"
    for name, pattern, mark in rules:
        kinds.append(f"CASE WHEN regexp_matches({now}, {q(pattern)}) THEN '{name}' END")
        now = f"regexp_replace({now}, {q(pattern)}, {q(mark)}, 'g')"
    return now, f"array_to_string(list_filter(list_distinct([{', '.join(kinds)}]), lambda v: v IS NOT NULL).list_sort(), ',')"


_silver, _silver_kinds = masked_sql("description", fixed.SILVER_MASKS)
_pipe, _pipe_kinds = masked_sql("description", fixed.PIPELINE_MASKS)


@registered("f11_masks", f"{A.LEDGER} SELECT row_id, {_silver} AS silver, {_silver_kinds} AS silver_types, {_pipe} AS pipeline, {_pipe_kinds} AS pipeline_types FROM ledger")
def f11(spark, d):
    """masks of the silver step and of the file-to-gold job."""
    (a, b), (x, y) = S.mask(F.col("description")), S.mask(F.col("description"), "pipeline")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return A.ledger(spark, d).select("row_id", a.alias("silver"), joined(b).alias("silver_types"), x.alias("pipeline"), joined(y).alias("pipeline_types"))


#: The patterns as DuckDB's engine can write them, for tests of a text, and with word ends in place of look-around, for
#: lists of matches: in the ledger a match never touches a letter or another digit.
RE2 = {
    "CNIC": r"\b[0-9]{5}-[0-9]{7}-[0-9]\b", "PHONE": r"(?:^|[^0-9])(?:\+92|0092|92)?[-.\s]?3[0-9]{2}[-.\s]?[0-9]{7}|\b0[0-9]{2,3}[-.\s]?[0-9]{6,7}\b", "EMAIL": fixed.PII_PATTERNS["EMAIL"].removeprefix("(?U)"), "IBAN": fixed.PII_PATTERNS["IBAN"].removeprefix("(?U)"),
    "ACCOUNT_NO": r"(?:^|[^0-9])[0-9]{8,16}(?:[^0-9]|$)", "ADDRESS": fixed.PII_PATTERNS["ADDRESS"].replace("(?Ui)", "(?i)"),
}
LISTED = RE2 | {"PHONE": r"\b(?:\+92|0092|92)?[-.\s]?3[0-9]{2}[-.\s]?[0-9]{7}|\b0[0-9]{2,3}[-.\s]?[0-9]{6,7}\b", "ACCOUNT_NO": r"\b[0-9]{8,16}\b"}


def matches_sql(table: str, keep: str, head: str) -> str:
    """SQL of a table `told` with lists of matches, their JSON, and the masked fields of a table."""
    pairs = [(f, k) for f in fixed.PII_FIELDS for k in LISTED]
    lists = ", ".join(f"regexp_extract_all(coalesce({f}, ''), {q(LISTED[k])}) AS {f}_{k}" for f, k in pairs)
    base = lambda f, k: " + ".join(["0", *(f"len({g}_{k})" for g in fixed.PII_FIELDS[: fixed.PII_FIELDS.index(f)])])
    one = lambda f, k: f"""list_transform({f}_{k}, lambda x, i: '{{"type":"{k}","original":"' || x || '","token":"[{k}_' || (i + {base(f, k)}) || ']","field":"{f}"}}')"""
    found = "[]::VARCHAR[]"
    for f, k in pairs:
        found = f"list_concat({found}, {one(f, k)})"

    def masked(f: str) -> str:
        now = f
        for k in LISTED:  # a field holds at most two matches of a type here
            for i in (1, 2):
                now = f"replace({now}, coalesce({f}_{k}[{i}], '<no match>'), '[{k}_' || ({base(f, k)} + {i}) || ']')"
        return f"{now} AS {f}"

    types = ", ".join(f"CASE WHEN {' OR '.join(f'len({f}_{k}) > 0' for f in fixed.PII_FIELDS)} THEN '{k}' END" for k in sorted(LISTED))
    total = " + ".join(f"len({f}_{k})" for f, k in pairs)
    return f"""{head}, lists AS (SELECT *, {lists} FROM {table}),
    told AS (SELECT {keep}, {", ".join(map(masked, fixed.PII_FIELDS))}, '[' || array_to_string({found}, ',') || ']' AS matches, {total} > 0 AS has_pii,
             array_to_string(list_filter([{types}], lambda v: v IS NOT NULL), ',') AS types, CAST({total} AS INTEGER) AS redactions FROM lists)"""


@registered("f13_pii_matches", matches_sql("ledger", "row_id", A.LEDGER) + " SELECT * FROM told")
def f13(spark, d):
    """matches with numbered tokens, masked fields and a summary of each row."""
    done = privacy.mask_rows(privacy.scan(A.ledger(spark, d))).withColumn("s", S.pii_summary(F.col("pii")))
    return done.select("row_id", "description", "party_name", "reference", F.to_json("pii").alias("matches"), "s.has_pii", F.array_join("s.types", ",").alias("types"), "s.redactions")


def pii_report_sql(table: str, fields: list[str], head: str = "") -> str:
    hit = lambda f, k: f"coalesce(regexp_matches({f}, {q(RE2[k])}), false)"
    kind = lambda k: "(" + " OR ".join(hit(f, k) for f in fields) + ")"
    any_ = "(" + " OR ".join(map(kind, RE2)) + ")"
    listed = lambda pairs: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN bool_or({c}) THEN {q(n)} END" for n, c in sorted(pairs)) + "], lambda v: v IS NOT NULL), ',')"
    return f"""{head} SELECT count(*) AS rows_scanned, count(*) FILTER ({any_}) AS rows_with_pii, round(100.0 * count(*) FILTER ({any_}) / count(*), 1) AS pii_percentage,
        {listed([(k, kind(k)) for k in RE2])} AS pii_types_detected, {listed([(f, "(" + " OR ".join(hit(f, k) for k in RE2) + ")") for f in fields])} AS flagged_columns FROM {table}"""


@registered("a9_pii_report", pii_report_sql("ledger", ["description", "party_name", "reference"], A.LEDGER))
def a9(spark, d):
    return privacy.report(A.ledger(spark, d))


@registered("a9_pii_report_documents", pii_report_sql("documents", ["text"]))
def a9_documents(spark, d):
    return privacy.report(spark.read.parquet(f"{d}/documents.parquet").select("text"), ["text"])


HASH_SQL = "sha256(strftime(txn_date, '%Y-%m-%d 00:00:00') || '|' || lower(trim(description)) || '|' || format('{:.2f}', amount) || '|' || lower(trim(coalesce(party_name, ''))) || '|' || lower(trim(coalesce(reference, ''))))"


@registered("f17_row_hash", f"{A.LEDGER} SELECT row_id, {HASH_SQL} AS row_hash FROM ledger")
def f17(spark, d):
    return A.ledger(spark, d).select("row_id", L.ledger_key().alias("row_hash"))


CURRENCY_SQL = "CASE " + " ".join(f"WHEN upper(trim(currency)) = {q(k)} THEN {q(v)}" for k, v in fixed.CURRENCIES.items()) + " ELSE upper(trim(currency)) END"


@registered("f19_currency", f"{A.LEDGER} SELECT row_id, {CURRENCY_SQL} AS currency FROM ledger")
def f19(spark, d):
    return A.ledger(spark, d).select("row_id", S.currency(F.col("currency")).alias("currency"))


def neutral_sql(x: str) -> str:
    dangerous = " OR ".join(f"regexp_matches({x}, {q(p)})" for p in fixed.FORMULAS)
    numeric = f"regexp_matches(translate(trim({x}), ', ', ''), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')"
    return f"CASE WHEN {dangerous} OR regexp_matches({x}, '^[=@\\t\\r]') OR (regexp_matches({x}, '^[+-]') AND NOT {numeric}) THEN '{fixed.FORMULA_MARK}' || {x} ELSE {x} END"


@registered("f20_formulas", f"{A.LEDGER} SELECT row_id, left({neutral_sql('description')}, 20) AS description, {neutral_sql('raw_amount')} AS raw_amount FROM ledger")
def f20(spark, d):
    """formulas marked and cells cut, here to 20 characters."""
    df = A.ledger(spark, d)
    return df.select("row_id", F.left(S.neutralised(F.col("description")), F.lit(20)).alias("description"), S.neutralised(F.col("raw_amount")).alias("raw_amount"))


@registered("f20_formulas_documents", f"SELECT doc_id, {neutral_sql('text')} <> text AS changed, length({neutral_sql('text')}) AS n FROM documents")
def f20_documents(spark, d):
    cell = S.neutralised(F.col("text"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", (cell != F.col("text")).alias("changed"), F.length(cell).cast("long").alias("n"))


@registered("f23_gate_warnings", f"""{A.LEDGER} SELECT row_id, 'formula' AS rule, 'description' AS "column" FROM ledger WHERE {neutral_sql("description")} <> description
    UNION ALL SELECT row_id, 'formula', 'raw_amount' FROM ledger WHERE {neutral_sql("raw_amount")} <> raw_amount UNION ALL SELECT row_id, 'length', 'description' FROM ledger WHERE length(description) > 30""")
def f23(spark, d):
    return gates.warnings(A.ledger(spark, d).select(F.col("row_id"), "description", "raw_amount"), "row_id", most=30)


@registered("f24_amount_text", f"{A.LEDGER} SELECT row_id, 'PKR ' || format('{{:,.0f}}', amount) AS amount_text FROM ledger")
def f24(spark, d):
    return A.ledger(spark, d).select("row_id", S.amount_text(F.col("amount"), F.lit("PKR")).alias("amount_text"))


def keyword_sql(x: str, part: str) -> str:
    return ordered_case([(f"contains(lower({x}), '{w}')", q(c) if part == "category" else str(t).lower()) for w, c, t in fixed.KEYWORD_CATEGORIES], "NULL" if part == "category" else "false")


def tax_class_sql(x: str) -> str:
    return ordered_case([(" OR ".join(f"contains(lower({x}), '{w}')" for w in ws), q(n)) for ws, n in fixed.TAX_CLASSES])


@registered("f27_tax_class", f"{A.LEDGER} SELECT row_id, {tax_class_sql('category')} AS tax_class, {keyword_sql('description', 'category')} AS keyword_category, {keyword_sql('description', 'taxable')} AS taxable, CASE WHEN {keyword_sql('description', 'category')} IS NULL THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM ledger")
def f27(spark, d):
    """tax class, keyword category and its confidence."""
    k = S.keyword_category(F.col("description"))
    return A.ledger(spark, d).select("row_id", S.tax_class(F.col("category")).alias("tax_class"), k["category"].alias("keyword_category"), k["taxable"].alias("taxable"), F.when(k["category"].isNull(), 0.5).otherwise(0.9).alias("confidence"))


_SIDES = "CASE WHEN direction = 'debit' THEN amount ELSE 0 END AS amount_debit, CASE WHEN direction = 'credit' THEN amount ELSE 0 END AS amount_credit"


def sentence_sql(style: str, date: str = "txn_date", category: str = "category", vendor: str = "party_name") -> str:
    money = "format('{:,.0f}', CASE WHEN amount_debit > 0 THEN amount_debit ELSE amount_credit END)"
    paid = "CASE WHEN amount_debit > 0 THEN 'paid to ' ELSE 'received from ' END"
    if style == "pipeline":
        return f"'On ' || coalesce(strftime({date}, '%d %b %Y'), 'Unknown date') || ', PKR ' || {money} || ' was ' || {paid} || coalesce({vendor}, 'unknown') || ' — ' || coalesce({category}, 'uncategorised')"
    who = f"coalesce({paid} || nullif({vendor}, ''), CASE WHEN amount_debit > 0 THEN 'debited' ELSE 'credited' END)"
    return f"'On ' || coalesce(strftime({date}, '%-d %b %Y'), 'Unknown date') || ', PKR ' || {money} || ' was ' || {who} || coalesce(' — ' || nullif({category}, ''), '')"


@registered("f26_embedding_text", f"{A.LEDGER}, s AS (SELECT *, {_SIDES} FROM ledger) SELECT row_id, {sentence_sql('gold')} AS gold, {sentence_sql('pipeline')} AS pipeline FROM s")
def f26(spark, d):
    df = sides(A.ledger(spark, d))
    args = [F.col(c) for c in ("txn_date", "amount_debit", "amount_credit")], [F.col("party_name"), F.col("category")]
    return df.select("row_id", S.embedding_text(*args[0], F.lit("PKR"), *args[1]).alias("gold"), S.embedding_text(*args[0], F.lit("PKR"), *args[1], "pipeline").alias("pipeline"))


@registered("f31_quantised", """WITH x AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18, 4)) / 8 AS DECIMAL(38, 8)) AS v FROM lineitem),
    y AS (SELECT *, CAST(floor(v * 100) AS BIGINT) AS low, v * 100 - floor(v * 100) AS rest FROM x)
    SELECT l_orderkey, l_linenumber, CAST(low + CASE WHEN rest > 0.5 OR (rest = 0.5 AND low % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 100 AS amount FROM y""")
def f31(spark, d):
    """amounts to two places, half to even; an eighth of a price has ties."""
    df = spark.read.parquet(f"{d}/lineitem.parquet")
    eighth = F.col("l_extendedprice").cast("decimal(18,4)") / F.lit(8).cast("decimal(1,0)")
    return df.select("l_orderkey", "l_linenumber", S.quantised(eighth.cast("string")).cast("double").alias("amount"))


@registered("f22_nfc", "SELECT doc_id, md5(nfc_normalize(text)) AS digest, nfc_normalize(text) <> text AS changed FROM documents")
def f22(spark, d):
    """texts in Unicode NFC."""
    c = gates.nfc_column(F.col("text"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", c.alias("n")).select("doc_id", F.md5("n").alias("digest"), (F.col("n") != F.col("text")).alias("changed"))


@registered("f32_encryption", "SELECT c_custkey, c_name AS name, true AS changed, octet_length(encode(c_name)) + 28 AS sealed_bytes FROM customer")
def f32(spark, d):
    """F32: a column encrypted under each tenant's key and read back."""
    df = spark.read.parquet(f"{d}/customer.parquet")
    sealed = df.withColumn("sealed", S.encrypted(F.col("c_name"), "demonstration", F.col("c_nationkey")))
    return sealed.select("c_custkey", S.decrypted(F.col("sealed"), "demonstration", F.col("c_nationkey")).alias("name"), (F.col("sealed") != F.col("c_name")).alias("changed"), F.octet_length(F.unbase64("sealed")).cast("long").alias("sealed_bytes"))


# Projections, filters, canonical frame -----------------------------------------------------------


def sides(df: DataFrame) -> DataFrame:
    side = lambda s: F.when(F.col("direction") == s, F.col("amount")).otherwise(0.0)
    return df.withColumn("amount_debit", side("debit")).withColumn("amount_credit", side("credit")).withColumn("year_month", S.year_month(F.col("txn_date"))).withColumn("fiscal_year", S.fiscal_year(F.col("txn_date")))


@registered("p1_slug", "SELECT DISTINCT p_type, trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def p1(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_type").distinct().select("p_type", S.slug(F.col("p_type")).alias("slug"))


def _raw(spark, d) -> DataFrame:
    df = A.ledger(spark, d)
    return df.select("row_id", F.col("raw_date").alias("Posting Date"), F.col("description").alias("Particulars"), F.col("party_name").alias("Vendor"), F.col("reference").alias("Invoice No"), F.when(F.col("direction") == "debit", F.col("amount")).otherwise(-F.col("amount")).alias("Amt"), F.col("currency").alias("CCY"))


@registered("p3_mapping_preview", "SELECT * FROM (VALUES ('amount', 'Amt'), ('credit', NULL), ('currency', 'CCY'), ('debit', NULL), ('description', 'Particulars'), ('party_name', 'Vendor'), ('reference', 'Invoice No'), ('txn_date', 'Posting Date')) t(field, header), (SELECT count(*) AS n_rows FROM (SELECT unnest(CASE WHEN o_orderkey % 50 = 0 THEN [1, 2] ELSE [1] END) FROM orders JOIN customer ON o_custkey = c_custkey))")
def p3(spark, d):
    """Which header feeds which canonical field of the raw ledger."""
    raw = L.require
    df = _raw(spark, d)
    raw(L.rename(df))
    found = sorted(L.detect_columns(df.columns).items())
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.inline(F.array(*(F.struct(F.lit(k).alias("field"), F.lit(v).cast("string").alias("header")) for k, v in found))))


_CANON = f"""{A.LEDGER}, c AS (SELECT row_id, {A.date_sql("raw_date")} AS txn_date, description, party_name, reference, amount, CASE WHEN direction = 'debit' THEN 'debit' ELSE 'credit' END AS direction, upper(trim(currency)) AS currency FROM ledger)"""


@registered("c1_normalise", f"{_CANON} SELECT strftime(txn_date, '%Y-%m-%d') AS txn_date, description, party_name, reference, amount, direction, currency FROM c WHERE txn_date IS NOT NULL AND amount > 0")
def c1(spark, d):
    """C1 (P1, P2, P4-P7): raw headers to the canonical ledger."""
    return L.normalise(_raw(spark, d).drop("row_id")).withColumn("txn_date", F.date_format("txn_date", "yyyy-MM-dd"))


_VOTED = f"""{A.LEDGER}, w AS (SELECT row_id, file, k, txn_date AS d FROM ledger),
    t AS (SELECT row_id, file, CASE WHEN k % 4 = 0 OR (k % 4 = 3 AND k % 7 <> 0) THEN strftime(d, '%m/%d/%Y') WHEN k % 4 = 2 THEN strftime(make_date(year(d), month(d), (day(d) - 1) % 12 + 1), '%d/%m/%Y') WHEN k % 4 = 3 AND k % 14 = 7 THEN strftime(d, '%Y-%m-%d') ELSE strftime(d, '%d/%m/%Y') END AS x FROM w),
    p AS (SELECT *, CAST(try_strptime(x, '%d/%m/%Y') AS DATE) AS a, CAST(try_strptime(x, '%m/%d/%Y') AS DATE) AS b, CAST(try_strptime(x, '%Y-%m-%d') AS DATE) AS c FROM t),
    v AS (SELECT file, count(b) > count(a) AS month_first FROM p GROUP BY file)"""


@registered("f3_inferred_dates", f"{_VOTED} SELECT row_id, CASE WHEN month_first THEN 'mdy' ELSE 'dmy' END AS date_order, strftime(CASE WHEN month_first THEN coalesce(b, a, c) ELSE coalesce(a, b, c) END, '%Y-%m-%d') AS txn_date FROM p JOIN v USING (file)")
def f3(spark, d):
    """files that write the month first, the day first, dates that tell nothing, or some of each; every file is read by the order of most."""
    df, k, at = A.ledger(spark, d), F.col("k"), F.col("txn_date")
    vague = F.make_date(F.year(at), F.month(at), (F.dayofmonth(at) - 1) % 12 + 1)
    text = (
        F.when((k % 4 == 0) | ((k % 4 == 3) & (k % 7 != 0)), F.date_format(at, "MM/dd/yyyy")).when(k % 4 == 2, F.date_format(vague, "dd/MM/yyyy"))
        .when((k % 4 == 3) & (k % 14 == 7), F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "dd/MM/yyyy"))
    )
    return dates.inferred(df.select("row_id", "file", text.alias("text")), "text", ["file"]).select("row_id", "date_order", day("txn_date"))


@registered("p5_debit_credit", f"{A.LEDGER} SELECT row_id, amount, direction FROM ledger")
def p5(spark, d):
    """P5: amount and direction from a debit and a credit column."""
    df = sides(A.ledger(spark, d)).select("row_id", F.col("amount_debit").alias("debit"), F.col("amount_credit").alias("credit"))
    return L.derive_amount(df)


@registered("p6_unusable", f"{_CANON} SELECT count(*) AS rows_total, count(*) FILTER (txn_date IS NULL OR amount <= 0) AS rows_dropped FROM c")
def p6(spark, d):
    df = A.ledger(spark, d).withColumn("txn_date", S.parse_date(F.col("raw_date")))
    return df.agg(F.count("*").alias("rows_total"), F.count_if(~L.usable()).alias("rows_dropped"))


@registered("p13_boundary", f"{A.LEDGER} SELECT org_id, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS total, count(*) AS count FROM ledger GROUP BY org_id")
def p13(spark, d):
    """Columns that may leave; description and party_name are dropped."""
    per = A.ledger(spark, d).groupBy("org_id").agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"), F.count("*").alias("count"), F.max("description").alias("description"), F.max("party_name").alias("party_name"), F.min("k").alias("something_else"))
    return privacy.for_cloud(per)


@registered("p14_reserved_names", "SELECT o_orderkey AS raw_bronze_id, o_orderstatus AS \"raw_Quality_Score\", o_totalprice AS amount FROM orders")
def p14(spark, d):
    df = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("bronze_id"), F.col("o_orderstatus").alias("Quality_Score"), F.col("o_totalprice").alias("amount"))
    return gates.safe_names(df)


@registered("p15_limits", f"{A.LEDGER}, f AS (SELECT file AS path, sum(length(description)) * 40 AS length, count(*) AS n_rows FROM ledger GROUP BY file) SELECT path, n_rows, CASE WHEN length > 400000 THEN 'size' WHEN n_rows > 380 THEN 'rows' END AS blocked_by FROM f")
def p15(spark, d):
    """Files over a size or row limit (small ones here, so that some are)."""
    df = A.ledger(spark, d).withColumnRenamed("file", "path")
    sizes = df.groupBy("path").agg((F.sum(F.length("description")) * 40).alias("length"))
    return gates.admitted(sizes, df.select("path"), max_bytes=400_000, max_rows=380).select("path", "n_rows", "blocked_by")


@registered("p16_listing", f"{A.LEDGER} SELECT row_id, strftime(txn_date, '%Y-%m-%d') AS txn_date, party_name, amount FROM ledger WHERE org_id = 7 AND txn_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND direction = 'debit' AND party_name ILIKE '%customer%1%' AND amount BETWEEN 1000 AND 250000")
def p16(spark, d):
    found = tenants.listing(A.ledger(spark, d), 7, "1996-01-01", "1999-12-31", "debit", "customer%1", 1000.0, 250000.0)
    return found.select("row_id", day("txn_date"), "party_name", "amount")


@registered("p17_point", f"{A.LEDGER} SELECT 'own' AS asked, row_id, org_id, description FROM ledger WHERE org_id = 7 AND row_id = (SELECT max(row_id) FROM ledger WHERE org_id = 7)")
def p17(spark, d):
    """A row asked for by its own org, and by another, which doesn't get it."""
    df = A.ledger(spark, d)
    key = df.where("org_id = 7").agg(F.max("row_id")).first()[0]
    asked = [tenants.point(df, org, key).select(F.lit(name).alias("asked"), "row_id", "org_id", "description") for name, org in (("own", 7), ("other", 8))]
    return asked[0].unionByName(asked[1])


@registered("c3_gate_chain", f"""{A.LEDGER}, f AS (SELECT file AS path, sum(length(description)) * 40 AS length, count(*) AS n_rows FROM ledger GROUP BY file),
    ok AS (SELECT path FROM f WHERE length <= 400000 AND n_rows <= 380)
    SELECT row_id, k AS "raw_bronze_id", left({neutral_sql("nfc_normalize(description)")}, 30) AS description, left({neutral_sql("raw_amount")}, 30) AS raw_amount,
           CAST({neutral_sql("nfc_normalize(description)")} <> nfc_normalize(description) AS INTEGER) + CAST(length(nfc_normalize(description)) > 30 AS INTEGER) + CAST({neutral_sql("raw_amount")} <> raw_amount AS INTEGER) AS n_warnings
    FROM ledger JOIN ok ON path = file""")
def c3(spark, d):
    """C3 (P15, P14, F22, F20, F21, F23): the gates in their order, with small limits."""
    rows = A.ledger(spark, d).select(F.col("file").alias("path"), "row_id", F.col("k").alias("bronze_id"), "description", "raw_amount")
    found = rows.groupBy("path").agg((F.sum(F.length("description")) * 40).alias("length"))
    clean, told, _ = gates.chain(found, rows, "row_id", max_bytes=400_000, max_rows=380, most=30)
    counted = told.groupBy("row_id").agg(F.count("*").alias("n"))
    return clean.drop("path").join(counted, "row_id", "left").withColumn("n_warnings", F.coalesce("n", F.lit(0)).cast("int")).drop("n")


@registered("s7_manifest", "SELECT '/in/' || doc_id || '.csv' AS path, octet_length(encode(text)) AS length, sha256(text) AS sha256, 'csv' AS source_type, 'manual_csv' AS software FROM documents")
def s7(spark, d):
    """A manifest of files, here the documents, with size, hash and kind."""
    found = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".csv")).alias("path"), F.col("text").cast("binary").alias("content"))
    return files.described(found).select("path", F.length("content").cast("long").alias("length"), "sha256", "source_type", "detected.software")


@registered("s2_delimiter", f"""{A.LEDGER}, t AS (SELECT row_id, k, ({A._list((",", ";", "|", chr(9)))})[k % 4 + 1] AS d FROM ledger)
    SELECT row_id, CASE WHEN k % 5 = 4 THEN ',' ELSE d END AS delimiter FROM t""")
def s2(spark, d):
    """Delimiters sniffed from a head of two lines; every fifth file has none."""
    df = A.ledger(spark, d)
    mark = F.when(F.col("k") % 5 == 4, "").otherwise(A._pick(F.col("k"), (",", ";", "|", "\t")))
    head = F.concat(F.lit("Date"), mark, F.lit("Description"), mark, F.lit("Amount\n"), F.lit("1996"), mark, F.lit("Rent paid"), mark, F.col("amount").cast("string"), F.lit("\n"))
    return df.select("row_id", files.delimiter(head).alias("delimiter"))


@registered("p19_suggestions", """WITH s AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'vendor' WHEN 1 THEN 'quality_score' WHEN 2 THEN repeat('x', 51) ELSE 'whatever' END AS target FROM customer)
    SELECT id, target, CASE WHEN length(target) > 50 THEN 'length' WHEN target = 'quality_score' THEN 'reserved' WHEN target = 'whatever' THEN 'unknown target' END AS rejected_because FROM s""")
def p19(spark, d):
    k = F.col("c_custkey")
    target = F.when(k % 4 == 0, "vendor").when(k % 4 == 1, "quality_score").when(k % 4 == 2, F.repeat(F.lit("x"), 51)).otherwise("whatever")
    asked = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), target.alias("target"))
    return mapping.validated(asked, mapping.dictionary(spark).select("target"))


# Cleaning ----------------------------------------------------------------------------------------


@registered("w3_keep_first", f"{A.LEDGER} SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY {HASH_SQL} ORDER BY row_id) AS n FROM ledger) WHERE n = 1")
def w3(spark, d):
    return L.keep_first(A.ledger(spark, d), L.ledger_key(), ["row_id"]).select("row_id")


@registered("c2_clean", f"{A.LEDGER} SELECT row_id, description, coalesce(party_name, 'Unknown') AS party_name, {CURRENCY_SQL} AS currency FROM (SELECT *, row_number() OVER (PARTITION BY {HASH_SQL} ORDER BY row_id) AS n FROM ledger) WHERE n = 1")
def c2(spark, d):
    """C2 (F17, W3, F18, F19)."""
    return L.clean(A.ledger(spark, d), ["row_id"]).select("row_id", "description", "party_name", "currency")


@registered("a10_cleaning_report", f"""{A.LEDGER}, f AS (SELECT *, {CURRENCY_SQL} AS code, row_number() OVER (PARTITION BY {HASH_SQL} ORDER BY row_id) AS n FROM ledger)
    SELECT count(*) AS rows_before, count(*) FILTER (n > 1) AS duplicates, count(*) FILTER (n = 1) AS rows_after, count(*) FILTER (n = 1 AND trim(description) = '') AS filled_descriptions,
           count(*) FILTER (n = 1 AND party_name IS NULL) AS filled_parties, count(*) FILTER (n = 1 AND code <> currency) AS currencies_changed FROM f""")
def a10(spark, d):
    return L.cleaning_report(A.ledger(spark, d))


# Metadata ----------------------------------------------------------------------------------------

_IN, _OUT = "CASE WHEN direction = 'credit' THEN amount END", "CASE WHEN direction = 'debit' THEN amount END"


@registered("a3_totals", f"{A.LEDGER} SELECT {A.money_sql(_IN)} AS income, {A.money_sql(_OUT)} AS expenses, count(*) AS transaction_count, round({A.money_sql(_IN)} - {A.money_sql(_OUT)}, 2) AS net FROM ledger")
def a3(spark, d):
    return metadata.totals(A.ledger(spark, d))


@registered("a4_averages", f"{A.LEDGER} SELECT round({A.money_sql('amount')} / count(*), 2) AS avg_transaction, round({A.money_sql(_IN)} / count({_IN}), 2) AS avg_income, round({A.money_sql(_OUT)} / count({_OUT}), 2) AS avg_expense FROM ledger")
def a4(spark, d):
    return metadata.averages(A.ledger(spark, d))


@registered("a5_trends", f"{A.LEDGER} SELECT strftime(txn_date, '%Y-%m') AS month, coalesce({A.money_sql(_IN)}, 0) AS income, coalesce({A.money_sql(_OUT)}, 0) AS expenses, count(*) AS count, round(coalesce({A.money_sql(_IN)}, 0) - coalesce({A.money_sql(_OUT)}, 0), 2) AS net FROM ledger GROUP BY 1")
def a5(spark, d):
    return metadata.trends(A.ledger(spark, d))


@registered("a6_top_parties", f"{A.LEDGER} SELECT party_name, {A.money_sql('amount')} AS total, count(*) AS count FROM ledger WHERE party_name IS NOT NULL GROUP BY 1 ORDER BY total DESC, party_name LIMIT 10")
def a6(spark, d):
    return metadata.top_parties(A.ledger(spark, d))


@registered("a7_categories", f"{A.LEDGER} SELECT category, {A.money_sql('amount')} AS total, count(*) AS count FROM ledger WHERE category IS NOT NULL GROUP BY 1")
def a7(spark, d):
    return metadata.categories(A.ledger(spark, d))


@registered("c9_metadata_document", f"""{A.LEDGER}, m AS (SELECT strftime(txn_date, '%Y-%m') AS month, coalesce({A.money_sql(_IN)}, 0) AS income, coalesce({A.money_sql(_OUT)}, 0) AS expenses, count(*) AS n FROM ledger GROUP BY 1),
    p AS (SELECT party_name, {A.money_sql("amount")} AS total, count(*) AS n FROM ledger WHERE party_name IS NOT NULL GROUP BY 1 ORDER BY total DESC, party_name LIMIT 10)
    SELECT 'totals' AS part, NULL AS month, {A.money_sql(_IN)} AS income, {A.money_sql(_OUT)} AS expenses, round({A.money_sql(_IN)} - {A.money_sql(_OUT)}, 2) AS net, count(*) AS n, NULL::DOUBLE AS total FROM ledger
    UNION ALL SELECT 'averages', NULL, round({A.money_sql(_IN)} / count({_IN}), 2), round({A.money_sql(_OUT)} / count({_OUT}), 2), NULL, NULL, round({A.money_sql("amount")} / count(*), 2) FROM ledger
    UNION ALL SELECT 'trends', month, income, expenses, round(income - expenses, 2), n, NULL FROM m
    UNION ALL SELECT 'top_parties', NULL, NULL, NULL, NULL, n, total FROM p""")
def c9(spark, d):
    """The metadata document passed through the boundary, all that is left of it: parties lose their names."""
    doc = privacy.for_cloud(metadata.document(A.ledger(spark, d)))

    def line(part, month=None, income=None, expenses=None, net=None, n=None, total=None):
        values = {"month": (month, "string"), "income": (income, "double"), "expenses": (expenses, "double"), "net": (net, "double"), "n": (n, "long"), "total": (total, "double")}
        return F.struct(F.lit(part).alias("part"), *((F.lit(None) if v is None else v).cast(t).alias(k) for k, (v, t) in values.items()))

    t, a = F.col("totals"), F.col("averages")
    own = F.array(line("totals", None, t["income"], t["expenses"], t["net"], t["transaction_count"]), line("averages", None, a["avg_income"], a["avg_expense"], None, None, a["avg_transaction"]))
    months = F.transform("trends", lambda m: line("trends", m["month"], m["income"], m["expenses"], m["net"], m["count"]))
    parties = F.transform("top_parties", lambda p: line("top_parties", None, None, None, None, p["count"], p["total"]))
    return doc.select(F.inline(F.concat(own, months, parties)))


# Silver, gold, summaries -------------------------------------------------------------------------

_D0, _D1 = "k % 3 = 0", "k % 3 = 1"
_TEXT = lambda side: f"CASE WHEN direction = '{side}' THEN format('{{:.2f}}', amount) ELSE '' END"
SILVER_SQL = f"""{A.LEDGER},
r AS (SELECT *, CASE WHEN k % 97 = 0 THEN 'invalid_json' WHEN k % 89 = 0 THEN 'invalid_json_structure' END AS broken, k % 3 < 2 AND k % 97 <> 0 AND k % 89 <> 0 AS known FROM ledger),
f AS (SELECT row_id, k, broken, known, raw_date, CASE WHEN known THEN {A.date_sql("raw_date")} END AS transaction_date, CASE WHEN known THEN trim(description) END AS description, CASE WHEN known THEN trim(party_name) END AS vendor,
       {A.amount_sql("raw_amount")} AS signed, direction, amount, description AS plain, party_name, raw_amount FROM r),
g AS (SELECT *, CASE WHEN NOT known THEN 0.0 WHEN {_D1} THEN CASE WHEN direction = 'debit' THEN amount ELSE 0.0 END WHEN signed < 0 THEN -signed ELSE 0.0 END AS amount_debit,
       CASE WHEN NOT known THEN 0.0 WHEN {_D1} THEN CASE WHEN direction = 'credit' THEN amount ELSE 0.0 END WHEN signed >= 0 THEN signed ELSE 0.0 END AS amount_credit, {_silver} AS description_masked, {_silver_kinds} AS pii_types_found FROM f),
h AS (SELECT *, ((CASE WHEN transaction_date IS NOT NULL THEN 3 ELSE 0 END) + (CASE WHEN amount_debit <> 0 OR amount_credit <> 0 THEN 3 ELSE 0 END) + (CASE WHEN coalesce(trim(description), '') <> '' THEN 2 ELSE 0 END)
       + (CASE WHEN coalesce(trim(vendor), '') <> '' THEN 1 ELSE 0 END) + (CASE WHEN pii_types_found = '' THEN 1 ELSE 0 END)) / 10.0::DOUBLE AS quality_score FROM g),
s AS (SELECT *, coalesce(broken, nullif(concat_ws('; ', CASE WHEN transaction_date IS NULL THEN 'date_parse_failed' END, CASE WHEN quality_score < 0.3 THEN 'low_quality_score(' || quality_score || ')' END), '')) AS reason,
       CAST(row_id AS VARCHAR) AS bronze_id, 'batch-' || (k % 4) AS ingestion_batch_id, strftime(transaction_date, '%Y-%m') AS year_month, {A.fiscal_sql("transaction_date")} AS fiscal_year,
       {keyword_sql("description", "category")} AS category FROM h)
"""


@registered("c4_silver", f"""{SILVER_SQL} SELECT bronze_id, ingestion_batch_id, strftime(transaction_date, '%Y-%m-%d') AS transaction_date, year_month, fiscal_year, description_masked, vendor, category, amount_debit, amount_credit, amount_credit - amount_debit AS net_amount,
    {language_sql("concat_ws(' ', raw_date, plain, party_name, CASE WHEN k % 3 = 0 THEN raw_amount END)")} AS language_detected, pii_types_found, quality_score FROM s WHERE reason IS NULL""")
def c4(spark, d):
    """C4 (P8, P10, P11, F1, F4, F7, F8, F10, F11, F16, S10): raw JSON rows to silver."""
    out = M.silver(M.classified(A.bronze(spark, d)))
    return out.select("bronze_id", "ingestion_batch_id", day("transaction_date"), "year_month", "fiscal_year", "description_masked", "vendor", "category", "amount_debit", "amount_credit", "net_amount", "language_detected", "pii_types_found", "quality_score")


@registered("p11_quarantine", f"{SILVER_SQL} SELECT bronze_id, ingestion_batch_id, reason FROM s WHERE reason IS NOT NULL")
def p11(spark, d):
    return M.quarantine(M.classified(A.bronze(spark, d))).drop("raw_content")


@registered("a12_batch_counts", f"{SILVER_SQL} SELECT ingestion_batch_id, count(*) AS processed, count(*) FILTER (reason IS NULL) AS normalised, count(*) FILTER (reason IS NOT NULL) AS quarantined, count(*) FILTER (reason IS NULL AND quality_score >= 0.7) AS eligible, round(sum(CASE WHEN reason IS NULL THEN CAST(round(quality_score * 10) AS BIGINT) END) / count(*) FILTER (reason IS NULL) / 10.0::DOUBLE, 4) AS average_quality FROM s GROUP BY 1")
def a12(spark, d):
    return M.batch_counts(M.classified(A.bronze(spark, d)))


GOLD_SQL = f"{SILVER_SQL}, gold AS (SELECT * FROM s WHERE reason IS NULL AND quality_score >= 0.7)"


@registered("c5_gold", f"{GOLD_SQL} SELECT bronze_id, strftime(transaction_date, '%Y-%m-%d') AS transaction_date, category, CASE WHEN category IS NULL THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS category_confidence, {sentence_sql('gold', 'transaction_date', 'category', 'vendor')} AS embedding_text, {tax_class_sql('category')} AS fbr_category, {tax_class_sql('category')} IS NOT NULL AS fbr_tax_applicable, quality_score FROM gold WHERE ingestion_batch_id = 'batch-1'")
def c5(spark, d):
    """C5 (J1, J2, P12, F26, F27, F30): one batch of silver to gold."""
    # silver is a table: its rules run once, not for each side of the join
    s = stores.stored(M.silver(M.classified(A.bronze(spark, d))))
    done = M.promoted(M.unpromoted(s, s.where("ingestion_batch_id <> 'batch-1'"), "batch-1"))
    return done.select("bronze_id", day("transaction_date"), "category", "category_confidence", "embedding_text", "fbr_category", "fbr_tax_applicable", "quality_score")


@registered("j1_unpromoted", f"{SILVER_SQL} SELECT bronze_id FROM s WHERE reason IS NULL AND quality_score < 0.7")
def j1(spark, d):
    s = M.silver(M.classified(A.bronze(spark, d)))
    return M.unpromoted(s, M.promoted(s)).select("bronze_id")


@registered("j7_lineage", f"{GOLD_SQL} SELECT CAST(k % 40 AS VARCHAR) AS file_number, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS row_sum FROM gold GROUP BY 1")
def j7(spark, d):
    """Gold rows traced to their files."""
    b = A.bronze(spark, d)
    s = M.silver(M.classified(b))
    chain = M.lineage(M.promoted(s), s, b)
    return chain.groupBy(F.regexp_extract("source_file", "file-([0-9]+)", 1).alias("file_number")).agg(F.count("*").alias("n"), F.sum("source_row_number").alias("row_sum"))


@registered("s12_statistics", f"{GOLD_SQL} SELECT 'bronze' AS table_name, count(*) AS row_count FROM s UNION ALL SELECT 'silver', count(*) FROM s WHERE reason IS NULL UNION ALL SELECT 'quarantine', count(*) FROM s WHERE reason IS NOT NULL UNION ALL SELECT 'gold', count(*) FROM gold")
def s12(spark, d):
    return M.layer_statistics(M.classified(A.bronze(spark, d)))


def monthly_sql(tenant: str = "") -> str:
    keys, cut = (f"{tenant}, ", f"PARTITION BY {tenant} ") if tenant else ("", "")
    return f"""{A.LEDGER}, m AS (SELECT {keys}strftime(txn_date, '%Y-%m') AS year_month, {A.fiscal_sql("txn_date")} AS fiscal_year, coalesce({A.money_sql(_IN)}, 0) AS total_income, coalesce({A.money_sql(_OUT)}, 0) AS total_expenses,
        CAST(sum(CAST(CASE WHEN direction = 'credit' THEN amount ELSE -amount END AS DECIMAL(18, 2))) AS DOUBLE) AS net_amount, count(*) AS transaction_count FROM ledger GROUP BY {"1, 2, 3" if tenant else "1, 2"}),
    n AS (SELECT *, lag(net_amount) OVER ({cut}ORDER BY year_month) AS prior FROM m),
    v AS (SELECT *, CASE WHEN prior <> 0 THEN round((net_amount - prior) / abs(prior) * 100, 2) END AS vs_prior_period_pct FROM n)
    SELECT {keys}year_month, fiscal_year, total_income, total_expenses, net_amount, transaction_count, vs_prior_period_pct, coalesce(abs(vs_prior_period_pct) > 50, false) AS anomaly_flag"""


@registered("c6_monthly_summaries", monthly_sql() + ", 'monthly' AS period_type, year_month || '-01' AS period_start, strftime(last_day(CAST(year_month || '-01' AS DATE)), '%Y-%m-%d') AS period_end FROM v")
def c6(spark, d):
    """C6 (A1, W1, W2, F9): the months of the ledger."""
    done = M.summaries(sides(A.ledger(spark, d)))
    return done.withColumn("period_start", F.date_format("period_start", "yyyy-MM-dd")).withColumn("period_end", F.date_format("period_end", "yyyy-MM-dd"))


@registered("l5_months_by_batch", monthly_sql() + ", 'monthly' AS period_type, year_month || '-01' AS period_start, strftime(last_day(CAST(year_month || '-01' AS DATE)), '%Y-%m-%d') AS period_end FROM v")
def l5(spark, d):
    """The months of the ledger from what each of its batches adds to them, as jobs keep them."""
    rows = sides(A.ledger(spark, d)).withColumn("ingestion_batch_id", F.concat(F.lit("batch-"), (F.col("k") % 4).cast("string")))
    done = periods.changed(periods.months(periods.partials(rows))).drop("category_breakdown")
    return done.withColumn("period_start", F.date_format("period_start", "yyyy-MM-dd")).withColumn("period_end", F.date_format("period_end", "yyyy-MM-dd"))


@registered("w1_monthly_by_org", monthly_sql("org_id") + " FROM v")
def w1(spark, d):
    """A1, W1, W2 for each tenant."""
    return M.monthly(sides(A.ledger(spark, d)), "org_id")


@registered("a2_breakdown", f"{A.LEDGER} SELECT strftime(txn_date, '%Y-%m') AS year_month, coalesce(nullif(trim(category), ''), 'Uncategorised') AS category, {A.money_sql('amount')} AS total FROM ledger GROUP BY 1, 2")
def a2(spark, d):
    return M.breakdown(sides(A.ledger(spark, d)))


@registered("a2_breakdown_json", f"{A.LEDGER} SELECT strftime(txn_date, '%Y-%m') AS year_month, coalesce(nullif(trim(category), ''), 'Uncategorised') AS category, {A.money_sql('amount')} AS total FROM ledger GROUP BY 1, 2")
def a2_json(spark, d):
    """A2: the JSON object of each month, read back."""
    told = M.breakdown_json(sides(A.ledger(spark, d)))
    return told.select("year_month", F.explode(F.from_json("category_breakdown", "map<string,double>")).alias("category", "total"))


_U = "k % 97 <> 0 AND k % 89 <> 0"
PIPE_SQL = f"""{A.LEDGER},
f AS (SELECT row_id, k, {_U} AS known, CASE WHEN {_U} THEN {A.date_sql("raw_date", A.SHORT_FORMATS)} END AS transaction_date, CASE WHEN {_U} THEN trim(description) END AS description, CASE WHEN {_U} THEN nullif(trim(party_name), '') END AS vendor,
       {A.zero_amount_sql("raw_amount")} AS zero_amount, direction, amount FROM ledger),
g AS (SELECT *, CASE WHEN NOT known THEN 0.0 WHEN k % 3 = 1 THEN CASE WHEN direction = 'debit' THEN amount ELSE 0.0 END ELSE abs(zero_amount) END AS amount_debit, CASE WHEN known AND k % 3 = 1 AND direction = 'credit' THEN amount ELSE 0.0 END AS amount_credit,
       {_pipe} AS description_masked, {_pipe_kinds} AS pii FROM f),
s AS (SELECT *, ((CASE WHEN transaction_date IS NOT NULL THEN 3 ELSE 0 END) + (CASE WHEN amount_debit <> 0 OR amount_credit <> 0 THEN 3 ELSE 0 END) + (CASE WHEN coalesce(description, '') <> '' THEN 2 ELSE 0 END) + (CASE WHEN coalesce(vendor, '') <> '' THEN 1 ELSE 0 END)
       + (CASE WHEN pii = '' THEN 1 ELSE 0 END)) / 10.0::DOUBLE AS quality_score, {keyword_sql("coalesce(description, '')", "category")} AS category FROM g)
"""


@registered("c7_file_gold", f"""{PIPE_SQL} SELECT CAST(row_id AS VARCHAR) AS bronze_id, strftime(transaction_date, '%Y-%m-%d') AS transaction_date, description_masked, vendor, category, amount_debit, amount_credit, {sentence_sql("pipeline", "transaction_date", "category", "vendor")} AS embedding_text,
    {keyword_sql("(coalesce(description, '') || ' ' || coalesce(category, ''))", "category")} AS fbr_category, {keyword_sql("(coalesce(description, '') || ' ' || coalesce(category, ''))", "taxable")} AS fbr_tax_applicable, quality_score FROM s WHERE transaction_date IS NOT NULL AND quality_score >= 0.7""")
def c7(spark, d):
    """C7 (P9, F2, F6, F12, F16, F26, F28, F30): the file-to-gold rules on raw rows."""
    done = M.file_gold(M.file_rows(A.bronze(spark, d)))
    return done.select("bronze_id", day("transaction_date"), "description_masked", "vendor", "category", "amount_debit", "amount_credit", "embedding_text", "fbr_category", "fbr_tax_applicable", "quality_score")


@registered("s9_bronze", "SELECT 'inline' AS source_file, row_number() OVER (ORDER BY o_orderkey) AS source_row_number, '{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}' AS raw_content, '[\"o_orderkey\",\"o_orderstatus\"]' AS raw_headers, 'pending' AS processing_status FROM orders")
def s9(spark, d):
    """Rows verbatim as JSON with row numbers."""
    df = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus")
    return M.bronze(df, "b1", order=["o_orderkey"]).select("source_file", "source_row_number", "raw_content", "raw_headers", "processing_status")


@registered("w5_strip_summary", """WITH t AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderstatus = 'O' THEN 'Grand Total ' ELSE o_orderstatus END AS label FROM orders),
    n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS nth FROM t),
    b AS (SELECT *, max(lower(trim(label)) <> 'grand total') OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS row_seen FROM n)
    SELECT o_custkey, o_orderkey, label FROM b WHERE nth > 5 OR row_seen""")
def w5(spark, d):
    """A customer's orders as a file, rows marked as totals at its foot dropped."""
    df = spark.read.parquet(f"{d}/orders.parquet")
    label = F.when((F.col("o_orderkey") % 3 == 0) | (F.col("o_orderstatus") == "O"), "Grand Total ").otherwise(F.col("o_orderstatus"))
    return files.strip_summary(df.select("o_custkey", "o_orderkey", label.alias("label")), ["label"], "o_custkey", "o_orderkey")


NAMES = ("Tally Prime export.xlsx", "daybook.csv", "QuickBooks_Online.csv", "qb_export.xls", "HBL account statement.pdf", "my bank-statement.csv", "annex-c.xlsx", "sage 50.json", ".hidden.csv", "~$lock.xlsx", "notes.txt", "old.bak", "plain.csv", "plain.pdf", "plain.json", "plain.xlsx")
_NAMED = f"WITH n AS (SELECT c_custkey, '/in/' || c_custkey || '/' || ({A._list(NAMES)})[c_custkey % {len(NAMES)} + 1] AS path FROM customer), b AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) AS ext FROM n)"
_KIND = ordered_case([(f"ext = '{e}'", q(k)) for e, k in fixed.EXTENSIONS.items()])
_RULES = [(f"regexp_matches(name, {q(p)}, 'i')", s, c) for p, s, c in fixed.SOFTWARE] + [(f"({_KIND}) = '{k}'", s, c) for k, (s, c) in fixed.SOFTWARE_BY_TYPE.items()]


def _named(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat(F.lit("/in/"), k.cast("string"), F.lit("/"), A._pick(k, NAMES)).alias("path"))


@registered("s6_admission", f"{_NAMED} SELECT c_custkey, {_KIND} AS source_type, left(name, 1) = '.' OR left(name, 2) = '~$' OR ext IN {fixed.IGNORED_EXTENSIONS} AS ignored FROM b")
def s6(spark, d):
    """Which files are taken in."""
    return _named(spark, d).select("c_custkey", files.source_type(F.col("path")).alias("source_type"), files.ignored(F.col("path")).alias("ignored"))


@registered("s8_software", f"{_NAMED} SELECT c_custkey, {ordered_case([(c, q(s)) for c, s, _ in _RULES])} AS software, CAST({ordered_case([(c, str(p)) for c, _, p in _RULES])} AS DOUBLE) AS confidence FROM b")
def s8(spark, d):
    found = _named(spark, d).withColumn("s", files.software(F.col("path")))
    return found.select("c_custkey", "s.software", "s.confidence")


# Dictionaries ------------------------------------------------------------------------------------

HEADERS = ("Date", "Txn Date", "Particulars", "Vch No.", "تاریخ", "raqam", "Dr Amount", "Memo/Description", "Ref.No", "descripton", "Amout", "Party-Name", "closing balanse", "xyzzy", "Debit (PKR)", "Narration ")
SOFT = ("tally", "quickbooks_desktop", "quickbooks_online", "ledgermax", "manual_csv")
_ASKED = f"WITH a AS (SELECT DISTINCT ({A._list(HEADERS)})[c_custkey % {len(HEADERS)} + 1] AS header, ({A._list(SOFT)})[(c_custkey // {len(HEADERS)}) % {len(SOFT)} + 1] AS software FROM customer),"
_VALUES = ", ".join(f"({q(layer)}, {q(s) if s else 'NULL'}, {q(h)}, {q(t)}, {r})" for layer, s, h, t, r in mapping.entries())
_DICT = f"dict(layer, software, header, target, rank) AS (VALUES {_VALUES})"


def _asked(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", A._pick(k, HEADERS).alias("header"), A._pick(F.floor(k / len(HEADERS)), SOFT).alias("software"))


_ORDER = "CASE layer " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(fixed.LAYER_CONFIDENCE)) + " END"
_EXACT = f"""{_ASKED} {_DICT},
    m AS (SELECT a.header, a.software, d.target, d.layer, d.rank FROM a JOIN dict d ON lower(trim(a.header)) = d.header AND (d.software IS NULL OR d.software = a.software)
          UNION ALL SELECT a.header, a.software, d.target, 'normalised', d.rank FROM a JOIN dict d ON d.layer = 'general' AND regexp_replace(lower(trim(a.header)), '[^a-z0-9]', '', 'g') = regexp_replace(d.header, '[^a-z0-9]', '', 'g') AND regexp_replace(lower(a.header), '[^a-z0-9]', '', 'g') <> ''),
    b AS (SELECT *, row_number() OVER (PARTITION BY header, software ORDER BY {_ORDER}, rank) AS n FROM m)
    SELECT a.header, a.software, b.target, b.layer, CAST(CASE b.layer {" ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.LAYER_CONFIDENCE.items())} END AS DOUBLE) AS confidence FROM a LEFT JOIN b ON a.header = b.header AND a.software = b.software AND b.n = 1"""


@registered("j10_dictionary", _EXACT)
def j10(spark, d):
    return mapping.exact(_asked(spark, d))


@registered("a13_coverage", f"WITH e AS ({_EXACT}) SELECT software, round(avg(CASE WHEN target IS NOT NULL AND confidence >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS coverage FROM e GROUP BY software")
def a13(spark, d):
    return mapping.coverage(mapping.exact(_asked(spark, d)), "software")


_GRAMS = lambda x: f"list_distinct([substr({x}, i, 2) FOR i IN range(1, length({x}))])"


@registered("j11_fuzzy", f"""{_ASKED} {_DICT}, h AS (SELECT DISTINCT header FROM a),
    p AS (SELECT h.header, d.target, d.rank + CASE WHEN d.layer = 'general' THEN 0 ELSE 100000 END AS rank, {_GRAMS("lower(trim(h.header))")} AS g, {_GRAMS("d.header")} AS w FROM h, dict d WHERE d.layer IN ('general', 'software')),
    s AS (SELECT *, len(list_intersect(g, w))::DOUBLE / len(list_distinct(list_concat(g, w))) AS score FROM p WHERE len(g) + len(w) > 0),
    b AS (SELECT *, row_number() OVER (PARTITION BY header ORDER BY score DESC, rank) AS n FROM s WHERE score >= 0.5)
    SELECT h.header, b.target, round(b.score, 6) AS score, round(0.85 * b.score, 2) AS confidence FROM h LEFT JOIN b ON h.header = b.header AND b.n = 1""")
def j11(spark, d):
    return mapping.fuzzy(_asked(spark, d))


_UPSERT = """WITH c AS (SELECT 's' || c_nationkey AS source_software, 'col' || c_custkey AS original_column, 'vendor' AS mapped_to, 0.5::DOUBLE AS confidence, c_custkey % 3 = 0 AS confirmed_by_user, 1 AS times_seen FROM customer WHERE c_custkey % 2 = 0),
    i AS (SELECT 's' || c_nationkey AS source_software, 'col' || c_custkey AS original_column, 'category' AS mapped_to, 0.8::DOUBLE AS confidence, c_custkey % 5 = 0 AS confirmed_by_user FROM customer WHERE c_custkey % 7 < 4),
    j AS (SELECT coalesce(c.source_software, i.source_software) AS source_software, coalesce(c.original_column, i.original_column) AS original_column, c.mapped_to AS cm, i.mapped_to AS im, c.confidence AS cc, i.confidence AS ic, c.confirmed_by_user AS cu, i.confirmed_by_user AS iu, c.times_seen AS t,
          i.mapped_to IS NULL OR (coalesce(c.confirmed_by_user, false) AND NOT coalesce(i.confirmed_by_user, false)) AS held FROM c FULL JOIN i ON c.source_software = i.source_software AND c.original_column = i.original_column)
    SELECT source_software, original_column, CASE WHEN held THEN cm ELSE im END AS mapped_to, CASE WHEN held THEN cc ELSE ic END AS confidence, CASE WHEN held THEN cu ELSE iu END AS confirmed_by_user,
           CAST(CASE WHEN im IS NULL OR (held AND cm IS NOT NULL) THEN t WHEN cm IS NULL THEN 1 ELSE t + 1 END AS INTEGER) AS times_seen FROM j"""


def _learned(spark, d, which: str) -> DataFrame:
    k = F.col("c_custkey")
    df = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("source_software"), F.concat(F.lit("col"), k.cast("string")).alias("original_column"), k)
    if which == "current":
        return df.where(k % 2 == 0).select("source_software", "original_column", F.lit("vendor").alias("mapped_to"), F.lit(0.5).alias("confidence"), (k % 3 == 0).alias("confirmed_by_user"), F.lit(1).alias("times_seen"))
    return df.where(k % 7 < 4).select("source_software", "original_column", F.lit("category").alias("mapped_to"), F.lit(0.8).alias("confidence"), (k % 5 == 0).alias("confirmed_by_user"))


@registered("j9_mapping_upsert", _UPSERT)
def j9(spark, d):
    return mapping.upsert(_learned(spark, d, "current"), _learned(spark, d, "incoming"))


@registered("j8_learned_mapping", "SELECT 's' || c_nationkey AS source_software, 'col' || c_custkey AS original_column, CASE WHEN c_custkey % 2 = 0 THEN 'vendor' END AS mapped_to FROM customer")
def j8(spark, d):
    headers = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("source_software"), F.concat(F.lit("col"), F.col("c_custkey").cast("string")).alias("original_column"))
    return mapping.learned(headers, _learned(spark, d, "current").select("source_software", "original_column", "mapped_to"))


_FLAT = [(c, k) for k, cs in fixed.SECTION_CATEGORIES for c in cs]
_SECTIONS = f"""known(known, section_key, rank) AS (VALUES {", ".join(f"({q(c)}, {q(k) if k else 'NULL'}, {i})" for i, (c, k) in enumerate(_FLAT))}),
    sect(section_key, section, section_name, rate_filer, rate_non_filer, annex_c) AS (VALUES {", ".join("(" + ", ".join("NULL" if v is None else q(v) if isinstance(v, str) else f"{v}::DOUBLE" for v in r) + ")" for r in fixed.SECTIONS)}),
    x AS (SELECT DISTINCT category, lower(trim(category)) AS low FROM ledger),
    y AS (SELECT x.category, k.section_key, row_number() OVER (PARTITION BY x.category ORDER BY low <> known, rank) AS n FROM x JOIN known k ON k.section_key IS NOT NULL AND low <> '' AND (low = known OR contains(low, known) OR contains(known, low))),
    z AS (SELECT x.category, y.section_key, s.section, s.section_name, s.rate_filer, s.rate_non_filer, coalesce(s.annex_c, 'Other') AS annex_c FROM x LEFT JOIN y ON x.category = y.category AND y.n = 1 LEFT JOIN sect s ON s.section_key = y.section_key)"""


@registered("j12_tax_sections", f"{A.LEDGER}, {_SECTIONS} SELECT * FROM z")
def j12(spark, d):
    """Categories to withholding sections and rates."""
    return tax.classify(A.ledger(spark, d))


@registered("f29_withholding", f"{A.LEDGER}, {_SECTIONS} SELECT l.row_id, z.section_key, coalesce(CAST(round(CAST(l.amount AS DECIMAL(18, 2)) * CAST(z.rate_filer AS DECIMAL(6, 4)), 2) AS DOUBLE), 0) AS wht FROM ledger l LEFT JOIN z ON l.category IS NOT DISTINCT FROM z.category")
def f29(spark, d):
    return tax.withholding(A.ledger(spark, d)).select("row_id", "section_key", "wht")


# Tenants -----------------------------------------------------------------------------------------

_MEMBERS = "members AS (SELECT c_custkey % 50 AS user_id, c_nationkey AS org_id, CASE WHEN min(c_custkey) % 2 = 0 THEN 'admin' ELSE 'viewer' END AS role, min(c_custkey) % 3 > 0 AS is_active FROM customer GROUP BY 1, 2)"


def _members(spark, d) -> DataFrame:
    per = spark.read.parquet(f"{d}/customer.parquet").groupBy((F.col("c_custkey") % 50).alias("user_id"), F.col("c_nationkey").alias("org_id")).agg(F.min("c_custkey").alias("m"))
    return per.select("user_id", "org_id", F.when(F.col("m") % 2 == 0, "admin").otherwise("viewer").alias("role"), (F.col("m") % 3 > 0).alias("is_active"))


def _orgs(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("name"))


@registered("j5_visible_orgs", f"WITH {_MEMBERS} SELECT n_nationkey AS org_id, n_name AS name, role FROM nation JOIN members ON org_id = n_nationkey WHERE user_id = 3 AND is_active")
def j5(spark, d):
    return tenants.visible_orgs(_orgs(spark, d), _members(spark, d), 3)


@registered("j6_tenant_scope", f"{A.LEDGER}, {_MEMBERS} SELECT org_id, count(*) AS n FROM ledger WHERE org_id IN (SELECT org_id FROM members WHERE user_id = 2 AND is_active AND role = 'admin') GROUP BY 1")
def j6(spark, d):
    return tenants.scoped(A.ledger(spark, d), _members(spark, d), 2, "admin").groupBy("org_id").agg(F.count("*").alias("n"))


@registered("j3_new_files", "SELECT n_nationkey * 0 + c_custkey AS file_id, c_custkey % 4 <> 0 AS admitted FROM customer JOIN nation ON n_nationkey = c_nationkey")
def j3(spark, d):
    """Files whose hash an org has had before are turned away."""
    found = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("file_id"), F.col("c_nationkey").alias("org_id"), F.sha2("c_name", 256).alias("sha256"))
    new, old = tenants.new_files(found, found.where("file_id % 4 = 0").select("org_id", "sha256"))
    return new.select("file_id", F.lit(True).alias("admitted")).unionByName(old.select("file_id", F.lit(False).alias("admitted")))


HASH6 = HASH_SQL[:-1] + " || '|' || direction || '|' || lower(trim(currency)))"


def _upload(spark, d) -> DataFrame:
    df = A.ledger(spark, d).withColumn("txn_date", S.parse_date(F.col("raw_date")))
    return tenants.upload_rows(df)


_UP = f"{A.LEDGER}, u0 AS (SELECT * REPLACE ({A.date_sql('raw_date')} AS txn_date) FROM ledger), u AS (SELECT *, txn_date IS NOT NULL AND trim(description) <> '' AND amount > 0 AS ok, sha256(coalesce(strftime(txn_date, '%Y-%m-%d 00:00:00'), '') || '|' || lower(trim(description)) || '|' || format('{{:.2f}}', amount) || '|' || lower(trim(coalesce(party_name, ''))) || '|' || lower(trim(coalesce(reference, ''))) || '|' || direction || '|' || lower(trim(currency))) AS h FROM u0)"


@registered("j4_new_rows", f"{_UP} SELECT row_id FROM u WHERE (org_id, h) NOT IN (SELECT (org_id, h) FROM u WHERE k % 5 = 0)")
def j4(spark, d):
    rows = _upload(spark, d)
    return tenants.new_rows(rows, rows.where("k % 5 = 0")).select("row_id")


@registered("j4_screened_rows", f"{_UP} SELECT row_id FROM u WHERE (org_id, h) NOT IN (SELECT (org_id, h) FROM u WHERE k % 5 = 0)")
def j4_screened(spark, d):
    """Rows that the ledger lacks; a screen of the known hashes spares the join for most of them."""
    rows = stores.stored(_upload(spark, d))
    known = rows.where("k % 5 = 0")
    key = ["org_id", "source_row_hash"]
    return membership.unknown_screened(rows, known, membership.screen(known, key), key).select("row_id")


_STATUS = f"""{_UP}, t AS (SELECT *, CASE WHEN NOT ok THEN 'failed' WHEN (org_id, h) IN (SELECT (org_id, h) FROM u WHERE k % 5 = 0) OR row_number() OVER (PARTITION BY org_id, file, h ORDER BY row_id) > 1 THEN 'skipped' ELSE 'imported' END AS status FROM u)"""


_HAD = "k % 13 <> 0"


@registered("c8_upload", matches_sql("t", "row_id, status", f"{_STATUS}") + f" SELECT row_id, status, description, party_name, reference, types, redactions FROM told WHERE row_id % 1000000000000 % 13 <> 0")
def c8(spark, d):
    """C8 (J3, F31, F13, F14, F15, F17, W3, J4): an upload in one call; files had before are left out, every row of the others has its fate and loses its personal data."""
    rows = A.ledger(spark, d).withColumn("sha256", F.when(F.expr(_HAD), "new").otherwise("had"))
    known = rows.where("sha256 = 'had'").select("org_id", "sha256").distinct()
    done, _ = tenants.upload(rows, _upload(spark, d).where("k % 5 = 0"), known)
    return done.select("row_id", "status", "description", "party_name", "reference", F.array_join("pii.types", ",").alias("types"), "pii.redactions")


@registered("a11_job_counts", f"{_STATUS}, g AS (SELECT org_id, file, count(*) AS rows_total, count(*) FILTER (status = 'imported') AS rows_imported, count(*) FILTER (status = 'skipped') AS rows_skipped, count(*) FILTER (status = 'failed') AS rows_failed FROM t GROUP BY 1, 2) SELECT *, CASE WHEN rows_failed = rows_total THEN 'failed' ELSE 'completed' END AS status FROM g")
def a11(spark, d):
    rows = _upload(spark, d)
    return tenants.job_counts(tenants.statuses(rows, rows.where("k % 5 = 0")))


_CHART = "chart(code, name, type, parent_code) AS (VALUES " + ", ".join("(" + ", ".join(q(v) if v else "NULL" for v in r) + ")" for r in fixed.CHART) + ")"


@registered("j14_seed_accounts", f"WITH {_CHART} SELECT n_nationkey AS org_id, code, name, type, parent_code FROM nation, chart WHERE NOT (n_nationkey % 2 = 0 AND code < '2000')")
def j14(spark, d):
    had = _orgs(spark, d).where("org_id % 2 = 0").select("org_id", F.explode(F.array(*(F.lit(r[0]) for r in fixed.CHART if r[0] < "2000"))).alias("code"))
    return tenants.seeded(_orgs(spark, d).select("org_id"), had)


@registered("p18_active_accounts", f"WITH {_CHART} SELECT n_nationkey AS org_id, code, name FROM nation, chart WHERE n_nationkey = 5 AND type <> 'equity'")
def p18(spark, d):
    orgs = _orgs(spark, d).select("org_id")
    accounts = tenants.seeded(orgs, orgs.select("org_id", F.lit("none").alias("code"))).withColumn("is_active", F.col("type") != "equity")
    return tenants.active_accounts(accounts, 5).select("org_id", "code", "name")


@registered("l1_page", f"{A.LEDGER} SELECT row_id, strftime(txn_date, '%Y-%m-%d') AS txn_date, amount FROM ledger WHERE org_id = 7 ORDER BY ledger.txn_date DESC, created_at DESC, row_id LIMIT 50 OFFSET 50")
def l1(spark, d):
    return tenants.page(tenants.listing(A.ledger(spark, d), 7), 50, 50).select("row_id", day("txn_date"), "amount")


@registered("a14_count", f"{A.LEDGER} SELECT count(*) AS n FROM ledger WHERE org_id = 7 AND direction = 'credit'")
def a14(spark, d):
    return tenants.listing(A.ledger(spark, d), 7, direction="credit").agg(F.count("*").alias("n"))


@registered("l2_latest_jobs", "SELECT org_id, job_id FROM (SELECT c_nationkey AS org_id, o_orderkey AS job_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey) WHERE n <= 100")
def l2(spark, d):
    jobs = spark.read.parquet(f"{d}/orders.parquet").join(spark.read.parquet(f"{d}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    return tenants.latest(jobs.select(F.col("c_nationkey").alias("org_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"))).select("org_id", "job_id")


@registered("l3_summary_order", f"{A.LEDGER} SELECT strftime(txn_date, '%Y-%m') AS year_month, count(*) AS n FROM ledger GROUP BY 1 ORDER BY 1")
def l3(spark, d):
    return sides(A.ledger(spark, d)).groupBy("year_month").agg(F.count("*").alias("n")).orderBy("year_month")


# Streams -----------------------------------------------------------------------------------------


@registered("t2_debounce", """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT event_id, user_id, event_type, n, true AS keep, ts AS last FROM e WHERE n = 1
          UNION ALL SELECT e.event_id, e.user_id, e.event_type, e.n, e.ts - w.last >= INTERVAL 12 HOUR, CASE WHEN e.ts - w.last >= INTERVAL 12 HOUR THEN e.ts ELSE w.last END FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.n = w.n + 1)
    SELECT event_id FROM w WHERE keep""")
def t2(spark, d):
    """Events debounced by user and type, here over half a day."""
    return watch.debounced(spark.read.parquet(f"{d}/events.parquet"), ["user_id", "event_type"], seconds=43_200).select("event_id")
