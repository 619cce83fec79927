"""A ledger drawn from orders and customers, once for Spark and once as SQL.

Every row, text and notation follows from an order's key, so both sides give the same rows and the
ledger grows with the tables. A fiftieth of the orders comes twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PHRASES = ("Office rent", "Fuel for van", "Salary January", "Consulting fee", "کرایہ ادائیگی", "Electricity bill", "Sale of goods", "Bank interest", "=CMD(stationery)", "Internet bill بل", "Repair of printer", "Transport charges")
SUFFIXES = {3: " CNIC 42101-1234567-9", 5: " call 03001234567", 7: " mail ahmed@company.pk"}
CATEGORIES = ("Rent", "Fuel & Transport", "Salary", "Consulting", "Utilities", "", None, "office supplies", "Current assets")
CURRENCIES = ("PKR", "Rs", "Rupees", "$", "usd", "EUR")
DATES = (("dd/MM/yyyy", "%d/%m/%Y"), ("yyyy-MM-dd", "%Y-%m-%d"), ("MM/dd/yyyy", "%m/%d/%Y"), ("dd-MMM-yyyy", "%d-%b-%Y"), ("dd-MM-yyyy", "%d-%m-%Y"), ("yyyy/MM/dd", "%Y/%m/%d"), ("dd MMM yyyy", "%d %b %Y"), ("dd MMMM yyyy", "%d %B %Y"))
AGAIN = 1_000_000_000_000


def _pick(key: Column, values) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (key % len(values) + 1).cast("int"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")
    both = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    suffix, date = F.lit(""), F.lit("not-a-date")
    for digit, text in SUFFIXES.items():
        suffix = F.when(k % 10 == digit, text).otherwise(suffix)
    for i, (pattern, _) in enumerate(DATES):
        date = F.when(k % 9 == i, F.date_format(d, pattern)).otherwise(date)
    money = F.col("o_totalprice")
    comma, plain = F.format_number(money, 2), F.format_string("%.2f", money)
    amount = F.when(k % 6 == 0, F.concat(F.lit("PKR "), comma)).when(k % 6 == 1, F.concat(F.lit("("), comma, F.lit(")"))).when(k % 6 == 2, F.concat(F.lit("Rs. "), plain)).when(k % 6 == 3, "N/A").when(k % 6 == 4, F.concat(F.lit("-"), comma)).otherwise(F.concat(plain, F.lit(" DR")))
    copies = F.when(k % 50 == 0, F.array(k, k + AGAIN)).otherwise(F.array(k))
    return both.select(
        F.explode(copies).alias("row_id"), k.alias("k"), F.col("c_nationkey").alias("org_id"), d.alias("txn_date"), F.col("o_orderdate").alias("created_at"), F.concat(_pick(k, PHRASES), suffix).alias("description"),
        F.when(k % 17 != 0, F.col("c_name")).alias("party_name"), F.concat(F.lit("INV-"), k.cast("string")).alias("reference"), money.alias("amount"), F.when(F.col("o_orderstatus") == "F", "credit").otherwise("debit").alias("direction"),
        _pick(k, CURRENCIES).alias("currency"), _pick(k, CATEGORIES).alias("category"), date.alias("raw_date"), amount.alias("raw_amount"), F.concat(F.lit("file-"), (k % 40).cast("string"), F.lit(".csv")).alias("file"),
    )


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as raw rows: JSON in three header dialects, some of them broken."""
    df = ledger(spark, sf_dir)
    side = lambda d: F.when(F.col("direction") == d, F.format_string("%.2f", F.col("amount"))).otherwise("")
    english = F.struct(F.col("raw_date").alias("Date"), F.col("description").alias("Description"), F.col("party_name").alias("Party"), F.col("raw_amount").alias("Amount"))
    tally = F.struct(F.col("raw_date").alias("date"), F.col("description").alias("particulars"), F.col("party_name").alias("name"), side("debit").alias("debit"), side("credit").alias("credit"))
    urdu = F.struct(F.col("raw_date").alias("تاریخ"), F.col("description").alias("تفصیل"), F.col("party_name").alias("نام"), F.col("raw_amount").alias("رقم"))
    keep = {"ignoreNullFields": "false"}
    raw = F.when(F.col("k") % 97 == 0, "not json").when(F.col("k") % 89 == 0, "[1, 2]").when(F.col("k") % 3 == 0, F.to_json(english, keep)).when(F.col("k") % 3 == 1, F.to_json(tally, keep)).otherwise(F.to_json(urdu, keep))
    return df.select(F.col("row_id").cast("string").alias("bronze_id"), F.concat(F.lit("batch-"), (F.col("k") % 4).cast("string")).alias("ingestion_batch_id"), F.col("file").alias("source_file"), F.col("row_id").alias("source_row_number"), raw.alias("raw_content"))


# The same as SQL ---------------------------------------------------------------------------------


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _case(on: str, pairs, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {on} = {i} THEN {x}" for i, x in pairs) + f" ELSE {other} END"


LEDGER = f"""
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, * FROM orders JOIN customer ON o_custkey = c_custkey),
ledger AS (
  SELECT unnest(CASE WHEN k % 50 = 0 THEN [k, k + {AGAIN}] ELSE [k] END) AS row_id, k, c_nationkey AS org_id, d AS txn_date, o_orderdate AS created_at,
         ({_list(PHRASES)})[k % {len(PHRASES)} + 1] || {_case("k % 10", [(i, f"'{s}'") for i, s in SUFFIXES.items()], "''")} AS description,
         CASE WHEN k % 17 <> 0 THEN c_name END AS party_name, 'INV-' || k AS reference, o_totalprice AS amount,
         CASE WHEN o_orderstatus = 'F' THEN 'credit' ELSE 'debit' END AS direction,
         ({_list(CURRENCIES)})[k % {len(CURRENCIES)} + 1] AS currency, ({_list(CATEGORIES)})[k % {len(CATEGORIES)} + 1] AS category,
         {_case("k % 9", [(i, f"strftime(d, '{p}')") for i, (_, p) in enumerate(DATES)], "'not-a-date'")} AS raw_date,
         {_case("k % 6", [(0, "'PKR ' || format('{:,.2f}', o_totalprice)"), (1, "'(' || format('{:,.2f}', o_totalprice) || ')'"), (2, "'Rs. ' || format('{:.2f}', o_totalprice)"), (3, "'N/A'"), (4, "'-' || format('{:,.2f}', o_totalprice)")], "format('{:.2f}', o_totalprice) || ' DR'")} AS raw_amount,
         'file-' || (k % 40) || '.csv' AS file
  FROM o)
"""

FORMATS = "['%d/%m/%Y', '%Y-%m-%d', '%m/%d/%Y', '%d-%b-%Y', '%d-%m-%Y', '%Y/%m/%d', '%d %b %Y', '%d %B %Y']"
SHORT_FORMATS = "['%d/%m/%Y', '%Y-%m-%d', '%m/%d/%Y', '%d-%m-%Y']"


def date_sql(x: str, formats: str = FORMATS) -> str:
    return f"CAST(try_strptime(trim({x}), {formats}) AS DATE)"


def fiscal_sql(d: str) -> str:
    first = f"(year({d}) - CASE WHEN month({d}) < 7 THEN 1 ELSE 0 END)"
    return f"{first} || '-' || ({first} + 1)"


def number_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast({x} AS DOUBLE) END"


def amount_sql(x: str) -> str:
    """The silver rule."""
    inner = f"CASE WHEN trim({x}) LIKE '(%)' THEN trim(substr(trim({x}), 2, length(trim({x})) - 2)) ELSE trim({x}) END"
    bare = f"translate(regexp_replace(regexp_replace({inner}, '^-\\s*', ''), '^(PKR|Rs\\.|Rs)\\s*', '', 'i'), ', ', '')"
    return f"CASE WHEN trim({x}) LIKE '(%)' OR ({inner}) LIKE '-%' THEN -({number_sql(bare)}) ELSE {number_sql(bare)} END"


def gate_amount_sql(x: str) -> str:
    inner = f"CASE WHEN trim({x}) LIKE '(%)' THEN substr(trim({x}), 2, length(trim({x})) - 2) ELSE trim({x}) END"
    bare = f"regexp_replace(translate(regexp_replace({inner}, '^(PKR|Rs\\.|Rs|USD|\\$|EUR|€|GBP|£)\\s*', '', 'i'), ', ', ''), '\\s*(DR|CR|Dr|Cr)\\.?\\s*$', '')"
    return f"CASE WHEN lower(trim({x})) IN ('n/a', 'nil', '-', '—', 'null', 'none') THEN NULL WHEN trim({x}) LIKE '(%)' THEN -({number_sql(bare)}) ELSE {number_sql(bare)} END"


def zero_amount_sql(x: str) -> str:
    bare = f"replace(regexp_replace(trim({x}), '^pkr\\s*', '', 'i'), ',', '')"
    signed = f"CASE WHEN ({bare}) LIKE '(%)' THEN '-' || substr({bare}, 2, length({bare}) - 2) ELSE {bare} END"
    return f"coalesce({number_sql(signed)}, 0.0)"


def money_sql(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"
