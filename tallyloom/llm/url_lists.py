"""Operator 5: URL filters by a temporal list join.

A list is a log of dated changes: entry, date, 'add' or 'remove'. An entry's changes in order of time become
validity intervals [added, next change). Each capture has the entries its host falls under, the
host itself and every parent domain (an address in numbers has none). An as-of join of each entry's
days of fetch with its intervals finds the last interval that began by then, and keeps those
that hold the day: one pass in order of time over an entry's intervals and days, however many of
both it has. Hosts, entries and days are evaluated once each and joined back to the captures, so that a
host with many captures costs one evaluation a day, and the way back is an equi-join that
adaptive execution splits.

Defined results: a capture without a URL, host or fetch date matches nothing; of several changes to an
entry on one date the last by action ('remove' after 'add') counts; repeated changes are one;
entries and hosts are compared in lower case and without closing dots, a backslash ends a host as a slash does,
and what comes before the last @ is the user's;
repeated captures and null ids each keep a row; empty lists block nothing, empty captures
give an empty result; extra columns stay whatever their names, those named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: What stands between the scheme and the path, up to a slash of either kind, and the host in it once the user is gone.
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)"
HOST = r"^(\[[^\]]*\]|[^:\[]+)"
NUMBERS = r"^(\[.*\]|[0-9.]+)$"
RESULT = ("host", "n_active", "entry", "blocked")
FOREVER = "9999-12-31"


def host_of(url):
    """The lower-cased host of a URL, without user, port and closing dots; null if it has none."""
    named = F.regexp_replace(F.regexp_extract(url, AUTHORITY, 1), "^[^/]*@", "")
    found = F.rtrim(F.lower(F.regexp_extract(named, HOST, 1)), F.lit("."))
    return F.when(found != "", found)


def intervals(changes: DataFrame) -> DataFrame:
    """(entry, since, until) from changes (entry, on, action): until is the date of the next change.

    Entries are lower-cased and lose white space around them and closing dots, as hosts do; empty ones are dropped.
    """
    entry = F.rtrim(F.lower(S.trimmed(F.col("entry"))), F.lit("."))
    daily = changes.select(entry.alias("entry"), "on", "action").where("entry <> '' and on is not null").groupBy("entry", "on").agg(F.max("action").alias("action"))
    after = F.lead("on").over(Window.partitionBy("entry").orderBy("on"))
    return daily.withColumn("until", F.coalesce(after, F.to_date(F.lit(FOREVER)))).where("action = 'add'").select("entry", F.col("on").alias("since"), "until")


def as_of(asked: DataFrame, valid: DataFrame) -> DataFrame:
    """The rows (entry, day) of asked that the last interval (entry, since, until) of valid begun by that day still holds."""
    begun = valid.select("entry", F.col("since").alias("day"), "until", F.lit(0).alias("is_day"))
    both = begun.unionByName(asked.select("entry", "day", F.lit(None).cast("date").alias("until"), F.lit(1).alias("is_day")))
    last = F.last("until", ignorenulls=True).over(Window.partitionBy("entry").orderBy("day", "is_day").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("held", last).where((F.col("is_day") == 1) & (F.col("day") < F.col("held"))).select("entry", "day")


def active(captures: DataFrame, changes: DataFrame, url_col: str = "url", date_col: str = "fetched") -> DataFrame:
    """Adds host, n_active (entries in force at the fetch), entry (the least of them) and blocked to captures."""
    row = F.struct(*(F.col(f"`{c}`") for c in captures.columns if c not in RESULT)).alias("row")
    known = captures.select(row, host_of(F.col(url_col)).alias("host"), F.col(date_col).cast("date").alias("day"))
    asked = known.where(F.col("host").isNotNull() & F.col("day").isNotNull()).select("host", "day").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    under = asked.withColumn("entry", F.explode(F.array_distinct(F.when(F.col("host").rlike(NUMBERS), F.array("host")).otherwise(parents))))
    valid = intervals(changes)
    listed = under.join(valid.select("entry").distinct(), "entry", "left_semi")
    met = listed.join(as_of(listed.select("entry", "day").distinct(), valid), ["entry", "day"])
    found = met.groupBy("host", "day").agg(F.count("*").alias("n_active"), F.min("entry").alias("entry"))
    back = known.join(found, ["host", "day"], "left")
    return back.select("row.*", "host", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "entry", (F.coalesce("n_active", F.lit(0)) > 0).alias("blocked"))


def sample_changes(pages: DataFrame) -> DataFrame:
    """A list drawn from the hosts of the pages and their parent domains: a fifth of them, by md5, listed, some unlisted and listed again."""
    digit = F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (digit % 200).cast("int"))
    own = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    names = own.union(own.where(F.regexp_count("host", F.lit(r"\.")) >= 2).select(F.substring_index("host", ".", -2))).distinct().where(digit % 5 == 0)
    steps = F.array(
        F.struct(start.alias("on"), F.lit("add").alias("action")),
        F.struct(F.when(digit % 3 == 0, F.date_add(start, 60)).alias("on"), F.lit("remove").alias("action")),
        F.struct(F.when(digit % 6 == 0, F.date_add(start, 120)).alias("on"), F.lit("add").alias("action")),
    )
    return names.select(F.col("host").alias("entry"), F.inline(steps)).where("on is not null")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_url_lists: every page against the list entries in force on its day of fetch."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 365).cast("int"))
    done = active(pages.withColumn("fetched", fetched), sample_changes(pages))
    return done.select("page_id", "host", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "n_active", "entry", "blocked")


ORACLE = r"""
WITH p AS (
  SELECT page_id, nullif(rtrim(lower(regexp_extract(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1), '^[^/]*@', ''), '^(\[[^\]]*\]|[^:\[]+)', 1)), '.'), '') AS host,
         DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS fetched
  FROM pages),
own AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL),
named AS (SELECT host FROM own UNION SELECT regexp_extract(host, '[^.]*\.[^.]*$') FROM own WHERE length(host) - length(replace(host, '.', '')) >= 2),
h AS (SELECT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS d FROM named),
c AS (
  SELECT host AS entry, DATE '2024-01-01' + d % 200 AS day, 'add' AS action FROM h WHERE d % 5 = 0
  UNION ALL SELECT host, DATE '2024-01-01' + d % 200 + 60, 'remove' FROM h WHERE d % 5 = 0 AND d % 3 = 0
  UNION ALL SELECT host, DATE '2024-01-01' + d % 200 + 120, 'add' FROM h WHERE d % 5 = 0 AND d % 6 = 0),
i AS (SELECT entry, day AS since, coalesce(lead(day) OVER (PARTITION BY entry ORDER BY day), DATE '9999-12-31') AS until, action FROM c),
m AS (
  SELECT p.page_id, count(DISTINCT i.entry) AS n_active, min(i.entry) AS entry
  FROM p JOIN i ON (p.host = i.entry OR ends_with(p.host, '.' || i.entry)) AND i.action = 'add' AND i.since <= p.fetched AND p.fetched < i.until
  GROUP BY p.page_id)
SELECT p.page_id, p.host, strftime(p.fetched, '%Y-%m-%d') AS fetched, coalesce(m.n_active, 0) AS n_active, m.entry, coalesce(m.n_active, 0) > 0 AS blocked
FROM p LEFT JOIN m USING (page_id)
"""
