"""Tenant-scoped queries on the shared ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from . import privacy


def listing(df: DataFrame, org: int | None = None, date_from=None, date_to=None, direction=None, party=None, min_amount=None, max_amount=None, account=None) -> DataFrame:
    """Rows by the filters that are given, all pushed to the scan."""
    for value, cond in (
        (org, F.col("org_id") == F.lit(org)),
        (date_from, F.col("txn_date") >= F.lit(date_from).cast("date")),
        (date_to, F.col("txn_date") <= F.lit(date_to).cast("date")),
        (direction, F.col("direction") == F.lit(direction)),
        (party, F.col("party_name").ilike(f"%{party}%")),
        (min_amount, F.col("amount") >= F.lit(min_amount)),
        (max_amount, F.col("amount") <= F.lit(max_amount)),
    ):
        if value is not None:
            df = df.where(cond)
    return df if account is None else df.where(F.col("account_id") == F.lit(account))


def page(df: DataFrame, limit: int = 50, offset: int = 0, key: str = "row_id") -> DataFrame:
    """Newest first, ties by key; limit 1 to 500."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset not negative")
    return df.orderBy(F.desc("txn_date"), F.desc("created_at"), key).offset(offset).limit(limit)


def point(df: DataFrame, org: int, key: int, name: str = "row_id") -> DataFrame:
    return df.where((F.col("org_id") == org) & (F.col(name) == key))


def latest(jobs: DataFrame, n: int = 100) -> DataFrame:
    """The n latest rows of every org by created_at, ties by id."""
    w = Window.partitionBy("org_id").orderBy(F.desc("created_at"), "job_id")
    return jobs.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("nth")


def visible_orgs(orgs: DataFrame, members: DataFrame, user: int) -> DataFrame:
    """Orgs in which a user is an active member, with the role."""
    mine = members.where((F.col("user_id") == user) & F.col("is_active")).select("org_id", "role")
    return orgs.join(mine, "org_id")


def scoped(df: DataFrame, members: DataFrame, user: int, role: str | None = None) -> DataFrame:
    """Rows of orgs in which a user is an active member, with a role on request."""
    mine = members.where((F.col("user_id") == user) & F.col("is_active"))
    return df.join(mine if role is None else mine.where(F.col("role") == role), "org_id", "left_semi")


def new_files(manifest: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files whose hash isn't known, files whose hash is)."""
    return manifest.join(known, ["org_id", "sha256"], "left_anti"), manifest.join(known, ["org_id", "sha256"], "left_semi")


def new_rows(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose (org, hash) isn't in the ledger yet."""
    return incoming.join(existing.select("org_id", "source_row_hash"), ["org_id", "source_row_hash"], "left_anti")


def chart(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.CHART), "code string, name string, type string, parent_code string")


def seeded(orgs: DataFrame, accounts: DataFrame) -> DataFrame:
    """The default chart's accounts that an org lacks: every org times a fixed table of 36 rows."""
    rows = F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(("code", "name", "type", "parent_code"), r, strict=True))) for r in fixed.CHART))
    return orgs.select("org_id", F.inline(rows)).join(accounts, ["org_id", "code"], "left_anti")


def active_accounts(accounts: DataFrame, org: int) -> DataFrame:
    return accounts.where((F.col("org_id") == org) & F.col("is_active")).orderBy("code")


def statuses(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds status to upload rows (org_id, file, row_id, source_row_hash, ok): imported, skipped or failed.

    A row fails if it can't be used, is skipped if its hash is in the ledger or came earlier in its file.
    """
    known = existing.select("org_id", "source_row_hash").distinct().withColumn("known", F.lit(True))
    w = Window.partitionBy("org_id", "file", "source_row_hash").orderBy("row_id")
    numbered = rows.withColumn("nth", F.when(F.col("ok"), F.row_number().over(w)))
    met = numbered.join(known, ["org_id", "source_row_hash"], "left")
    return met.withColumn("status", F.when(~F.col("ok"), "failed").when(F.col("known") | (F.col("nth") > 1), "skipped").otherwise("imported")).drop("known", "nth")


def job_counts(rows: DataFrame) -> DataFrame:
    """Total, imported, skipped, failed and status of each job of statuses()."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"rows_{s}")
    per = rows.groupBy("org_id", "file").agg(F.count("*").alias("rows_total"), n("imported"), n("skipped"), n("failed"))
    return per.withColumn("status", F.when(F.col("rows_failed") == F.col("rows_total"), "failed").otherwise("completed"))


def upload_rows(df: DataFrame, compat: bool = False) -> DataFrame:
    """Adds ok, the exact amount and the row hash to canonical rows of an upload."""
    more = () if compat else (F.col("direction"), F.col("currency"))
    exact = S.quantised(F.col("amount"))
    ok = F.coalesce(F.col("txn_date").isNotNull() & (S.trimmed(F.col("description")).isNotNull()) & (exact > 0), F.lit(False))
    return df.withColumn("amount_exact", exact).withColumn("ok", ok).withColumn("source_row_hash", S.row_hash(F.col("txn_date"), F.col("description"), exact, F.col("party_name"), F.col("reference"), *more))


def upload(rows: DataFrame, existing: DataFrame, known: DataFrame | None = None, formats=fixed.DATE_FORMATS, mode: str = "places") -> tuple[DataFrame, DataFrame]:
    """A whole upload: (rows with their fate, jobs), from (org_id, file, row_id, raw_date, ...) and the hashes in the ledger.

    known: (org_id, sha256) of files had before; with it rows need a sha256, and those of such files are left out.
    Rows are read to canonical form, hashed before anything is masked, and then lose their personal data. A job is an
    org's file with its counts and what was masked in it.
    """
    if known is not None:
        rows, _ = new_files(rows, known)
    ready = upload_rows(rows.withColumn("txn_date", S.parse_date(F.col("raw_date"), formats)))
    fate = statuses(ready, existing)
    masked = privacy.mask_rows(privacy.scan(fate), mode=mode).withColumn("pii", S.pii_summary(F.col("pii")))
    jobs = job_counts(masked)
    seen = masked.groupBy("org_id", "file").agg(F.count_if("pii.has_pii").alias("rows_with_pii"), F.sum("pii.redactions").alias("redactions"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("pii.types")))).alias("pii_types_detected"))
    return masked, jobs.join(seen, ["org_id", "file"])
