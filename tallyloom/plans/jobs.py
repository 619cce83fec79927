"""Jobs from files to gold."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import gates
from ..operators import medallion as M
from ..sources import chunks, files, sinks, workbook
from . import periods

BRONZE = "source_file string, source_row_number int, raw_content string, raw_headers string, source_type string, source_software string, processing_status string, bronze_id string, raw_record string, gate_warnings array<struct<rule: string, column: string>>, source_file_hash string, ingestion_batch_id string"
MARKS = "ingestion_batch_id string, status string, at timestamp"
KNOWN = "sha256 string, path string, ingestion_batch_id string"
BLOCKED = "path string, sha256 string, blocked_by string, ingestion_batch_id string"
PLACE = ("source_file", "source_row_number")
BY = ["ingestion_batch_id"]


def _local(path):
    """A path without the spelling of its scheme, which differs between sources."""
    return F.regexp_replace(path, "^file:/+", "/")


def _name(header: str) -> str:
    """A header that neither a layer nor this job has a column of."""
    safe = gates.safe_name(header)
    return f"raw_{safe}" if safe.strip().lower() in (*PLACE, "raw_record", "gate_warnings", files.CORRUPT) else safe


def _text_rows(spark: SparkSession, new: DataFrame) -> list[DataFrame]:
    """Rows of strings of the CSV files: one frame for the files of each form. Files in UTF-8 are read in chunks, others whole."""
    out = []
    for charset, separator, paths in files.csv_groups(new):
        out.append(chunks.read_csv(spark, paths, separator, audit=True, name=_name) if charset == "UTF-8" else files.read_csv(spark, paths, charset, separator, audit=True, name=_name))
    return out


def raw_rows(spark: SparkSession, new: DataFrame, kinds: set[str]) -> dict[str, list[DataFrame]]:
    """Rows of a manifest with contents as they are in the files, by kind: a frame for each form of CSV files, and one for workbooks."""
    books = [workbook.rows(workbook.cells(new.where("source_type = 'xlsx'"))).withColumnRenamed("path", "source_file")] if "xlsx" in kinds else []
    return {"csv": _text_rows(spark, new) if "csv" in kinds else [], "xlsx": books}


def csv_bronze(found: DataFrame, batch: str, most: int = fixed.MAX_CELL) -> DataFrame:
    """Bronze rows of CSV rows, mended; rows with more or fewer cells than their header keep their whole text in raw_record."""
    columns = [c for c in found.columns if c not in (*PLACE, files.CORRUPT)]
    kept = files.strip_summary(found, columns).withColumnRenamed(files.CORRUPT, "raw_record")
    clean = gates.mended(kept, (*PLACE, "raw_record"), most)
    return M.bronze(clean, batch, "csv", files.software(F.col(PLACE[0]))["software"], file_col=PLACE[0], number_col=PLACE[1], keep=["raw_record", "gate_warnings"])


def book_bronze(found: DataFrame, batch: str, most: int = fixed.MAX_CELL) -> DataFrame:
    """Bronze rows of workbook rows, mended; headers are keys of a map here, so cells of all columns are mended as one."""
    first = F.lower(F.trim(F.get(F.map_values("fields"), F.lit(0))))
    kept = files.strip_summary(found.withColumn("first", first), ["first"])
    cells = gates.mended(kept.select(*PLACE, F.posexplode("fields").alias("pos", "name", "cell")), (*PLACE, "name"), most)
    reserved = F.lower(F.trim("name")).isin(*fixed.RESERVED_NAMES)
    told = F.transform("gate_warnings", lambda w: F.struct(w["rule"].alias("rule"), F.col("name").alias("column")))
    cells = cells.withColumn("name", F.when(reserved, F.concat(F.lit("raw_"), "name")).otherwise(F.col("name"))).withColumn("gate_warnings", told)
    pairs = F.array_sort(F.collect_list(F.struct("pos", "name", "cell")))
    whole = cells.groupBy(*PLACE).agg(F.map_from_entries(F.transform(pairs, lambda c: F.struct(c["name"], c["cell"]))).alias("fields"), F.flatten(F.collect_list("gate_warnings")).alias("gate_warnings"))
    return whole.select(
        "source_file", F.col("source_row_number").cast("int"), F.to_json("fields", {"ignoreNullFields": "false"}).alias("raw_content"), F.to_json(F.map_keys("fields")).alias("raw_headers"), F.lit(batch).alias("ingestion_batch_id"), F.lit("xlsx").alias("source_type"),
        files.software(F.col("source_file"))["software"].alias("source_software"), F.lit("pending").alias("processing_status"), F.lit(None).cast("string").alias("raw_record"), "gate_warnings", F.sha2(F.concat_ws("|", F.lit(batch), *PLACE), 256).alias("bronze_id"),
    )


def _mark(spark: SparkSession, lake: str, batches: list[str], status: str) -> None:
    rows = spark.createDataFrame([(b, status) for b in batches], "ingestion_batch_id string, status string").withColumn("at", F.current_timestamp())
    sinks.append(rows.coalesce(1), f"{lake}/batches")


def _dead(spark: SparkSession, lake: str, batch: str, lease: float) -> list[str]:
    """Batches that another run claimed longer than `lease` seconds ago, has rows of in bronze, and never ended."""
    marks = sinks.table(spark, f"{lake}/batches", MARKS).where(F.col("ingestion_batch_id") != batch)
    per = marks.groupBy("ingestion_batch_id").agg(F.bool_or(F.col("status") == "processed").alias("done"), F.max("at").alias("at"))
    names = [r[0] for r in per.where(~F.col("done") & (F.col("at") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(lease)))).collect()]
    return _stored(spark, lake, names)


def _stored(spark: SparkSession, lake: str, batches: list[str]) -> list[str]:
    """Those of some batches that have rows in bronze; only their partitions are looked at."""
    if not batches:
        return []
    return sorted(r[0] for r in sinks.table(spark, f"{lake}/bronze", BRONZE).where(F.col("ingestion_batch_id").isin(batches)).select("ingestion_batch_id").distinct().collect())


def _know(spark: SparkSession, lake: str, batches: list[str]) -> None:
    """Writes the hashes of files that batches brought to bronze to the table of known files."""
    had = sinks.table(spark, f"{lake}/bronze", BRONZE).where(F.col("ingestion_batch_id").isin(batches))
    sinks.replace_partitions(had.groupBy(F.col("source_file_hash").alias("sha256"), *BY).agg(F.min("source_file").alias("path")).select("sha256", "path", *BY), f"{lake}/files", BY)


def _bronze(spark: SparkSession, new: DataFrame, lake: str, batch: str, max_bytes: int, max_rows: int | None, most: int) -> None:
    """Takes admitted files of a manifest to bronze; blocked ones are told in a table of their own, mended cells in bronze itself."""
    kinds = {r[0] for r in new.select("source_type").distinct().collect()}
    if not kinds:
        return
    sized = gates.admitted(new, None, max_bytes, None).drop("n_rows")
    fit = sized.where("blocked_by is null").drop("blocked_by")
    hashes = fit.select(_local("path").alias("p"), "path", F.col("sha256").alias("source_file_hash"))
    # a batch that died in the middle of this step starts it again
    found = raw_rows(spark, fit, kinds)
    blocked = [sized.where("blocked_by is not null").select("path", "sha256", "blocked_by")]
    for rows in [r for frames in found.values() for r in frames] if max_rows is not None else []:
        many = rows.groupBy("source_file").agg(F.count("*").alias("n")).where(F.col("n") > max_rows)
        blocked.append(many.select(_local("source_file").alias("p")).join(hashes, "p").select("path", F.col("source_file_hash").alias("sha256"), F.lit("rows").alias("blocked_by")))
    sinks.replace_partitions(files.unioned(blocked).withColumn(BY[0], F.lit(batch)), f"{lake}/blocked", BY)
    out = sinks.table(spark, f"{lake}/blocked", BLOCKED).where(F.col("ingestion_batch_id") == batch).select(_local("path").alias("p"))
    mended = [csv_bronze(r, batch, most) for r in found["csv"]] + [book_bronze(r, batch, most) for r in found["xlsx"]]
    placed = files.unioned(mended).withColumn("p", _local("source_file")).join(hashes.drop("path"), "p").join(out, "p", "left_anti")
    sinks.replace_partitions(placed.select(*sinks.names(BRONZE)), f"{lake}/bronze", BY)
    _know(spark, lake, [batch])


def ingest(
    spark: SparkSession, found: DataFrame, lake: str, batch: str, max_bytes: int = fixed.MAX_FILE_BYTES, max_rows: int | None = fixed.MAX_ROWS, most: int = fixed.MAX_CELL, lease: float = 0.0
) -> dict[str, int | str]:
    """Takes the new CSV files and workbooks of a manifest with contents through gates, bronze, silver and gold of a lake folder.

    Files whose hash came with another batch are left out; of equal files the one with the least path counts. Files
    beyond max_bytes or max_rows are blocked (table `blocked`); names, formulas and long cells are mended before rows are
    stored, and gate_warnings of a bronze row says what was. Dates are read by the order that most of a file's dates fit.

    Every layer is partitioned by batch and a batch replaces its own partitions, so a batch that is run again gives
    the same tables. A batch is claimed when it begins and marked when all its layers are there; batches in bronze
    that were claimed more than `lease` seconds ago and have no mark, of runs that died, are taken up by the next run.
    Give runs that may overlap a lease longer than a run takes. The work follows the batch, not the lake: rules
    run once on its rows, known files are a table by hash, and only months that the batch touches are summed up anew.
    The status is `ok`, or `duplicate` if there was nothing to do.
    """
    began = time.time()
    spent = lambda: int(1000 * (time.time() - began))
    dead = _dead(spark, lake, batch, lease)
    if dead:
        _know(spark, lake, dead)
    _mark(spark, lake, [batch, *dead], "claimed")
    known = sinks.table(spark, f"{lake}/files", KNOWN).where(F.col("ingestion_batch_id") != batch).select("sha256")
    wanted = found.where(F.col("source_type").isin("csv", "xlsx"))
    least = wanted.groupBy("sha256").agg(F.min("path").alias("path"))
    new = wanted.join(least.join(known, "sha256", "left_anti"), ["sha256", "path"], "left_semi")
    _bronze(spark, new, lake, batch, max_bytes, max_rows, most)
    open_ = _stored(spark, lake, [batch, *dead])
    if not open_:
        _mark(spark, lake, [batch], "processed")
        sinks.audit(spark, f"{lake}/audit", [("ingest", "bronze", batch, "duplicate", 0, None, spent())])
        return {"status": "duplicate", "bronze": 0, "silver": 0, "quarantine": 0, "gold": 0}
    counts = promote(spark, lake, open_)
    _mark(spark, lake, [batch, *open_], "processed")
    sinks.audit(spark, f"{lake}/audit", [("ingest", layer, batch, "ok", n, None, spent()) for layer, n in counts.items()])
    return {"status": "ok"} | counts


def promote(spark: SparkSession, lake: str, batches: list[str]) -> dict[str, int]:
    """Bronze rows of batches to silver, quarantine, gold and the summaries; returns the rows of each layer."""
    stored = sinks.table(spark, f"{lake}/bronze", BRONZE).where(F.col("ingestion_batch_id").isin(batches))
    orders = M.file_votes(stored).select(F.col("source_file").alias("f"), "date_order")
    voted = stored.join(orders, stored.source_file == F.col("f"), "left").drop("f")
    # the rules run once: all layers are routed from what they told
    judged = M.file_rows(voted).drop("fields", "date_order", "raw_record", "gate_warnings")
    staged = f"{lake}/_judged/{batches[0]}"
    sinks.remove(spark, staged)
    judged.write.parquet(staged)
    judged = spark.read.schema(judged.schema).parquet(staged)
    layers = {
        "silver": judged.where("reason is null").drop("pii_types", "d", "c", "a", "is_credit", "source_file_hash", "source_type", "source_software", "processing_status", "raw_headers", "raw_content"),
        "quarantine": judged.where("reason is not null").select("bronze_id", "ingestion_batch_id", "reason", "raw_content"),
        "gold": M.file_gold(judged),
    }
    counts = {"bronze": judged.count()}
    for layer, rows in layers.items():
        path = f"{lake}/{layer}"
        sinks.replace_partitions(rows, path, BY)
        # a layer without rows has no files to take a schema from
        per = dict(spark.read.schema(rows.schema).parquet(path).where(F.col("ingestion_batch_id").isin(batches)).groupBy("ingestion_batch_id").count().collect())
        has = {r[0] for r in rows.select("ingestion_batch_id").distinct().collect()}
        for gone in set(per) - has:  # what an earlier run of the batch left
            sinks.remove(spark, sinks.partition(path, ingestion_batch_id=gone))
        counts[layer] = sum(n for b, n in per.items() if b in has)
    gold = spark.read.schema(layers["gold"].schema).parquet(f"{lake}/gold").where(F.col("ingestion_batch_id").isin(batches))
    periods.refresh(spark, lake, gold, batches)
    sinks.remove(spark, staged)
    return counts


def watcher(spark: SparkSession, lake: str, **options) -> Callable[[DataFrame, int], None]:
    """A callback for streaming.watch.run() that ingests each micro-batch of files; options are those of ingest()."""

    def on_batch(batch: DataFrame, number: int) -> None:
        ingest(batch.sparkSession, files.described(batch), lake, f"stream-{number}", **options)

    return on_batch
