"""Files that come and change, as a stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import jobs
from tallyloom.sources import changes, files
from tallyloom.streaming import watch

STANDARD = "Date,Description,Party,Amount,Type\n15/01/2024,Rent payment,Landlord,50000,debit\n16/01/2024,Sale to ABC Co,ABC Co,80000,credit\n"


def follow(spark, folder, tmp_path, callback, **options):
    stream = changes.changes(spark, str(folder), str(tmp_path / "index"), **options)
    query = watch.run(stream, callback, str(tmp_path / "ck"), once=True)
    query.awaitTermination(120)


def test_names_are_judged_as_columns_are(spark):
    names = ["a.csv", "A.CSV", ".a.csv", "~$a.xlsx", "a.tmp", "a", ".csv", "a.b.json", "x.lock", "a.xls ", "b.PDF", "c.txt", "a."]
    df = spark.createDataFrame([(f"/in/sub/{n}", n) for n in names], "path string, name string").select("name", F.coalesce(files.wanted(F.col("path")), F.lit(False)).alias("w"))
    assert {r["name"]: r["w"] for r in df.collect()} == {n: changes.wanted(n) for n in names}


def test_new_and_modified_files_reach_the_callback(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    (folder / "sub").mkdir(parents=True)
    told = watch.per_file(lambda path, kind: seen.append((os.path.basename(path), kind)))
    (folder / "a.csv").write_text("x")
    (folder / "sub" / "b.csv").write_text("y")
    (folder / "~$a.csv").write_text("z")
    follow(spark, folder, tmp_path, told)
    assert sorted(seen) == [("a.csv", "created"), ("b.csv", "created")]
    follow(spark, folder, tmp_path, told)
    assert len(seen) == 2
    (folder / "a.csv").write_text("changed")
    (folder / "c.json").write_text("{}")
    follow(spark, folder, tmp_path, told)
    assert sorted(seen[2:]) == [("a.csv", "modified"), ("c.json", "created")]


def test_changes_go_on_in_batches_of_a_running_stream(spark, tmp_path):
    folder, batches = tmp_path / "in", []
    folder.mkdir()
    for i in range(5):
        (folder / f"f{i}.csv").write_text(f"{i}")
    stream = changes.changes(spark, str(folder), str(tmp_path / "index"), most=2)
    query = watch.run(stream, lambda df, n: batches.append(sorted((r["path"].rsplit("/", 1)[1], r["event_type"], bytes(r["content"])) for r in df.collect())), str(tmp_path / "ck"), every="100 milliseconds")
    try:
        query.processAllAvailable()
        (folder / "f1.csv").write_text("more")
        query.processAllAvailable()
    finally:
        query.stop()
    assert [len(b) for b in batches if b] == [2, 2, 1, 1]
    assert [x for b in batches for x in b if x[0] == "f1.csv"] == [("f1.csv", "created", b"1"), ("f1.csv", "modified", b"more")]


def test_a_replayed_batch_gets_the_same_files(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    options = {"path": str(folder), "index": str(tmp_path / "index")}
    (folder / "a.csv").write_text("1")
    first = changes.Reader(options)
    end = first.latestOffset()
    (folder / "b.csv").write_text("2")
    again = changes.Reader(options)  # a restart that has not heard of the end
    names = lambda r, a, b: sorted(c[0].rsplit("/", 1)[1] for p in r.partitions(a, b) for c in p.changes)
    assert names(again, again.initialOffset(), end) == ["a.csv"]
    later = again.latestOffset()
    assert names(again, end, later) == ["b.csv"] and again.latestOffset() == later
    (folder / "b.csv").unlink()
    assert [b.num_rows for p in again.partitions(end, later) for b in again.read(p)] == []


def test_the_log_is_put_together(tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "COMPACT", 4)
    folder = tmp_path / "in"
    folder.mkdir()
    reader = changes.Reader({"path": str(folder), "index": str(tmp_path / "index")})
    for i in range(9):
        (folder / f"f{i % 3}.csv").write_text("x" * (i + 1))
        reader.commit(reader.latestOffset())
    kept = sorted(os.listdir(tmp_path / "index"))
    assert kept == ["8.all", "9.json"]
    assert len(json.loads((tmp_path / "index" / "8.all").read_text())) == 3
    again = changes.Reader({"path": str(folder), "index": str(tmp_path / "index")})
    assert again.latestOffset() == {"version": 9}


def test_files_that_are_being_written_wait(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("1")
    assert changes.Reader({"path": str(folder), "index": str(tmp_path / "i"), "settle": "3600"}).latestOffset() == {"version": 0}
    os.utime(folder / "a.csv", (1, 1))
    assert changes.Reader({"path": str(folder), "index": str(tmp_path / "i"), "settle": "3600"}).latestOffset() == {"version": 1}


def test_options_are_asked_for(spark, tmp_path):
    spark.dataSource.register(changes.FileChanges)
    with pytest.raises(Exception, match="index"):
        spark.readStream.format("file_changes").option("path", "/nowhere").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path)).start().processAllAvailable()


def test_a_modified_file_goes_to_gold(spark, tmp_path):
    folder, lake = tmp_path / "in", str(tmp_path / "lake")
    folder.mkdir()
    (folder / "a.csv").write_text(STANDARD)
    follow(spark, folder, tmp_path, jobs.watcher(spark, lake))
    (folder / "a.csv").write_text(STANDARD + "17/01/2024,Fuel,PSO,900,debit\n")
    follow(spark, folder, tmp_path, jobs.watcher(spark, lake))
    gold = spark.read.parquet(f"{lake}/gold")
    # both versions were taken in, as files of different contents are
    assert gold.count() == 5 and gold.where("vendor = 'PSO'").count() == 1
