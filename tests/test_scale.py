"""Hot keys in many tasks, joins that leave the large side where it is, one pass where there were several."""

import datetime as dt
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import fixed
from tallyloom.functions import scalars as S
from tallyloom.operators import medallion, membership, metadata
from tallyloom.plans import adapter, registry
from tallyloom.sources import tables
from tallyloom.streaming import watch

BASE = dt.datetime(2024, 1, 1)


def kept(rows, gap):
    """The rule: an event is kept if it is `gap` after the last one kept of its key."""
    last, out = {}, set()
    for i, key, at in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        if key not in last or at - last[key] >= gap:
            last[key] = at
            out.add(i)
    return out


@pytest.mark.parametrize("dense", [False, True])
def test_a_hot_key_is_debounced_in_many_slices(spark, dense):
    rng = random.Random(7)
    rows = [(i, "hot" if i % 10 else rng.choice(["a", "b", None]), BASE + dt.timedelta(milliseconds=rng.randrange(0, 40_000 if dense else 4_000_000))) for i in range(4000)]
    rows += [(9000 + i, "same", BASE) for i in range(300)] + [(9999, "hot", None)]
    events = spark.createDataFrame(rows, "event_id int, key string, ts timestamp")
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    seen = {}
    real = watch._edges
    try:
        out = watch.debounced(events, ["key"])
        got = {r["event_id"] for r in out.collect()}
        seen = {r["p"] for r in events.where("key = 'hot'").repartitionByRange("key", "ts").select(F.spark_partition_id().alias("p")).distinct().collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    assert got == kept(rows, dt.timedelta(seconds=2)) and watch._edges is real
    assert len(seen) > 4  # the hot key is several tasks


def test_ways_through_a_slice():
    rng = np.random.default_rng(3)
    for _ in range(60):
        at = np.sort(rng.integers(0, 200, rng.integers(1, 60)))
        gap = int(rng.integers(1, 40))
        ends, exits = watch._ways(at, gap)
        for t in range(-5, 210):
            upto = t
            for x in at.tolist():
                if x >= upto:
                    upto = x + gap
            way = int(np.searchsorted(ends, t))
            assert (exits[way] if way < len(ends) else t) == upto


def test_the_ledger_side_has_no_exchange(spark, tmp_path):
    name = "known_hashes"
    membership.drop(spark, name)
    known = spark.range(20_000).select((F.col("id") % 5).cast("int").alias("org_id"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    membership.save(known, name, ["org_id", "h"], 16)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        came = spark.range(19_000, 21_000).select((F.col("id") % 5).cast("int").alias("org_id"), F.sha2(F.col("id").cast("string"), 256).alias("h"), "id")
        new = membership.unknown(came, spark.table(name), ["org_id", "h"])
        assert sorted(r["id"] for r in new.collect()) == list(range(20_000, 21_000))
        plan = new._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        scan = plan[plan.index("Bucketed: true") - 1500 : plan.index("Bucketed: true")]
        assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 16" in plan and "Exchange" not in scan[scan.rindex("Sort") :]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        membership.drop(spark, name)


def test_a_screen_knows_all_that_is_known(spark):
    known = spark.range(3000).select(F.col("id").alias("k"), F.lit("x").alias("o"))
    parts = [membership.screen(known.where(F.col("k") % 3 == i), ["k", "o"]) for i in range(3)]
    whole = membership.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert whole.count() <= 256 and whole.select(F.max(F.length("bits"))).first()[0] == 4096
    came = spark.range(1500, 6000).select(F.col("id").alias("k"), F.lit("x").alias("o")).unionByName(spark.createDataFrame([(None, "x")], "k long, o string"))
    told = membership.screened(came, whole, ["k", "o"]).cache()
    assert told.where("k < 3000 AND NOT maybe_known").count() == 0
    assert told.where("k >= 3000 AND maybe_known").count() < 20 and told.where("k IS NULL").first()["maybe_known"] is False
    new = membership.unknown_screened(came, known, whole, ["k", "o"])
    assert sorted((r["k"] is not None, r["k"] or 0) for r in new.collect()) == [(False, 0), *((True, i) for i in range(3000, 6000))]
    assert membership.unknown_screened(came, known, membership.screen(known.limit(0), ["k", "o"]), ["k", "o"]).count() == 4501


def test_duplicates_across_micro_batches_are_dropped_once(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    schema = "h string, n int, at timestamp"

    def add(*rows):
        spark.createDataFrame([(h, n, BASE + dt.timedelta(hours=t)) for h, n, t in rows], schema).coalesce(1).write.mode("append").parquet(folder)

    def follow():
        stream = watch.new_rows(spark.readStream.schema(schema).parquet(folder), spark.createDataFrame([("old",)], "h string"), ["h"], "at", "1 day")
        watch.run(stream, lambda df, i: seen.extend((r["h"], r["n"]) for r in df.collect()), str(tmp_path / "ck"), once=True).awaitTermination(120)

    add(("a", 1, 0), ("b", 2, 1), ("a", 1, 2), ("old", 9, 0))
    follow()
    assert sorted(seen) == [("a", 1), ("b", 2)]
    add(("a", 1, 3), ("c", 3, 3), ("b", 2, 4))
    follow()  # another query on the same checkpoint
    assert sorted(seen) == [("a", 1), ("b", 2), ("c", 3)]
    # the state is bounded: keys older than a day are let go
    add(("d", 4, 100))
    follow()
    add(("e", 5, 101), ("a", 1, 101))
    follow()
    assert sorted(seen) == [("a", 1), ("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5)]


def test_the_document_is_that_of_its_parts_in_one_scan(spark):
    rng = random.Random(2)
    rows = [(None if i % 50 == 0 else dt.date(2024, rng.randrange(1, 13), 1), rng.choice([None, *"abcdefghijklmnop"]), rng.choice(["credit", "debit", None]), None if i % 40 == 0 else rng.randrange(10**6) / 100) for i in range(800)]
    df = spark.createDataFrame(rows, "txn_date date, party_name string, direction string, amount double")
    doc = metadata.document(df, 5)
    row = doc.first().asDict(recursive=True)
    assert row["totals"] == metadata.totals(df).first().asDict() and row["averages"] == metadata.averages(df).first().asDict()
    assert row["trends"] == sorted((r.asDict() for r in metadata.trends(df).collect()), key=lambda r: (r["month"] is not None, r["month"] or ""))
    assert row["top_parties"] == sorted((r.asDict() for r in metadata.top_parties(df, 5).collect()), key=lambda r: r["party_name"])
    assert doc._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    empty = metadata.document(df.limit(0)).first()
    assert empty["totals"]["transaction_count"] == 0 and empty["trends"] == [] and empty["top_parties"] == []
    plain = metadata.document(df.drop("direction")).first()
    assert plain["totals"]["income"] == 0.0 and plain["totals"]["transaction_count"] == 800


@pytest.mark.parametrize("kind", ["skewed", "dates", "texts", "few", "none"])
def test_shares_hold_every_row_once(kind):
    rng = random.Random(5)
    values = {"skewed": [1] * 500 + [rng.randrange(10**9) for _ in range(500)], "dates": [dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(400)) for _ in range(500)], "texts": [rng.choice("abc'd") * rng.randrange(1, 6) for _ in range(500)], "few": [1, 2, 2], "none": []}[kind] + [None, None]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t (id INTEGER, v {'DATE' if kind == 'dates' else 'VARCHAR' if kind == 'texts' else 'BIGINT'})")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    lows = [r[0] for r in con.execute(tables.probe("t", "v", 8)).fetchall()]
    found = [r[0] for p in tables.predicates("v", lows) for r in con.execute(f"SELECT id FROM t WHERE {p}").fetchall()]
    assert sorted(found) == list(range(len(values)))
    if kind == "dates":
        assert max(len(con.execute(f"SELECT id FROM t WHERE {p}").fetchall()) for p in tables.predicates("v", lows)) < 90


def test_shares_reach_the_reader(spark):
    asked = {}

    class Rows:
        def collect(self):
            return [{"low": 5}, {"low": 10}, {"low": 10}, {"low": 20}]

    class Reader:
        def format(self, name):
            return self

        def option(self, name, value):
            asked[name] = value
            return self

        def options(self, **more):
            asked.update(more)
            return self

        def load(self):
            return Rows()

        def jdbc(self, url, table, predicates, properties):
            asked.update(url=url, table=table, predicates=predicates, properties=properties)

    class Session:
        read = Reader()

    tables.read_shares(Session(), "jdbc:x:y", "s.t", "id", 4, user="u")
    assert asked["query"].startswith("select min(v) as low") and "ntile(4)" in asked["query"]
    assert asked["predicates"] == ["id < 10 OR id IS NULL", "id >= 10 AND id < 20", "id >= 20"] and asked["properties"] == {"user": "u"}
    for bad in (("t; drop table t", "id"), ("t", "id)")):
        with pytest.raises(ValueError, match="names"):
            tables.probe(*bad, 4)
    with pytest.raises(RuntimeError, match="no JDBC driver for jdbc:nothing"):
        tables.require_driver(spark, "jdbc:nothing://host/db")


def test_layers_are_counted_in_one_pass(spark):
    d = "/root/testdata/sf0.001"
    told = registry.QUERIES["s12_statistics"](spark, d)
    assert told._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2  # orders and customer, once each
    rows = medallion.classified(adapter.bronze(spark, d))
    good = medallion.silver(rows)
    want = medallion.statistics({"bronze": rows, "silver": good, "quarantine": medallion.quarantine(rows), "gold": medallion.promoted(good)})
    assert told.columns == want.columns and sorted(map(tuple, told.collect())) == sorted(map(tuple, want.collect()))
    assert {r["row_count"] for r in medallion.layer_statistics(rows.where("false")).collect()} == {0}


def test_patterns_run_once_a_match_and_only_where_they_can_match(spark, monkeypatch):
    rng = random.Random(13)
    parts = ["42101-1234567-9", "03001234567", "+92-300-1234567", "٣٠٠", "0٠٠٠٠٠٠٠٠٠", "3٠٠1234567", "a.b@c.pk", "@", "PK36SCBL0000001123456702", "pk36", "12345678", "Road", "ſtreet", "-", "x"]
    rows = [(i, *("".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(5))) if rng.random() < 0.9 else None for _ in range(2))) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    found = lambda: df.select("i", S.pii_matches({"a": F.col("a"), "b": F.col("b")}).alias("pii"))
    told = sorted(map(tuple, found().collect()))
    assert fixed.PII_SCREENS and {m["type"] for _, ms in told for m in ms} == set(fixed.PII_PATTERNS)
    monkeypatch.setattr(fixed, "PII_SCREENS", {})
    assert told == sorted(map(tuple, found().collect()))
    masked = df.join(found(), "i").select(S.mask_tokens(F.col("a"), F.col("pii"), "a").alias("x"))
    plan = masked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_instr(") == len(fixed.PII_PATTERNS)
