"""Operators on other tables, SQL of this subpackage, and the pipeline."""

import datetime as dt
import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import ORACLES, QUERIES, chat_rotation, itq_neighbors, url_lists
from tallyloom.llm.frames import stored

DATA = "/root/testdata/sf0.001"


def test_vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 32))
    vectors = np.concatenate([c + 0.12 * rng.standard_normal((rng.integers(1, 12), 32)) for c in centres]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000 + i, vectors[i].tolist()) for i in range(5)]
    odd = [(2000, None), (2001, [0.0] * 32), (2002, [None] + [1.0] * 31), (2003, [float("nan")] * 32), (2004, [1.0, 2.0]), (2005, [float("inf")] * 32), (None, vectors[0].tolist())]
    got = {r["vec_id"]: r for r in itq_neighbors.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()}
    unit = np.array([r[1] for r in rows + odd[-1:]], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    have = np.array([got[r[0]]["n_links"] for r in rows + odd[-1:]])
    assert (have <= want).all() and have.sum() >= 0.95 * want.sum()
    assert got[1000]["component_id"] == got[0]["component_id"] == 0 and got[0]["kept"] and not got[1000]["kept"]
    for i in range(2000, 2006):
        assert tuple(got[i])[1:] == (0, i, True)
    assert itq_neighbors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def planted(rng, n, size, low=0.9, high=0.95):
    a = rng.standard_normal((n, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = rng.standard_normal((n, size))
    off -= (off * a).sum(1, keepdims=True) * a
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    c = rng.uniform(low, high, (n, 1))
    return np.concatenate([a, c * a + np.sqrt(1 - c * c) * off])


@pytest.mark.parametrize("around", [0.0, 0.25])
def test_recall_near_the_threshold(spark, around):
    """Vectors of three lengths in one table; around: how far all of a length point one way."""
    rng, rows, want, parts = np.random.default_rng(11), [], {}, []
    for size in (64, 128, 768):
        v = planted(rng, 300, size) + around * np.ones(size) / np.sqrt(size)
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        near = unit @ unit.T >= 0.9
        parts.append((len(rows), near))
        rows += [(len(rows) + i, x.tolist()) for i, x in enumerate(v)]
    rows += [(9000, [3.0, 4.0]), (9001, [3.0, 4.0]), (9002, [6.0, 8.0]), (9003, [0.0, -0.0])]
    got = {r["vec_id"]: r for r in itq_neighbors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for start, near in parts:
        have = np.array([got[start + i]["n_links"] for i in range(len(near))])
        links = near.sum(1) - 1
        assert (have <= links).all() and have.sum() >= 0.95 * links.sum()
        root = list(range(len(near)))

        def find(x, root=root):
            return x if root[x] == x else find(root[x])

        for i, j in zip(*np.nonzero(near), strict=True):
            root[max(find(i), find(j))] = min(find(i), find(j))
        same = sum(got[start + i]["component_id"] == start + find(i) for i in range(len(near)))
        assert same >= 0.95 * len(near)
    assert [tuple(got[i])[1:] for i in (9000, 9001, 9002)] == [(2, 9000, True), (2, 9000, False), (2, 9000, False)]
    assert tuple(got[9003])[1:] == (0, 9003, True)


def test_tiny_and_huge_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(50)]
    base, near = rng.standard_normal(64), rng.standard_normal(64)
    for at, scale in ((100, 1e-170), (200, 1e160), (300, 1e300), (400, 5e-324)):
        one = base if scale > 1e-300 else np.round(base * 1000)  # denormal numbers hold few digits
        rows += [(at, (one * scale).tolist()), (at + 1, ((one + 0.02 * near * np.abs(one).max()) * scale).tolist()), (at + 2, (3 * one * scale).tolist())]
        base = rng.standard_normal(64)
    rows.append((500, [1e-170] * 64))
    got = {r["vec_id"]: r for r in itq_neighbors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for at in (100, 200, 300, 400):
        assert [(got[at + i]["n_links"], got[at + i]["component_id"]) for i in range(3)] == [(2, at)] * 3
    assert got[500]["n_links"] == 0 and sum(got[i]["n_links"] for i in range(50)) == 0


@pytest.mark.parametrize("size", [2, 3, 4, 8, 16, 64, 256])
def test_learned_projections_bring_pairs_together(size):
    rng = np.random.default_rng(size)
    around = rng.standard_normal(size)
    for sample in (rng.standard_normal((3000, size)), np.abs(rng.standard_normal((3000, size))), around + 0.2 * rng.standard_normal((3000, size)) / size**0.5, rng.standard_normal((5, size))):
        assert itq_neighbors.chance(sample[:2000], itq_neighbors.fitted(sample, 0.9), 0.9) >= 0.95


def test_rare_lengths_get_a_fit(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(8 if i % 400 else 24).tolist()) for i in range(2000)]
    classes = spark.createDataFrame(rows, "cid long, vector array<double>")
    assert set(itq_neighbors.models(classes, 0.9)) == {8, 24}


def test_codes_two_bits_apart_meet_once():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    flips = np.append(0, 1 << np.arange(16)).astype(np.uint64)
    for turned in range(3):
        b = a.copy()
        for bit in range(turned):
            b ^= np.uint64(1) << rng.integers(8 * bit, 8 * bit + 8, 3000).astype(np.uint64)
        times = np.zeros(3000, int)
        for flip in flips:
            key = (a ^ flip) & np.uint64(0xFFFF)
            held = np.bitwise_count(key ^ (b & np.uint64(0xFFFF))) <= 1
            times += held & itq_neighbors.meet(key, a, b)
        assert (times == 1).all()


def test_hot_values_are_cut_in_cells(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.standard_normal(64) + 0.2 * rng.standard_normal((300, 64))
    df = stored(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "cid long, vector array<double>"))
    whole = sorted(map(tuple, itq_neighbors.links(df).select("a", "b").collect()))
    monkeypatch.setattr(itq_neighbors, "LOT", 40)
    cut = itq_neighbors.links(df).select("a", "b").collect()
    assert sorted((min(r), max(r)) for r in cut) == sorted((min(r), max(r)) for r in whole) and len(whole) > 20_000


def test_url_lists(spark):
    day = lambda d: dt.date(2024, 1, d)
    changes = spark.createDataFrame([("bad.com", day(5), "add"), ("bad.com", day(10), "remove"), ("x.bad.com", day(20), "add"), (None, day(1), "add"), ("bad.com", day(5), "add")], "entry string, on date, action string")
    rows = [(1, "http://www.bad.com/a", day(4)), (2, "http://u@www.BAD.com:80/a", day(5)), (3, "https://bad.com", day(10)), (4, "http://x.bad.com", day(25)), (5, None, day(6)), (6, "notaurl", day(6)), (7, "http://bad.com", None), (2, "http://u@www.BAD.com:80/a", day(5)), (8, "http://notbad.com", day(6))]
    got = sorted((r["page_id"], r["n_active"], r["blocked"]) for r in url_lists.active(spark.createDataFrame(rows, "page_id long, url string, fetched date").withColumn("host", F.lit(1)), changes).collect())
    assert got == [(1, 0, False), (2, 1, True), (2, 1, True), (3, 0, False), (4, 1, True), (5, 0, False), (6, 0, False), (7, 0, False), (8, 0, False)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date")
    odd = captures.withColumn("h", F.lit(1)).withColumn("day", F.lit(2)).withColumn("row", F.lit(3)).withColumn("entry", F.lit(4))
    done = url_lists.active(odd, changes)
    assert done.columns == ["page_id", "url", "fetched", "h", "day", "row", "host", "n_active", "entry", "blocked"]
    assert sorted((r["page_id"], r["n_active"], r["blocked"]) for r in done.collect()) == got
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date")
    assert url_lists.active(captures, changes.limit(0)).where("blocked").count() == 0
    assert url_lists.active(captures.limit(0), changes).count() == 0


def test_hosts(spark):
    urls = ["http://[2001:DB8::1]:8080/x", "https://[::1]/", "http://1.2.3.4:80/", "ftp://u:p@a.B.c/", "http://", "mailto:x", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(url_lists.host_of(F.col("url"))).collect()] == ["[2001:db8::1]", "[::1]", "1.2.3.4", "a.b.c", None, None, None]
    changes = spark.createDataFrame([("3.4", dt.date(2024, 1, 1), "add"), ("[::1]", dt.date(2024, 1, 1), "add"), ("c", dt.date(2024, 1, 1), "add")], "entry string, on date, action string")
    done = url_lists.active(df.withColumn("fetched", F.lit(dt.date(2024, 2, 1))), changes)
    assert {r["host"] for r in done.where("blocked").collect()} == {"[::1]", "a.b.c"}


def test_odd_forms_do_not_slip_past_an_entry(spark):
    urls = ["http://ex.com./a", "http://ex.com\\@evil.org/", "http://a@b@ex.com:80/", "HTTP://WWW.EX.COM..", "http://user@/", "http://.../", "http://u:p@[::1]:8/", "http://notex.com/", "http://x\n@ex.com"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("fetched", F.lit(dt.date(2024, 2, 1)))
    changes = spark.createDataFrame([(" Ex.COM. ", dt.date(2024, 1, 1), "add"), ("  ", dt.date(2024, 1, 1), "add"), (".", dt.date(2024, 1, 1), "add"), (None, dt.date(2024, 1, 1), "add")], "entry string, on date, action string")
    got = sorted((r["page_id"], r["host"], r["entry"]) for r in url_lists.active(df, changes).collect())
    hosts = ["ex.com", "ex.com", "ex.com", "www.ex.com", None, None, "[::1]", "notex.com", "ex.com"]
    assert got == [(i, h, "ex.com" if h and h.removeprefix("www.") == "ex.com" else None) for i, h in enumerate(hosts)]


def test_as_of_agrees_with_all_intervals(spark):
    rng = np.random.default_rng(5)
    start = dt.date(2024, 1, 1)
    log = [(f"d{rng.integers(4)}.com", start + dt.timedelta(int(rng.integers(90))), ["add", "remove"][rng.integers(2)]) for _ in range(120)]
    asked = [(f"d{i}.com", start + dt.timedelta(d)) for i in range(5) for d in range(-2, 95)]
    last = {}
    for e, on, action in sorted(set(log)):
        last.setdefault(e, {})[on] = action
    want = {(e, d) for e, d in asked if (on := max((x for x in last.get(e, {}) if x <= d), default=None)) and last[e][on] == "add"}
    valid = url_lists.intervals(spark.createDataFrame(log, "entry string, on date, action string"))
    assert {tuple(r) for r in url_lists.as_of(spark.createDataFrame(asked, "entry string, day date"), valid).collect()} == want


def test_chat(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo"), (1, 2, None, None), (1, 5000, "ann", "bye"), (None, 0, "x", "y"), (2, 0, None, "z"), (1, 1, "bob", "yo")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["perspective"]): r for r in chat_rotation.dialogues(chat_rotation.rotate(df)).collect()}
    assert set(got) == {(1, "ann"), (1, "bob")}
    ann = got[1, "ann"]
    assert ann["rendered"] == "<|assistant|>\nhi\n<|end|>\n" + "<|user name=bob|>\nyo\n<|end|>\n" * 2 + "<|user name=unknown|>\n\n<|end|>\n<|assistant|>\nbye\n<|end|>\n"
    assert [ann["rendered"][m["start"] : m["end"]] for m in ann["mask"]] == ["hi\n<|end|>\n", "bye\n<|end|>\n"]
    assert chat_rotation.rotate(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    want = con.execute(f"select {', '.join(names)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, want))


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline as pipe
    from tallyloom.llm import sentencepiece_codec as codec

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in pipe.STAGES[:-1]:
        rows = stage(spark, docs, DATA).collect()
        assert rows and set(rows[0].asDict()) == set(docs.columns)
        docs = spark.createDataFrame(rows, docs.schema)
    sp = codec._processor(codec.default_model())
    want = sorted((r["doc_id"], tuple(sp.encode(r["text"]))) for r in rows)
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in pipe.run(spark, DATA).collect()) == want
