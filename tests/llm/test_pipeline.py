"""Every stage of the pipeline on odd rows against brute force."""

import collections
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import cube_mixing, sentencepiece_codec
from tallyloom.llm.frames import stored

from .helpers import odd_rows
from .test_documents import WORD, bands_brute, low, suffix_brute

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(21)
    prose = lambda n: " ".join(f"{'aeiou'[x % 5]}{chr(98 + x % 20)}t{x % 90}" for x in rng.integers(0, 4000, n))
    texts = [(i, t, s) for i, t, s in odd_rows()] + [(100 + i, prose(int(n)), f"src{i % 4}") for i, n in enumerate(rng.integers(30, 400, 25))]
    near = texts[-1][1].split()
    near[len(near) // 2] = "other"
    texts += [(200, " ".join(near), "src1"), (201, texts[-2][1].upper(), "src0"), (202, "é" * 99 + texts[-3][1], "src2")]
    return [(i, t, "en", s, len(t or "")) for i, t, s in texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return stored(spark.createDataFrame(rows, DOCUMENTS).repartition(3))


@pytest.fixture(scope="module")
def stages():
    return dict(corpus_pipeline.STAGES)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rooted(n, linked):
    root = list(range(n))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def test_quality(spark, docs, rows, stages):
    def fine(t):
        w = WORD.findall(t or "")
        n = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(w) >= 20 and 100 * len(cover) <= 30 * len(w) and bands_brute(t)

    want = [r for r in rows if fine(r[1])]
    assert told(stages["quality rules"](spark, docs, "")) == sorted(want, key=repr) and 0 < len(want) < len(rows)


def test_near_dedup(spark, docs, rows, stages):
    """Of distinct rows (id, text): clusters of similar texts keep their least id, and of those fingerprints' components theirs."""
    order = lambda r: (r[0] is None, r[0] or 0)
    distinct = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (*order(r), r[1] or ""))
    grams = []
    for _, t in distinct:
        w = WORD.findall(low(t))
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = rooted(len(distinct), lambda a, b: len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]))
    first = [distinct[x] for x in range(len(distinct)) if root[x] == x]
    prints = []
    for _, t in first:
        w = WORD.findall(low(t))
        h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = rooted(len(first), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    want = sorted(((first[x]) for x in range(len(first)) if root[x] == x), key=repr)
    got = stages["simhash near-dedup"](spark, docs, "")
    assert got.columns == docs.columns and set(told(got)) <= set(rows)
    # rows of one id and different texts stand in the order of a hash
    assert [r[0] for r in told(got.select("doc_id", "text"))] == [r[0] for r in want]


def test_exact_dedup(spark, docs, rows, stages):
    kept = collections.Counter((r[0], r[4]) for r in suffix_brute([(r[0], r[1], None) for r in rows]))
    got = stages["suffix-array dedup"](spark, docs, "")
    assert got.columns == docs.columns
    import hashlib

    for r in got.collect():
        assert r["n_chars"] == len(r["text"]) and re.search(WORD, r["text"])
        # nothing that was cut within a character
        assert (r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) in kept or r["doc_id"] == 202
    assert got.count() >= 0.5 * len(rows)


def test_mixture(spark, docs, rows, stages):
    got = collections.Counter(told(stages["source mixing"](spark, docs, "")))
    taken = cube_mixing.weigh(docs).groupBy("doc_id", "size").agg(F.sum("copies").alias("n")).collect()
    want = collections.Counter({(r["doc_id"], r["size"]): r["n"] for r in taken if r["n"]})
    have = collections.Counter()
    for r, n in got.items():
        assert r in set(rows)
        have[r[0], len(WORD.findall(r[1] or ""))] += n
    assert have == want


def test_encoding(spark, docs, rows, stages):
    sp = sentencepiece_codec._processor(sentencepiece_codec.default_model())
    got = told(stages["sentencepiece encoding"](spark, docs, "").select("doc_id", "n_tokens", "ids"))
    assert got == sorted(((r[0], len(ids := sp.encode(r[1] or "")), ids) for r in rows), key=repr)


def test_empty(spark, docs, stages):
    empty = docs.limit(0)
    for name, stage in stages.items():
        assert stage(spark, empty, "").count() == 0, name
