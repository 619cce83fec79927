"""Document operators against brute force on odd rows: nulls, blanks, ties, repeated rows, long texts, empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tallyloom.llm import cube_mixing, frames, ngram_trie, paragraph_minhash, quality_bands, sentencepiece_codec, simhash_anchors, suffix_dedup
from tallyloom.llm.frames import components, stored

from .helpers import SCHEMA, odd, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return stored(odd(spark))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sentencepiece(docs, empty):
    model = sentencepiece_codec.default_model()
    sp = sentencepiece_codec._processor(model)
    got = rows_of(sentencepiece_codec.encode(docs, model).select("doc_id", "ids", "decoded"))
    want = sorted(((i, ids := sp.encode(t or ""), sp.decode(ids)) for i, t, _ in odd_rows()), key=repr)
    assert got == want
    assert sentencepiece_codec.encode(empty, model).count() == 0


def test_chunks_hold_what_pieces_cannot_cross():
    sp = sentencepiece_codec._processor(sentencepiece_codec.default_model())
    cutter = sentencepiece_codec._cutter(sentencepiece_codec.default_model())
    for text in (" a", "a ", "  ", "a  b\n\nc d", "▁x ▁▁y", "\n", "x\n y \n"):
        chunks = sentencepiece_codec._cut(cutter, text)
        assert [i for ids in sentencepiece_codec.segment(sentencepiece_codec.default_model(), chunks) for i in ids] == sp.encode(text)


def test_quality(docs, empty):
    def base(t):
        w = WORD.findall(t or "")
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        n = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)

    got = quality_bands.rate(docs)
    assert rows_of(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted(((i, *base(t)) for i, t, _ in odd_rows()), key=repr)
    assert not got.where("base_failed and kept").count()
    assert quality_bands.keep(docs).columns == docs.columns
    assert quality_bands.keep(docs).count() == got.where("kept").count()
    assert quality_bands.rate(empty).count() == 0 == quality_bands.keep(empty).count()


def bands_brute(text):
    """The verdict of the bands: the whole ratio by length, and at most a quarter of the chunks outside theirs."""
    data, press = (text or "").encode(), zstandard.ZstdCompressor(level=3)
    if not data:
        return True
    low, high = next((a, b) for least, a, b in reversed(quality_bands.WHOLE) if len(data) >= least)
    if not low <= len(press.compress(data)) / len(data) <= high:
        return False
    cuts = [(i, i + 2048) for i in range(0, len(data) - 2047, 2048)]
    if len(data) > 2048 and len(data) % 2048:
        cuts.append((len(data) - 2048, len(data)))
    out = [not 0.44 <= len(press.compress(data[a:b])) / 2048 <= 0.66 for a, b in cuts]
    return 4 * sum(out) <= len(out)


def test_verdicts_are_those_of_the_bands(spark, docs):
    rng = np.random.default_rng(13)
    noise = lambda n: "".join(chr(x) for x in rng.integers(33, 126, n))
    prose = lambda n: " ".join(f"{'aeiou'[x % 5]}{chr(98 + x % 20)}t{x % 90}" for x in rng.integers(0, 4000, n))
    texts = [t for _, t, _ in odd_rows()] + [prose(n) for n in (20, 25, 60, 200, 341, 342, 700, 1500)] + [prose(500) + " " + noise(1500), prose(500) + " x" * 900, " ".join(noise(7) for _ in range(300)), " ".join("abcdefghijklmnopqrstuv")]
    want = []
    for t in texts:
        w = WORD.findall(t or "")
        n = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        want.append(not (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and bands_brute(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["kept"] for r in quality_bands.rate(df).orderBy("doc_id").collect()] == want and any(want) and not all(want)
    both = df.withColumn("row", F.lit(1)).withColumn("m", F.lit(2)).withColumn("n_words", F.lit("x"))
    assert sorted(r["doc_id"] for r in quality_bands.keep(both).collect()) == [i for i, k in enumerate(want) if k]


def test_bands_reject_repetition_and_noise(spark):
    rng = np.random.default_rng(5)
    noise = " ".join(bytes(rng.integers(33, 126, 9, dtype=np.uint8)).decode() for _ in range(500))
    plain = spark.createDataFrame([(1, noise)], "doc_id long, text string")
    row = quality_bands.rate(plain).first()
    assert not row["base_failed"] and not row["kept"]


def suffix_brute(rows):
    seen, out = set(), {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        data = (rows[k][1] or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone]).astype(int)) == 1).sum())
        out[k] = (rows[k][0], len(data), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return sorted(out.values(), key=repr)


@pytest.mark.parametrize(("block", "hot"), [(3000, 1), (3000, 4096), (1 << 20, 4096)])
def test_suffix_dedup(docs, empty, block, hot):
    got = suffix_dedup.repeats(docs, block=block, hot=hot)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    flat = got.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256))
    assert rows_of(flat) == suffix_brute(odd_rows())
    kept = suffix_dedup.without_repeats(docs, block=block)
    assert kept.columns == docs.columns and kept.where("text is null or text = ''").count() == 0
    assert suffix_dedup.repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [3, 4096])
def test_lines_with_many_neighbours(spark, hot):
    """Lines of 40 to 98 bytes, and ends of a passage, that all documents share with different text around them."""
    rng = np.random.default_rng(9)
    body = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    lines, passage = [body(n) for n in (40, 63, 98)], body(240)
    texts = [body(rng.integers(0, 60)).join(["", *rng.permutation([*lines, passage[: rng.integers(90, 240)], "ab" * 70]), body(8)]) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = suffix_dedup.repeats(df, block=2000, hot=hot)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    assert rows_of(got.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256))) == suffix_brute([(*r, None) for r in rows])


def test_suffix_sort_orders_and_verifies(monkeypatch):
    data = np.frombuffer(b"banana_bandana_banana_ban" * 3, np.uint8)
    h = suffix_dedup.Hashes(data)
    starts, none, most = np.arange(0, 40), np.zeros(40, np.int64), np.full(40, 20)
    order = suffix_dedup.suffix_sort(h, starts, none, most)
    texts = [data[s : s + 20].tobytes() for s in starts]
    assert [texts[i] for i in order] == sorted(texts)
    later = suffix_dedup.later_equals(h, starts, none, most)
    assert later.tolist() == [texts[i] in texts[:i] for i in range(40)]
    for lot in (1 << 20, 100, 1):
        monkeypatch.setattr(suffix_dedup, "LOT", lot)
        assert suffix_dedup.later(data, starts, most, none, none).tolist() == later.tolist()
    h.of = lambda start, length: np.zeros(len(start), np.uint64)  # all hashes collide
    assert suffix_dedup.later_equals(h, starts, none, most).tolist() == later.tolist()


def test_simhash(docs, empty):
    rows = odd_rows()
    fps = []
    for _, t, _ in rows:
        w = WORD.findall(low(t))
        h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = sorted(((r[0], f"{fps[i]:016x}", least.get(find(i))) for i, r in enumerate(rows)), key=repr)
    got = simhash_anchors.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert rows_of(got) == want
    kept = simhash_anchors.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(i) for i in range(len(rows))})
    assert simhash_anchors.near_duplicates(empty).count() == 0


def test_simhash_anchors_meet_within_two_bits():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 32, 500, dtype=np.uint64)
    for flips in range(3):
        y = x.copy()
        for _ in range(flips):
            y ^= np.uint64(1) << rng.integers(0, 32, len(y)).astype(np.uint64)
        assert all(set(a) & set(b) for a, b in zip(simhash_anchors.anchors(x).tolist(), simhash_anchors.anchors(y).tolist(), strict=True))


def test_simhash_forest_spans_dense_groups():
    rng = np.random.default_rng(1)
    fps = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 20, 5000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 5000).astype(np.uint64)))
    assert len(simhash_anchors._forest(fps, 4)) == len(fps) - 1


def test_mixing(docs, empty):
    rows = odd_rows()
    got = cube_mixing.weigh(docs)
    size = lambda t: len(WORD.findall(t or ""))
    sums = collections.Counter()
    for _, t, s in rows:
        sums[s] += size(t)
    names = sorted((s for s in sums if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, full = sum(sums.values()), set()
    while True:
        level = (total - sum(3 * sums[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and level * weight[s] > 3 * sums[s]}
        if not over:
            break
        full |= over
    target = {s: 3 * sums[s] if s in full else level * weight[s] for s in names}
    found = got.collect()
    assert len(found) == len(rows)
    by_id = {(r["doc_id"], r["size"]): r for r in found}
    for i, t, s in rows:
        if i not in (8, 15):
            r = by_id[i, size(t)]
            assert r["source_size"] == sums[s] and r["target"] == pytest.approx(target[s])
            assert 0 <= r["taken"] <= 3 * r["size"]
    taken = got.groupBy("source_size", "target").agg(F.sum("taken").alias("n")).collect()
    largest = collections.defaultdict(int)
    for _, t, x in rows:
        largest[sums[x]] = max(largest[sums[x]], size(t))
    # what a source misses is less than half its largest document, and little where documents are many
    assert all(abs(r["n"] - r["target"]) <= 0.5 * largest[r["source_size"]] for r in taken)
    assert rows_of(got) == rows_of(cube_mixing.weigh(docs.repartition(2)))
    mixed = cube_mixing.take(docs)
    assert mixed.columns == docs.columns and mixed.count() == got.agg(F.sum("copies")).first()[0]
    assert cube_mixing.weigh(empty).count() == 0


def test_every_source_comes_near_its_target(spark):
    rng = np.random.default_rng(31)
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 5}" if i % 11 else None) for i, n in enumerate(rng.geometric(0.01, 3000))]
    rows += [(9000, rows[7][1], "s2")] + [(9001, "a b c", "s1")] * 500
    taken = cube_mixing.weigh(spark.createDataFrame(rows, SCHEMA)).groupBy("source_size", "target").agg(F.sum("taken").alias("n"), F.count("*").alias("rows")).collect()
    assert sum(r["rows"] for r in taken) == len(rows) and len(taken) == 6
    assert all(abs(r["n"] - r["target"]) <= 0.002 * r["target"] for r in taken)


def test_flight_keeps_its_balance():
    rng = np.random.default_rng(2)
    p, x = rng.uniform(0, 1, 400), rng.integers(1, 900, 400).astype(float)
    out = cube_mixing.flight(p, x, rng.uniform(0, 1, 400))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * x).sum() == pytest.approx((p * x).sum())
    flown = np.array([cube_mixing.flight(p[:20], x[:20], c) for c in rng.uniform(0, 1, (3000, 20))])
    assert np.abs(flown.mean(0) - p[:20]).max() < 0.06


def test_landing_keeps_documents_and_words():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 15, 50, 400):
        for _ in range(20):
            p, x, coins = rng.uniform(0, 1, n), np.sort(rng.geometric(0.002, n))[::-1].astype(float), rng.uniform(0, 1, n)
            out = cube_mixing.final(p, x, coins)
            assert set(out) <= {0.0, 1.0} and abs(out.sum() - p.sum()) < 1
            if n >= 50:
                assert abs((out * x).sum() - (p * x).sum()) < 0.002 * (p * x).sum() + 20
            # what the flight decided stays
            open_ = cube_mixing.flight(p, x, coins)
            land = cube_mixing.landing(open_, x, coins)
            assert (land == open_)[(open_ == 0) | (open_ == 1)].all() and abs(land.sum() - p.sum()) < 1


def test_documents_of_a_source_are_balanced_too(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = cube_mixing.weigh(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "source_size", "target").agg(F.sum("copies").alias("copies"), F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    for r in got:
        assert abs(r["copies"] - r["n"] * r["target"] / r["source_size"]) < 1
        assert abs(r["taken"] - r["target"]) < 0.005 * r["target"]


@pytest.mark.parametrize("order", [2, 3])
def test_scores(docs, empty, order):
    rows = odd_rows()
    toks = [WORD.findall(low(t)) + [" "] for _, t, _ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in rows]
    count = collections.Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted(((i, h, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)) for (i, _, _), t, h in zip(rows, toks, held, strict=True)), key=repr)
    got = ngram_trie.scores(docs, order=order, block=2000)
    assert rows_of(got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6))) == want
    one = got.agg(F.sum("score"), F.sum("base_score")).first()
    assert one[1] < one[0] < 0
    assert rows_of(got.select("doc_id", F.round("score", 6))) == rows_of(ngram_trie.scores(docs, order=order).select("doc_id", F.round("score", 6)))
    assert ngram_trie.scores(empty).count() == 0


def backoff_brute(rows, order):
    """The score of each row by dictionaries, with the same quantised numbers."""
    toks = [WORD.findall(low(t)) + [" "] for _, t, _ in rows]
    train = [t for t, (i, _, _) in zip(toks, rows, strict=True) if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    one = lambda x, grid: float(ngram_trie.restored(ngram_trie.quantised(np.array([x]), grid), grid)[0])
    counts = [collections.Counter() for _ in range(order + 1)]
    context = lambda t, j, k: tuple(t[x] if x >= 0 else None for x in range(j - k + 1, j))
    for t in train:
        for j, w in enumerate(t):
            for k in range(1, order + 1):
                counts[k][context(t, j, k), w] += 1
    n, v = sum(counts[1].values()), len(counts[1])
    after = [collections.defaultdict(dict) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for (h, w), c in counts[k].items():
            after[k][h][w] = c
    discount = lambda own: (sum(c == 1 for c in own.values()) + 3.0) / (sum(c == 1 for c in own.values()) + 2 * sum(c == 2 for c in own.values()) + 4.0)

    def p(k, h, w):
        if k == 1:
            return one(math.log10((counts[1][(), w] + 1) / (n + v + 1)), ngram_trie.P_GRID)
        own = after[k].get(h)
        if own is None:
            return p(k - 1, h[1:], w)
        d, total = discount(own), sum(own.values())
        if w in own:
            return one(math.log10((own[w] - d) / total), ngram_trie.P_GRID)
        seen = sum(10 ** one(p(k - 1, h[1:], x), ngram_trie.P_GRID) for x in own)
        return p(k - 1, h[1:], w) + one(math.log10(d * len(own) / total / max(1 - seen, 1e-5)), ngram_trie.A_GRID)

    return [sum(p(order, context(t, j, order), w) for j, w in enumerate(t)) for t in toks]


@pytest.mark.parametrize("order", [2, 3])
def test_scores_are_those_of_a_backoff_model(spark, order):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(f"w{min(rng.geometric(0.08), rng.integers(1, 60))}" for _ in range(rng.integers(0, 60))), None) for i in range(70)] + [(None, "w1 W2 w1 w2", None), (3, None, None), (3, None, None)]
    want = sorted(((r[0], round(x, 5)) for r, x in zip(rows, backoff_brute(rows, order), strict=True)), key=repr)
    df = stored(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = []
    for parts in ("4", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got.append(rows_of(ngram_trie.scores(df, order=order, block=1000).select("doc_id", F.round("score", 5))))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == want


def test_keys_that_lie_are_told_apart(monkeypatch):
    heads = [np.array([[5, 6, 5], [7, 8, 9]], np.uint64), np.array([[6], [8]], np.uint64)]
    monkeypatch.setattr(ngram_trie, "_context", lambda words: np.ones(len(words[0]), np.uint64))
    keys, rank = ngram_trie._contexts(heads)
    assert keys[1] == keys[3] and len(set(keys.tolist())) == 3 and (rank == keys).all()


def test_scores_are_those_of_trigrams(spark):
    # after "a b" always c, after "x b" always d: only a trigram knows which
    texts = [(i, f"a b c u{i} x b d v{i}") for i in range(40)]
    df = stored(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    score = lambda f: f.agg(F.sum("score")).first()[0]
    assert ngram_trie.ORDER == 3
    assert score(ngram_trie.scores(df)) == score(ngram_trie.scores(df, order=3)) > score(ngram_trie.scores(df, order=2))


def test_trie_searches_like_numpy(tmp_path):
    rng = np.random.default_rng(7)
    for n, top in ((0, 1), (1, 9), (500, 90), (500, 1 << 40)):
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        wanted = np.append(rng.integers(0, 2 * top, 300).astype(np.uint64), values)
        low = rng.integers(0, n + 1, len(wanted))
        high = rng.integers(low, n + 1)
        got = ngram_trie.EliasFano(values, str(tmp_path), f"n{n}t{top}").successor(wanted, low, high)
        assert (got == np.clip(np.searchsorted(values, wanted), low, high)).all()


def test_the_grid_of_probabilities_reaches_below_unknown_words():
    assert ngram_trie.p_grid(10**6, 10**5) == ngram_trie.P_GRID
    for n in (10**10, 10**13, 10**18):
        grid = ngram_trie.p_grid(n, n // 100)
        x = np.log10(np.array([1, 30, 1000]) / (n + n // 100 + 1))
        assert np.abs(ngram_trie.restored(ngram_trie.quantised(x, grid), grid) - x).max() <= -grid[0] / 510 + 1e-9


def test_trie_level_answers_like_a_dictionary(tmp_path):
    rng = np.random.default_rng(4)
    context, word = rng.integers(0, 1 << 62, 60, dtype=np.uint64)[rng.integers(0, 60, 900)], rng.integers(1, 80, 900).astype(np.uint64)
    pairs = np.unique(np.column_stack([context, word]), axis=0)
    count = rng.integers(1, 9, len(pairs))
    lower = np.full(len(pairs), -3.0)
    level = ngram_trie.Level(pairs[:, 0], pairs[:, 1], count, lower, str(tmp_path))
    said = level.answer(pairs[:, 0], pairs[:, 1])
    own = {c: count[pairs[:, 0] == c] for c in np.unique(context)}
    d = {c: ((k == 1).sum() + 3.0) / ((k == 1).sum() + 2 * (k == 2).sum() + 4.0) for c, k in own.items()}
    p = np.array([(k - d[c]) / own[c].sum() for c, k in zip(pairs[:, 0], count, strict=True)])
    assert np.abs(ngram_trie.restored(said, ngram_trie.P_GRID) - np.log10(p)).max() < 0.021
    missing = level.answer(np.sort(np.unique(context)), np.full(len(np.unique(context)), 500, np.uint64))
    assert ((missing >= 256) & (missing < 512)).all()
    assert (level.answer(np.array([5], np.uint64), np.array([1], np.uint64)) == ngram_trie.NO_CONTEXT).all()


def paragraph_brute(rows, least=5):
    """(id, paragraphs, removed lines) of each row: classes of similar lines, the first by id, text hash and line stays."""
    found = []
    for k, (i, t) in enumerate(rows):
        for line, body in enumerate((t or "").split("\n")):
            w = WORD.findall(low(body))
            if len(w) >= least:
                found.append((k, line, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))))
    root = list(range(len(found)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for x in range(len(found)):
        for y in range(x):
            both = len(found[x][2] & found[y][2])
            if both >= 0.8 * (len(found[x][2]) + len(found[y][2]) - both):
                root[find(x)] = find(y)
    return found, [find(x) for x in range(len(found))]


def test_paragraphs(spark, empty):
    rng = np.random.default_rng(6)
    body = lambda n: [f"t{x}" for x in rng.integers(0, 5000, n)]
    rows, frame = [], body(40)
    for i in range(60):
        base = body(rng.integers(5, 90))
        lines = [base]
        for _ in range(rng.integers(0, 4)):
            near = list(base)
            near[rng.integers(len(near))] = f"other{i}"
            lines.append(near)
        # lines with much, but not enough, in common
        lines.append(frame[: rng.integers(20, 40)] + body(12))
        lines.append(["Short", "line"])
        rows.append((i % 50 if i % 7 else None, "\n".join(" ".join(x) for x in lines)))
    rows += [(70, None), (71, ""), (72, "\n \n"), (73, rows[3][1]), (74, rows[3][1].upper()), (75, "five words of a text"), (75, "five words of a text"), (76, "Five words of a text\nfive words of a text"), (77, " ".join(body(20000)))]
    rows += [(80, "p q r s t u"), (80, "p q r s t u"), (81, "p q r s t u")]
    df = stored(spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.lit(1)).withColumn("id", F.lit("x")).repartition(3))
    found, root = paragraph_brute(rows)
    ties = {(r["doc_id"], r["text"]): r["t"] for r in df.select("doc_id", "text", F.xxhash64("text").alias("t")).collect()}
    order = sorted(range(len(found)), key=lambda x: (rows[found[x][0]][0] is None, rows[found[x][0]][0] or 0, ties[rows[found[x][0]]], found[x][0], found[x][1]))
    first = {}
    for x in order:
        first.setdefault(root[x], x)
    want = [[i, 0, []] for i, _ in rows]
    for x, (k, line, _) in enumerate(found):
        want[k][1] += 1
        want[k][2] += [line] if first[root[x]] != x else []
    got = paragraph_minhash.summary(df)
    assert rows_of(got.select("doc_id", "n_paragraphs", "removed_lines")) == sorted(map(tuple, want), key=repr)
    assert got.where("n_removed <> size(removed_lines)").count() == 0
    assert paragraph_minhash.summary(empty).count() == 0 == paragraph_minhash.removals(empty).count()


def test_short_paragraphs_are_removed(spark):
    rows = [(i, f"One line that has just nine words, no more\nfive words of text {i}\nhas four words only") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(paragraph_minhash.summary(df).select("doc_id", "n_paragraphs", "n_removed")) == [(i, 2, int(i > 0)) for i in range(6)]
    assert rows_of(paragraph_minhash.summary(df, min_words=1).select("doc_id", "n_paragraphs", "n_removed")) == [(i, 3, 2 * int(i > 0)) for i in range(6)]


def test_passages_within_lines_are_removed(spark, empty):
    rng = np.random.default_rng(31)
    body = lambda n: [f"t{x}" for x in rng.integers(0, 50_000, n)]
    say = " ".join
    rows, planted, licence = [], {}, "Released under a licence of nine words"
    for i in range(40):
        passage, at = body(60), 1000 + 3 * i
        # within long lines, over two of them, and in upper case
        rows += [(at, say(body(37) + passage + body(45))), (at + 1, say(body(30)) + "\n" + say(body(11) + passage[:25]) + "\n" + say(passage[25:] + body(26)))]
        rows.append((at + 2, say(body(80)) + "\n" + say(body(9) + [w.upper() for w in passage] + body(70)) + "\n" + licence))
        planted[at + 1] = planted[at + 2] = set(passage)
    # lines of seven words that make up a passage, a line of its own, a near copy, and lines that repeat alone
    verse, line = [body(7) for _ in range(9)], body(30)
    near = [*line[:29], "other"]
    rows += [(1, say(body(30)) + "\n" + "\n".join(map(say, verse))), (2, licence + "\n" + "\n".join(map(say, verse[1:6])) + "\n" + say(body(12)))]
    rows += [(3, say(line)), (4, say(body(25)) + "\n" + say(near)), (5, licence + "\n" + say(body(40))), (6, None), (7, say(verse[0]))]
    rows += [(8, "\n".join(say(body(6)) for _ in range(4)))] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(paragraph_minhash.passages(df).collect(), key=lambda r: (r["doc_id"], r["n_removed"]))
    by = {r["doc_id"]: r for r in got}
    # where only one of the copies has a line's end inside, fewer words are left to be cut alike
    assert sum(by[i]["n_removed"] > 0 for i in planted if i % 3 == 1002 % 3) >= 0.95 * len(planted) / 2
    assert sum(by[i]["n_removed"] > 0 for i in planted) >= 0.85 * len(planted)
    texts = dict(rows)
    for i, words in planted.items():
        for p in by[i]["removed_pieces"]:
            found = texts[i].split("\n")[p["line"]].split()[p["word"] : p["word"] + p["size"]]
            assert len(found) == p["size"] >= paragraph_minhash.PIECE and set(map(str.lower, found)) <= words
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] in (1, 3, 5, 6, 7) or r["doc_id"] >= 1000 and r["doc_id"] % 3 == 1000 % 3)
    # sequences of 21 words: of five lines the first three begin one
    assert [tuple(p) for p in by[2]["removed_pieces"]] == [(1, 0, 21), (2, 0, 21), (3, 0, 21)] and by[2]["n_removed"] == 3
    assert by[4]["removed_lines"] == [1] and by[4]["removed_pieces"] == []
    assert by[5]["short_repeats"] == [0] and by[7]["short_repeats"] == [0] and by[5]["n_short_repeats"] == 1
    assert [(r["n_removed"], r["n_short_repeats"]) for r in got if r["doc_id"] == 8] == [(0, 0), (1, 4)]
    # all that summary() removes is told as removed or as a short repeat, and no more lines
    same = paragraph_minhash.summary(df).select("doc_id", "n_paragraphs", "removed_lines")
    both = paragraph_minhash.passages(df).select("doc_id", "n_paragraphs", F.sort_array(F.concat("removed_lines", "short_repeats")))
    assert rows_of(same) == rows_of(both)
    assert paragraph_minhash.passages(empty).count() == 0


def test_equal_halves_of_hashes_remove_nothing(spark):
    # classes 7 of checks 1 and 2 share a name; 1 was verified and is linked to 3, 2 stands alone
    final = spark.createDataFrame([(7, 1, 3), (3, 5, 3)], "node long, check long, root long")
    told = spark.createDataFrame([(1, 0, [0, 1, 2], [3, 7, 7], [5, 1, 2]), (2, 0, [0, 1], [7, 9], [2, 1]), (3, 0, [0, 1], [9, 3], [2, 6])], "id long, tie long, lines array<int>, pids array<long>, checks array<long>")
    gone = paragraph_minhash._removed(told, final).where("removed")
    assert sorted((r["id"], r["line"]) for r in gone.collect()) == [(1, 1), (2, 0)]
    halves = {paragraph_minhash._halves(f"body {i}".encode()) for i in range(1000)}
    assert len({p for p, _ in halves}) == len({c for _, c in halves}) == 1000 and all(-(1 << 63) <= x < 1 << 63 for h in halves for x in h)


def test_prefix_pairs_lose_nothing(spark):
    rng = np.random.default_rng(3)
    pool = [f"w{x}" for x in range(60)]
    bodies = [" ".join(pool[j] for j in sorted(rng.choice(60, rng.integers(30, 58), replace=False))) for _ in range(120)]
    sets = spark.createDataFrame([(i, i // 3, b.encode()) for i, b in enumerate(bodies)], "pid long, root long, body binary")
    got = {tuple(r) for r in paragraph_minhash.prefix_pairs(paragraph_minhash.ranked(sets), sets.select("pid", "root"), 0.6).collect()}
    grams = [set(zip(*(b.split()[k:] for k in range(5)), strict=False)) for b in bodies]
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if i // 3 != j // 3 and len(grams[i] & grams[j]) >= 0.6 * len(grams[i] | grams[j])}
    assert want and want <= got


def test_near_dedup_leaves_no_similar_pair(spark, docs, empty):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    rows, sets = [], []
    for i in range(12):
        base = [f"t{x}" for x in rng.integers(0, 5000, 200)]
        near = list(base)
        for k in range(3):
            near[20 + 60 * k] = "other"
        rows += [(2 * i, "\n".join(base)), (2 * i + 1, " ".join(near))]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 24, 2))
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    for r in kept.collect():
        w = WORD.findall(low(r["text"]))
        mine = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        assert not any(len(mine & x) >= 0.8 * len(mine | x) for x in sets)
        sets.append(mine)
    assert corpus_pipeline.near_dedup(spark, empty, "").count() == 0


@pytest.mark.parametrize("crowd", [0, 100_000])
def test_components(spark, monkeypatch, crowd):
    monkeypatch.setattr(frames, "CROWD", crowd)
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (7, 7), (5, None)] + [(100, 100 + i) for i in range(1, 50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[4] == 1 and got[11] == 10 and got[149] == 100 and 7 not in got and len(got) == 4 + 2 + 50
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(17)
    for n, m in ((300, 200), (300, 400), (120, 119)):
        edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))] if m != 119 else [(i, i + 1) for i in range(119)]
        root = list(range(n))

        def find(x, root=root):
            return x if root[x] == x else find(root[x])

        for a, b in edges:
            root[max(find(a), find(b))] = min(find(a), find(b))
        want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
        got = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


def test_a_shared_folder_is_needed_on_a_cluster(spark):
    class Context:
        master = "yarn"
        getCheckpointDir = lambda self: None
        getConf = lambda self: {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        frames.shared_folder(Session())


def test_extra_columns_may_have_any_name(spark, docs):
    """Columns named like those that the operators use inside."""
    names = ["id", "row", "key", "tie", "at", "n", "nth", "size", "fp", "root", "rest", "left", "block", "bucket", "lines", "pids", "kind", "rows", "copies", "m", "kept", "spans", "a", "b", "first"]
    many = docs.drop("n").select("doc_id", "text", "source", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    plain = docs.drop("n")
    for f in (quality_bands.keep, suffix_dedup.without_repeats, simhash_anchors.representatives, paragraph_minhash.different, cube_mixing.take):
        got = f(many)
        assert got.columns == many.columns, f
        assert rows_of(got.select("doc_id", "text")) == rows_of(f(plain).select("doc_id", "text")), f
    for f in (quality_bands.rate, paragraph_minhash.summary, suffix_dedup.repeats, simhash_anchors.near_duplicates, cube_mixing.weigh, ngram_trie.scores):
        assert rows_of(f(many)) == rows_of(f(plain)), f
