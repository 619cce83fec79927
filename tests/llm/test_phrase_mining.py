"""Operator 11 against plain counting."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tallyloom.llm import phrase_mining
from tallyloom.llm.frames import Tables


def counted(rows):
    found, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                found.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return {p: c for p, c in found.items() if c >= 30}, n


def brute(rows, top):
    f, n = counted(rows)
    most = Counter()
    for (lang, words), c in f.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                most[lang, words[i : i + size]] = max(most[lang, words[i : i + size]], c)
    out = []
    for lang in n:
        own = []
        for (la, words), a in f.items():
            if la == lang and len(words) > 1 and 100 * most[la, words] < 80 * a:
                cuts = [(2000000 * a // (f[la, words[:k]] + f[la, words[k:]]), k) for k in range(1, len(words))]
                score, k = min(cuts)
                own.append((-score, -a, " ".join(words).encode(), " ".join(words), f[la, words[:k]], f[la, words[k:]]))
        out += [(lang, i + 1, p, -a, left, right, n[lang], -s) for i, (s, a, _, p, left, right) in enumerate(sorted(own)[:top])]
    return sorted(out)


def texts():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)] + ["The", "the", "Ünder", "漢字", "x y", "a"]
    idioms = ["new york city hall", "by the way", "as well as", "the the the the the", "Grand Hotel"]
    rows = []
    for i in range(900):
        body = []
        for _ in range(rng.randrange(0, 40)):
            body.append(rng.choice(idioms) if rng.random() < 0.2 else rng.choice(words))
            body.append(rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!?", "\x0b"]))
        rows.append(("".join(body), rng.choice(["en", "en", "de", None, ""])))
    rows += [(None, "en"), ("", None), (" \n ", "fr"), ("alone", "xx"), ("very long " * 30000, "long"), ("copy of this phrase. " * 3, "en")] + [("copy of this phrase here", "en")] * 40
    return rows


def run(df, top=2000):
    return sorted(tuple(r) for r in phrase_mining.collocations(df, top=top).collect())


def test_collocations_equal_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "SALTS", 3)
    rows = texts()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(7).withColumns({"n": F.lit(1), "shard": F.lit("clash"), "words": F.lit(None).cast("string")})
    assert run(df) == brute(rows, 2000)
    assert run(df.repartition(3), 7) == brute(rows, 7)


def test_counts_are_whole_cycles(spark):
    rows = texts()
    tables = Tables(spark)
    table = tables.put(phrase_mining.encoded(spark.createDataFrame(rows, "text string, lang string").repartition(11)), "shard")
    want, _ = counted(rows)
    found = phrase_mining.phrases(table, Tables(spark), 5).collect()
    assert {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in found} == want
    assert all(r["counted"] == r["f"] for r in found)  # what the scans counted by hash


def test_few_slots_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "SLOT_BITS", 15)
    rows = texts()[:400]
    assert run(spark.createDataFrame(rows, "text string, lang string").repartition(4)) == brute(rows, 2000)


def test_slots_set_early_by_other_phrases_lose_no_count(spark, monkeypatch):
    # words reach 30 in different scans, and with 2^10 slots most phrases share one that was set before they were active
    monkeypatch.setattr(phrase_mining, "SLOT_BITS", 10)
    rng = random.Random(4)
    idioms = [" ".join(f"v{rng.randrange(1000)}" for _ in range(6)) for _ in range(150)]
    rows = [(" ".join(rng.choice(idioms) for _ in range(3)), "en") for _ in range(2200)]
    assert run(spark.createDataFrame(rows, "text string, lang string").repartition(6)) == brute(rows, 2000)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3 * 10**18
    found = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 7), ("en", "b", 1, 3 * big)], "lang string, phrase string, k int, f long")
    n = spark.createDataFrame([("en", 9 * 10**18)], "lang string, n long")
    assert [tuple(r) for r in phrase_mining.ranked(found, n).collect()] == [("en", 1, "a b", big, big + 7, 3 * big, 9 * 10**18, 2000000 * big // (4 * big + 7))]


def test_empty_tables(spark):
    assert run(spark.createDataFrame([], "text string, lang string")) == []
    assert run(spark.createDataFrame([(None, None), ("one word", "en")], "text string, lang string")) == []
