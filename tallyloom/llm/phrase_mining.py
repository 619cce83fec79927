"""Operator 11: phrase collocation mining by dynamic itemset counting.

Texts are encoded once (a dictionary and word codes for each block and language) and dealt over `SHARDS` shards. The
shards are scanned in turn, over and over, and each scan counts phrases of all lengths side by side. Words count
from the first scan on. A longer phrase becomes active in the scan after both its subphrases (all words but the last,
all but the first) have reached `LEAST` occurrences in the scans so far, and is counted for one full cycle of the shards from
there on, so that every count is whole. Scans end when no phrase can be active any more.

What is active is told by a table of `SLOTS` bytes (its size is fixed, whatever the corpus): the scan in which the first
phrase of each slot reached the threshold. Phrases that share a slot become active early at most, which
costs work and changes no count: a phrase's cycle follows from the table alone, slots never change once set, and no cycle
begins before the one of a subphrase, whose places are not met until then.
Counts are gathered by 64-bit hash: each task sends packed sorted hashes to buckets of hashes, a bucket merges them with
what it holds and drops phrases that ended their cycle below the threshold. Only bitmaps of fresh slots come to the driver.

A last scan spells the phrases that were found and counts them by their words; those counts are returned, so that hashes
that collide can't join two phrases. Scores, cuts and containment are joins in the JVM with exact decimals, the best `TOP` of a
language are the best of its salted parts.

Defined results: a null text is empty; a null language is `und`; null or repeated ids don't matter (each row is a
document); words are UTF-8 bytes between blanks, phrases never cross `.,;:!?`, line ends or documents; ties are ordered by bytes;
empty tables give empty results; extra columns are ignored. Long texts are cut between pieces only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import Tables, blocks, parts
from .text import expand, mix64, squeeze

LEAST, LONGEST, TOP, COVER = 30, 4, 2000, 80
SHARDS, SLOT_BITS = 3, 24
#: Bytes of text in a block, for each bucket of hashes; hashes gathered in a task before they are sent; parts of a language in the ranking.
BLOCK, BUCKET, SEND, SALTS = 8 << 20, 32 << 20, 1 << 20, 128
#: Bytes of a bitmap row.
MAP = 4096
NEVER = 255
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
ROWS = "bucket int, kind int, hashes binary, counts binary, starts binary"
ENCODED = "shard int, lang string, n long, words binary, codes binary"


def _cut(data: bytes) -> Iterator[bytes]:
    """Stretches of about BLOCK bytes that end with a piece."""
    at = 0
    while at < len(data):
        upto = data.rfind(b"\n", at, at + BLOCK) + 1 if len(data) - at > BLOCK else len(data)
        if upto <= at:
            upto = data.find(b"\n", at) + 1 or len(data)
        yield data[at:upto]
        at = upto


def coded(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a cleaned text, and its words as places in them from 1, with 0 between pieces."""
    raw = np.frombuffer(data, np.uint8)
    if not (found := data.split()):
        return [], np.zeros(0, np.uint32)
    kept = pa.array(found, pa.binary()).dictionary_encode()
    blank = (raw == 32) | (raw == 10)
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    piece = np.cumsum(raw == 10)[starts]
    codes = kept.indices.to_numpy().astype(np.uint32) + 1
    breaks = np.flatnonzero(np.diff(piece)) + 1
    return kept.dictionary.to_pylist(), np.insert(codes, breaks, 0)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nth = 0
    for key, block in blocks(batches, "text", BLOCK):
        block = block.combine_chunks()
        for lang in pc.unique(block.column("lang")).to_pylist():
            texts = block.column("text").filter(pc.equal(block.column("lang"), lang))
            whole = b"\n".join(pc.fill_null(texts, "").cast(pa.large_binary()).to_pylist()).translate(_CLEAN)
            for data in _cut(whole):
                words, codes = coded(data)
                if words:
                    row = ([(key + nth) % SHARDS], [lang], [int(np.count_nonzero(codes))], [zstandard.compress(b"\n".join(words), 1)], [squeeze(codes)])
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "lang", "n", "words", "codes"])
                    nth += 1


class Block:
    """The phrases of one encoded row, by length and place, as far as both their subphrases have a slot."""

    def __init__(self, row: dict, slots: np.ndarray):
        self.lang, self.slots = row["lang"], slots
        self.words = zstandard.decompress(row["words"]).split(b"\n")
        self.codes = expand(row["codes"], np.uint32)
        seed = xxhash.xxh64_intdigest(self.lang.encode())
        own = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        self.word_hash = own & ~np.uint64(3)

    def reached(self, hashes: np.ndarray) -> np.ndarray:
        return self.slots[(hashes >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)]

    def longer(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, places, hashes, scan of activation) for lengths from 2 on; ends where no place is left."""
        size = len(self.codes)
        per_word = np.append(np.uint8(NEVER), self.reached(self.word_hash))
        hash_of = np.append(np.uint64(0), self.word_hash)
        scan = per_word[self.codes]  # of the phrase at each place, NEVER where there is none
        at, hashes = np.flatnonzero(scan != NEVER), None
        for k in range(2, LONGEST + 1):
            # both subphrases: at a place and at the next one
            keep = at + k - 1 < size
            keep[keep] = scan[np.minimum(at[keep] + 1, size - 1)] != NEVER
            head = hash_of[self.codes[at]] if hashes is None else hashes
            at, head = at[keep], head[keep]
            if not len(at):
                return
            with np.errstate(over="ignore"):
                hashes = mix64(head * np.uint64(0x9E3779B97F4A7C15) + hash_of[self.codes[at + k - 1]]) & ~np.uint64(3) | np.uint64(k - 1)
            since = np.maximum(scan[at], scan[at + 1]) + np.uint8(1)
            yield k, at, hashes, since
            now = self.reached(hashes)
            scan = np.full(size, NEVER, np.uint8)
            # a slot that others set before this phrase was active tells nothing of it: what it is part of waits for its first scan
            scan[at] = np.where(now == NEVER, now, np.maximum(now, since))
            keep = now != NEVER
            at, hashes = at[keep], hashes[keep]


def _merged(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the sums of their counts."""
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _pack(hashes: np.ndarray) -> bytes:
    return squeeze(np.diff(hashes, prepend=np.uint64(0)))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, np.uint64), dtype=np.uint64)


def _row(bucket: int, kind: int, hashes: bytes, counts: bytes, starts: bytes) -> pa.RecordBatch:
    return pa.record_batch({"bucket": pa.array([bucket], pa.int32()), "kind": pa.array([kind], pa.int32()), "hashes": pa.array([hashes], pa.binary()), "counts": pa.array([counts], pa.binary()), "starts": pa.array([starts], pa.binary())})


def _scan(step: int, table, buckets: int) -> Callable:
    """Counts of what is active in this scan, packed by bucket."""

    def send(held: list) -> Iterator[pa.RecordBatch]:
        hashes, counts = _merged(*(np.concatenate(x) for x in zip(*held, strict=True)))
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield _row(int(bucket[i]), 0, _pack(hashes[i:j]), squeeze(counts[i:j]), b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0], table.value)
                if step < SHARDS:
                    held.append((block.word_hash, np.bincount(block.codes, minlength=len(block.words) + 1)[1:].astype(np.int64)))
                for _, _, hashes, since in block.longer():
                    hashes = hashes[(since <= step) & (step < since.astype(np.int64) + SHARDS)]
                    held.append(_merged(hashes, np.ones(len(hashes), np.int64)))
                size = sum(len(h) for h, _ in held)
                if size >= SEND:
                    yield from send(held)
                    held = []
        if sum(len(h) for h, _ in held):
            yield from send(held)

    return run


def _merge(step: int, slot_bits: int) -> Callable:
    """A bucket's counts after a scan: kind 1 with what is counted or found, kind 2 and 3 with bitmaps of fresh slots (3: of phrases that can grow)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        hashes = np.concatenate([_unpack(r["hashes"]) for r in rows])
        counts = np.concatenate([expand(r["counts"], np.int64) for r in rows])
        before = np.concatenate([expand(r["counts"], np.int64) if r["kind"] else np.zeros(len(_unpack(r["hashes"])), np.int64) for r in rows])
        starts = np.concatenate([expand(r["starts"], np.uint8) if r["kind"] else np.full(len(_unpack(r["hashes"])), step, np.uint8) for r in rows])
        order = np.argsort(hashes, kind="stable")
        hashes, counts, before, starts = hashes[order], counts[order], before[order], starts[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        hashes, counts, before, starts = hashes[first], np.add.reduceat(counts, first), np.add.reduceat(before, first), np.minimum.reduceat(starts, first)
        fresh = (counts >= LEAST) & (before < LEAST)
        kept = (counts >= LEAST) | (starts.astype(np.int64) + SHARDS - 1 > step)
        bucket, out = rows[0]["bucket"], []
        if kept.any():
            out.append(_row(bucket, 1, _pack(hashes[kept]), squeeze(counts[kept]), squeeze(starts[kept])))
        for kind, can_grow in ((2, False), (3, True)):
            own = hashes[fresh & ((hashes & np.uint64(3) < LONGEST - 1) == can_grow)]
            slots = np.unique(own >> np.uint64(64 - slot_bits)).astype(np.int64)
            for part in np.unique(slots // (8 * MAP)).tolist():
                bits = np.zeros(8 * MAP, bool)
                bits[slots[slots // (8 * MAP) == part] % (8 * MAP)] = True
                out.append(_row(part, kind, np.packbits(bits).tobytes(), b"", b""))
        return pa.Table.from_batches(out) if out else _row(0, 0, b"", b"", b"").schema.empty_table()

    return run


def encoded(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each block and language: shard, lang, n (words), words and codes."""
    return df.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")).mapInArrow(_encode, ENCODED)


def frequent(table: DataFrame, tables: Tables, buckets: int) -> tuple[DataFrame, np.ndarray]:
    """(rows of packed hashes with their counts, slots) of all phrases that occur LEAST times or more in an encoded table."""
    spark = table.sparkSession
    slots, state, step, last = np.full(1 << SLOT_BITS, NEVER, np.uint8), None, 0, -1
    while step < SHARDS or step <= last + SHARDS:
        told = spark.sparkContext.broadcast(slots)
        counts = table.where(F.col("shard") == step % SHARDS).select("lang", "words", "codes").mapInArrow(_scan(step, told, buckets), ROWS)
        both = counts if state is None else state.where("kind = 1").unionByName(counts)
        state = tables.put(both.groupBy("bucket").applyInArrow(_merge(step, SLOT_BITS), ROWS))
        tables.drop(but=1)
        maps = state.where("kind > 1").groupBy("kind", F.col("bucket").alias("part")).agg(F.expr("bitmap_or_agg(hashes)").alias("bits")).collect()  # at most 2 bits a slot
        told.destroy()
        slots = slots.copy()
        for row in maps:
            at = row["part"] * 8 * MAP + np.flatnonzero(np.unpackbits(np.frombuffer(row["bits"], np.uint8)))
            slots[at[slots[at] == NEVER]] = step
            last = step if row["kind"] == 3 else last
        step += 1
    return state.where("kind = 1"), slots


def _spell(table) -> Callable:
    """(hash, lang, phrase, k, c) for the phrases of each block that have a slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0], table.value)
                words = pa.array(block.words, pa.binary())
                counts = np.bincount(block.codes, minlength=len(block.words) + 1)[1:]
                own = np.flatnonzero(block.reached(block.word_hash) != NEVER)
                found = [(1, block.word_hash[own], counts[own], [own])]
                for k, at, hashes, _ in block.longer():
                    keep = block.reached(hashes) != NEVER
                    at, hashes = at[keep], hashes[keep]
                    if not len(at):
                        continue
                    # by the words themselves: rows of equal codes are one phrase
                    codes = np.stack([block.codes[at + i].astype(np.int64) - 1 for i in range(k)])
                    order = np.lexsort((*codes[::-1], hashes))
                    codes, hashes = codes[:, order], hashes[order]
                    first = np.flatnonzero(np.append(True, (codes[:, 1:] != codes[:, :-1]).any(0)))
                    found.append((k, hashes[first], np.diff(np.append(first, len(order))), list(codes[:, first])))
                for k, hashes, c, codes in found:
                    text = pc.binary_join_element_wise(*(words.take(pa.array(x)) for x in codes), b" ") if k > 1 else words.take(pa.array(codes[0]))
                    n = len(hashes)
                    yield pa.record_batch({"hash": pa.array(hashes.view(np.int64)), "lang": pa.array([block.lang] * n, pa.string()), "phrase": text.cast(pa.string()), "k": pa.array(np.full(n, k, np.int32)), "c": pa.array(c.astype(np.int64))})

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            hashes, counts = _unpack(row["hashes"]), expand(row["counts"], np.int64)
            keep = counts >= LEAST
            yield pa.record_batch({"hash": pa.array(hashes[keep].view(np.int64)), "counted": pa.array(counts[keep])})


def phrases(table: DataFrame, tables: Tables, buckets: int) -> DataFrame:
    """(lang, phrase, k, f) of all phrases of an encoded table that occur LEAST times or more, words included."""
    state, slots = frequent(table, tables, buckets)
    told = table.sparkSession.sparkContext.broadcast(slots)
    spelled = table.select("lang", "words", "codes").mapInArrow(_spell(told), "hash long, lang string, phrase string, k int, c long").groupBy("hash", "lang", "phrase", "k").agg(F.sum("c").alias("f")).where(F.col("f") >= LEAST)
    return spelled.join(state.mapInArrow(_hashes, "hash long, counted long"), "hash").select("lang", "phrase", "k", "f", "counted")


def ranked(found: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """The result from (lang, phrase, k, f) and (lang, n)."""
    part = lambda i, n: F.array_join(F.slice("words", i, n), " ")
    candidates = found.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    cuts = candidates.withColumn("words", F.split("phrase", " ")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k")).alias("right"))
    side = lambda name, n: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.expr("CAST(CAST(2000000 AS DECIMAL(8,0)) * a AS DECIMAL(30,0)) div (l + r)").cast("long")
    told = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).withColumns({x: wide(x) for x in ("a", "l", "r")}).withColumn("score", score)
    least = told.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"), F.first("a").alias("a"))
    inner = found.where("k > 2").select("lang", "f", F.split("phrase", " ").alias("words"), "k").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1))).groupBy("lang", part(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("f").alias("most"))
    open_ = least.join(inner, ["lang", "phrase"], "left").where(F.col("most").isNull() | (wide("most") * 100 < wide("a") * COVER))
    long = lambda c: F.col(c).cast("long")
    rows = open_.select("lang", "phrase", long("a").alias("a"), long("low.l").alias("l"), long("low.r").alias("r"), F.col("low.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of df."""
    spark = df.sparkSession
    held, tables = Tables(spark), Tables(spark)
    table = held.put(encoded(df, text_col, lang_col), "shard")
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    found = held.put(phrases(table, tables, max(4 * parts(spark), -(-size // BUCKET))))
    tables.drop(but=0)
    return ranked(found, table.groupBy("lang").agg(F.sum("n").alias("n")), top)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_phrase_mining: the collocations of `documents`."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH p AS (
  SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
o AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM o GROUP BY lang, phrase, k HAVING count(*) >= 30),
cut AS (
  SELECT lang, phrase, f AS a, c, array_to_string(w[1:c], ' ') AS lp, array_to_string(w[c + 1:], ' ') AS rp
  FROM (SELECT lang, phrase, f, string_split(phrase, ' ') AS w, unnest(generate_series(1, k - 1)) AS c FROM f WHERE k > 1)),
s AS (
  SELECT cut.lang, cut.phrase, a, c, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = lp JOIN f y ON y.lang = cut.lang AND y.phrase = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inn AS (
  SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT lang, f, w, z, unnest(generate_series(1, k - z + 1)) AS i
        FROM (SELECT lang, f, k, string_split(phrase, ' ') AS w, unnest(generate_series(2, k - 1)) AS z FROM f WHERE k > 2))
  GROUP BY 1, 2),
r AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN inn ON inn.lang = b.lang AND inn.phrase = b.phrase WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN t USING (lang) WHERE rank <= 2000
"""
