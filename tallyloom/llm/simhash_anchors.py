"""Operator 6: SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at `distance` or fewer differing bits. Of two linked fingerprints one
32-bit half differs in at most t = distance // 2 bits, and a point midway between those halves is
within ceil(t / 2) bits of both. Anchors are the words of a covering code on a half: the Hamming
code [31, 26] with the last bit free, covering radius 1. The anchor nearest to the midpoint is
within 1 + ceil(t / 2) = 2 bits of both halves, so each fingerprint is replicated to every anchor
within that reach (17 a half, 2 if the half is an anchor itself) and linked fingerprints meet at
an anchor for certain. The ball is the covering radius plus the threshold as seen from the
midpoint, the least that loses no pair; a ball around an end of the pair would need radius 3 and
ten times the replicas.

Equal fingerprints are one class before anything is replicated. At an anchor, fingerprints are
compared in tiles and only a spanning forest of the links found there leaves the task, so a group
of near copies costs rows in proportion to its size. An anchor with more than `LOT` fingerprints is
cut in chunks, and each two chunks are a cell of their own, so that many tasks compare them. Components
over these links are those over all links.

Defined results: null and empty texts have fingerprint 0 and link like others; null ids get a row
and the component of their fingerprint, which is null if it has no other id; repeated rows each
keep a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import components, spread_join, stored
from .text import words

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Fingerprints compared at once: a tile of TILE x TILE.
TILE = 2048
#: Fingerprints of an anchor that a task compares, about half of them if they are cut.
LOT = 8192


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: bit i is set if it is in over half the shingle hashes."""
    found = words(text, lower=True)
    if not found:
        return 0
    data, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    n = max(1, len(found) - shingle + 1)
    starts = np.append(0, ends + 1)[:n].tolist()
    stops = ends[min(shingle, len(found)) - 1 :].tolist()
    hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.record_batch({"id": batch.column("id"), "key": batch.column("key"), "fp": pa.array(prints.view(np.int64))})


def _parity() -> np.ndarray:
    """Syndromes of all 16-bit words, low and high part of a half: the XOR of the set positions 1 to 31."""
    table = np.zeros((2, 1 << 16), np.uint32)
    for part in range(2):
        for bit in range(16):
            position = 16 * part + bit + 1
            if position < 32:  # the last bit of a half is the free one
                table[part] ^= np.where(np.arange(1 << 16) >> bit & 1, np.uint32(position), np.uint32(0))
    return table


def _flips() -> np.ndarray:
    """For each syndrome the masks to the anchors within 2 bits, padded with the first."""
    bit = lambda position: 1 << (position - 1)
    free = 1 << 31
    rows = [[0, free]]
    for s in range(1, 32):
        rows.append([bit(s), bit(s) | free] + [bit(i) | bit(i ^ s) for i in range(1, 32) if i < i ^ s])
    wide = max(map(len, rows))
    return np.array([r + r[:1] * (wide - len(r)) for r in rows], np.uint64)


def anchors(halves: np.ndarray) -> np.ndarray:
    """An array (n, 17) of the anchors within 2 bits of each 32-bit half; anchors may repeat in a row."""
    parity = _parity()
    syndrome = parity[0][halves & np.uint64(0xFFFF)] ^ parity[1][halves >> np.uint64(16)]
    return halves[:, None] ^ _flips()[syndrome]


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for half in range(2):
            at = anchors(fps >> np.uint64(32) if half else fps & np.uint64(0xFFFFFFFF))
            fresh = np.ones(at.shape, bool)
            fresh[:, 2:] = at[:, 2:] != at[:, :1]  # the padding
            keys = (at | np.uint64(half << 32)).view(np.int64)
            yield pa.record_batch({"anchor": pa.array(keys[fresh]), "fp": pa.array(np.repeat(fps.view(np.int64), fresh.sum(1)))})


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that span what the links of fps at `distance` connect, comparing tile by tile."""
    n = len(fps)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    links = []
    for a in range(0, n, TILE):
        for b in range(a, n, TILE):
            near = np.bitwise_count(fps[a : a + TILE, None] ^ fps[None, b : b + TILE]) <= distance
            flat = np.array([find(i) for i in range(n)])
            near &= flat[a : a + TILE, None] != flat[None, b : b + TILE]
            while near.any():
                rows = np.flatnonzero(near.any(1))
                for i, j in zip((rows + a).tolist(), (near[rows].argmax(1) + b).tolist(), strict=True):
                    x, y = find(i), find(j)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        links.append((i, j))
                flat = np.array([find(i) for i in range(n)])
                near &= flat[a : a + TILE, None] != flat[None, b : b + TILE]
    return links


def _compared(distance: int):
    def pairs(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links within the runs of equal keys; runs of two, by far the most, are compared together."""
        starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        lens = np.diff(np.append(starts, len(keys)))
        two = starts[lens == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
        a, b = [fps[two]], [fps[two + 1]]
        for lo, n in zip(starts[lens > 2], lens[lens > 2], strict=True):
            own = fps[lo : lo + n]
            if links := _forest(own, distance):
                i, j = np.array(links).T
                a.append(own[i])
                b.append(own[j])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by anchor; the last run of a batch waits for the next batch."""
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def given(keys, fps):
            a, b = pairs(keys, fps)
            return pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            last = int(np.searchsorted(keys, keys[-1]))
            if last or (held and held[0][0][0] != keys[0]):
                cut = last if last else 0
                held.append((keys[:cut], fps[:cut]))
                yield given(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            held.append((keys[last:], fps[last:]))
        if held:
            yield given(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of a frame (fp), spanning all its components."""
    if distance not in (4, 5):
        raise ValueError("the anchors cover distances of 4 and 5 bits")
    spread = classes.select("fp").mapInArrow(_replicas, "anchor long, fp long")
    hot = spread.groupBy("anchor").agg((2 * F.ceil(F.count("*") / LOT)).alias("many")).where("many > 2")
    chunk = F.pmod(F.xxhash64("fp"), F.col("many"))
    # a fingerprint of a cut anchor goes to the cells of its chunk with each other chunk
    other = F.explode(F.when(F.col("many").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("many") - 1), lambda o: o != chunk)))
    cells = spread.join(hot, "anchor", "left").select("anchor", "fp", "many", other.alias("other"))
    cell = F.when(F.col("other") < 0, F.col("anchor")).otherwise(F.xxhash64("anchor", F.least(chunk, "other"), F.greatest(chunk, "other")))
    dealt = cells.select("anchor", cell.alias("cell"), "fp").repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")
    return dealt.select("cell", "fp").mapInArrow(_compared(distance), "a long, b long").distinct()


def _grouped(df: DataFrame, id_col: str, text_col: str, distance: int) -> DataFrame:
    """(id, key, fp, root, component_id) for each row; key hashes id and text, root is the least fingerprint reached."""
    kind = df.schema[id_col].dataType.simpleString()
    given = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("key"))
    prints = stored(given.mapInArrow(_fingerprints, f"id {kind}, key long, fp long"))
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(classes, distance)).withColumnsRenamed({"node": "fp"})
    rooted = stored(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    return prints.join(spread_join(rooted, least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(id_col, fp long, component_id) for each row: the least id that links reach from its fingerprint."""
    return _grouped(df, id_col, text_col, distance).select(F.col("id").alias(id_col), "fp", "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of df for each component, with the columns of df: that of the least id, null last."""
    grouped = _grouped(df, id_col, text_col, distance)
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "key")).alias("first")
    chosen = grouped.groupBy("root").agg(first).select(F.col("first")["key"].alias("key"))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    rows = df.select(row, F.xxhash64(id_col, text_col).alias("key")).join(chosen, "key", "left_semi")
    # of rows equal in id and text one stays, whatever their number, by a hash of all columns
    return rows.groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_simhash: fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
