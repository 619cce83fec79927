"""Operator 2: paragraph dedup by MinHash banding.

A paragraph is a line of at least `min_words` words, by default those of a shingle; shorter lines are left
alone. Paragraphs of equal words, with A-Z in lower case, are one class, told by a 128-bit hash of them; half
of it names the class while bands and links are sought, the other half then tells which of two classes of
one name was verified, so that equal halves remove nothing. A class has a signature of BANDS * ROWS minima over its set of five-word shingles (a line shorter than that
is one shingle, so only its exact copies are similar); classes that agree in all rows of a band
collide. At a Jaccard similarity of 0.8 all 16 bands miss with chance 0.0002. Colliding classes are
verified by their exact Jaccard similarity, and components of the links are clusters; the first
paragraph of a cluster, by document id and line, stays and all others are removed.

A lot of texts sends one class for each band, its least; the others of the lot collide with that one there, so
a band that a third of all paragraphs share is a row a lot. What collides is a star of stars, and
its pairs are verified first. Bands whose members are all connected then need nothing more. Each other band
is a star again, around its most central class, the one with the fewest shingles of its own: the
copies of a text with few changes all meet there. After that a prefix filter finds the
pairs of different components that are left: shingles are put in order of how many sets hold
them, and the first one that two sets share stands so early in both that the rest can still
make up the similarity. So no link is lost, and no band is joined with itself.

`passages` also finds what is copied within lines. A line of at least LONG words is cut into pieces
at places that the words around them tell, so that a passage pasted into other lines is cut
alike there; pieces of fewer than PIECE words are left alone, as several texts may hold these by chance. Where lines are shorter, one and the next short ones are a piece as soon as they make up LONG
words. A piece is a class like a line; of equal pieces, or pieces equal to a line, the first
stays. Pieces are told by their words alone: with so few of them a changed word leaves too few shingles. Lines of
fewer than LONG words that repeat alone are told apart from what is removed; `summary` removes them.

Defined results: null and empty texts have no paragraphs; null ids come last in the order; rows
of one id are ordered by a hash of their text; of rows equal in id and text one comes first and all
others lose all their paragraphs; an empty table gives an empty result; extra columns are ignored.
For `different` a null, empty or blank text is a document without words, and of all of those one stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import buckets, cleaned, components, released, spread_join, stored
from .text import mix64, ragged, runs, words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
#: Words of a line that is cut, least words of a piece, words on either side that a cut depends on, and words that are hashed for it.
LONG, PIECE, AROUND, TELLING = 20, 7, 5, 3
#: Bytes of text that are handled at once, and rows with bodies that a worker is sent at once.
LOT, BATCH = 2 << 20, 500
_FACTORS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(bodies: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the shingles of each body of words, end to end; fewer words than a shingle are one. Repeats are included."""
    found = [b.split() for b in bodies]
    lens = np.fromiter(map(len, found), np.int64, len(found))
    one = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in found for w in ws), np.uint64, int(lens.sum()))
    key = one[: max(len(one) - size + 1, 0)]
    for i in range(1, size):
        key = mix64(key) + one[i : len(key) + i]
    key = mix64(key)
    count = np.maximum(lens - size + 1, 1)
    starts = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    short = lens < size
    out[ragged(starts[~short], count[~short])] = key[ragged((np.cumsum(lens) - lens)[~short], count[~short])]
    out[starts[short]] = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(found[i])) for i in np.flatnonzero(short)), np.uint64, int(short.sum()))
    return out, starts


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """An array (sets, BANDS) of the band keys of sets of hashes: each the hash of its minima and its number."""
    key = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(starts), axis=0)
    for i in range(BANDS * ROWS):
        band = i // ROWS
        key[:, band] = mix64(key[:, band] * np.uint64(31) + np.minimum.reduceat(hashes * _FACTORS[i], starts))
    return key


def _lots(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """A batch in slices of some megabytes of its texts."""
    size = sum(pa.compute.fill_null(pa.compute.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns or ("text",))
    for lo, hi in runs(np.cumsum(size) // LOT):
        yield batch.slice(lo, hi - lo)
    released()


def _found(text: str | None, least: int) -> Iterator[tuple[int, bytes]]:
    """(line, words joined by spaces) of the lines of at least so many words."""
    for line, body in enumerate((text or "").split("\n")):
        found = words(body, lower=True)
        if len(found) >= least:
            yield line, b" ".join(found)


def _halves(body: bytes) -> tuple[int, int]:
    """The name of a class and its check: two halves of one hash, as signed numbers."""
    high, low = divmod(xxhash.xxh3_128_intdigest(body), 1 << 64)
    return low - (1 << 63), high - (1 << 63)


def _classes(batch: pa.RecordBatch, least: int) -> dict[int, tuple[int, bytes]]:
    """(check, body) of each class of some texts by its name."""
    out = {}
    for text in batch.column("text"):
        for _, body in _found(text.as_py(), least):
            pid, check = _halves(body)
            out[pid] = check, body
    return out


def _paragraphs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the lines and classes of their paragraphs in place of the text."""
        for batch in batches:
            own = [list(_found(t.as_py(), least)) for t in batch.column("text")]
            named = [[(n, *_halves(b)) for n, b in o] for o in own]
            lists = (pa.array([[x[i] for x in o] for o in named], pa.list_(kind)) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "tie", "at")), *lists], names=["id", "tie", "at", "lines", "pids", "checks"])

    return run


def cuts(found: list[list[bytes]]) -> np.ndarray:
    """Of lines of words, end to end: whether a piece ends at a word.

    It does where the hash of the last words is the least of all within AROUND words of it in the
    line, and PIECE words are left on both sides.
    """
    lens = np.fromiter(map(len, found), np.int64, len(found))
    key = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in found for w in ws), np.uint64, int(lens.sum()))
    at = np.arange(len(key)) - np.repeat(np.cumsum(lens) - lens, lens)
    left = np.repeat(lens, lens) - at - 1
    one = key
    for _ in range(TELLING - 1):
        key = mix64(np.append(np.zeros(1, np.uint64), key[:-1])[: len(key)]) + one
    key = np.where(at < TELLING - 1, ~np.uint64(0), mix64(key))
    cut = (at >= PIECE - 1) & (left >= PIECE)
    for i in range(1, min(AROUND, len(key) - 1) + 1):
        cut[i:] &= (key[i:] < key[:-i]) | (at[i:] < i)
        cut[:-i] &= (key[:-i] <= key[i:]) | (left[:-i] < i)
    return cut | (left == 0)


def _pieces(lines: list[tuple[int, bytes]]) -> list[list[tuple[int, int, bytes]]]:
    """(first word, number of words, body) of the pieces of PIECE words of each line (line, body); none of a line in one piece."""
    found = [b.split() for _, b in lines]
    ends = (np.flatnonzero(cuts(found)) + 1).tolist()
    out, start, k = [], 0, 0
    for ws in found:
        own, at = [], 0
        while at < len(ws):
            to, k = ends[k] - start, k + 1
            own.append((at, to - at, b" ".join(ws[at:to])))
            at = to
        start += len(ws)
        out.append([x for x in own if x[1] >= PIECE] if len(own) > 1 else [])
    return out


def _sequences(lines: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """(line, number of words, body) of the shortest sequence of short lines of LONG words from each line on."""
    sizes = [b.count(b" ") + 1 for _, b in lines]
    to = total = 0
    for i, (line, _) in enumerate(lines):
        if to < i:
            to, total = i, 0
        while to < len(lines) and sizes[to] < LONG and total < LONG:
            total, to = total + sizes[to], to + 1
        if total >= LONG:
            yield line, total, b" ".join(b for _, b in lines[i:to])
        total -= sizes[i] if to > i else 0


def _parts(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their lines (word -1), sequences of short lines (word -2) and pieces of long lines in place of the text."""
        for batch in batches:
            for lot in _lots(batch):
                own = [list(_found(t.as_py(), least)) for t in lot.column("text")]
                rows = [[(line, -1, b.count(b" ") + 1, *_halves(b)) for line, b in o] for o in own]
                for row, o in zip(rows, own, strict=True):
                    row += [(line, -2, size, *_halves(b)) for line, size, b in _sequences(o)]
                long = [(row, line, b) for row, o in zip(rows, own, strict=True) for line, b in o if b.count(b" ") + 1 >= LONG]
                for (row, line, _), pieces in zip(long, _pieces([x[1:] for x in long]), strict=True):
                    row += [(line, at, size, *_halves(b)) for at, size, b in pieces]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                lists = (pa.array([[x[i] for x in row] for row in rows], pa.list_(kind)) for i, kind in enumerate(kinds))
                yield pa.RecordBatch.from_arrays([*(lot.column(c) for c in ("id", "tie", "at")), *lists], names=["id", "tie", "at", "lines", "words", "sizes", "pids", "checks"])

    return run


def _bodies(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in _lots(batch):
                own = _classes(lot, least)
                yield pa.record_batch({"pid": pa.array(list(own), pa.int64()), "check": pa.array([c for c, _ in own.values()], pa.int64()), "body": pa.array([b for _, b in own.values()], pa.binary())})

    return run


def _stars(band: np.ndarray, pid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band, least pid of the band, pid) of rows without repeats, sorted by band and pid."""
    order = np.lexsort((pid, band))
    band, pid = band[order], pid[order]
    fresh = (np.diff(band, prepend=~band[:1]) != 0) | (np.diff(pid, prepend=~pid[:1]) != 0)
    band, pid = band[fresh], pid[fresh]
    head = np.flatnonzero(np.diff(band, prepend=~band[:1]))
    return band, np.repeat(pid[head], np.diff(np.append(head, len(band)))), pid


def _banded(least: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By bucket: the least class of each band of a lot (by the band), and the others with the one that they meet (by themselves)."""
        for batch in batches:
            for lot in _lots(batch):
                own = _classes(lot, least)
                if not own:
                    continue
                keys = signatures(*shingles([b for _, b in own.values()])).view(np.int64).reshape(-1)
                band, first, pid = _stars(keys, np.repeat(np.fromiter(own, np.int64, len(own)), BANDS))
                met = first != pid
                of = np.where(met, pid, band).view(np.uint64) % np.uint64(n)
                order = np.argsort(of, kind="stable")
                for lo, hi in runs(of[order]):
                    one = order[lo:hi]
                    columns = (x[one].tobytes() for x in (band, first, pid))
                    yield pa.record_batch([pa.array([int(of[order[lo]])], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)], names=["bucket", "band", "a", "pid"])

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of a bucket: stars of the classes that lots sent for a band, and what met within a lot as it is."""
    band, a, pid = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("band", "a", "pid"))
    met = a != pid
    stars = _stars(band[~met], pid[~met])
    some = stars[1] != stars[2]
    return pa.table({n: pa.array(np.concatenate([x[met], y[some]])) for n, x, y in zip(("band", "a", "pid"), (band, a, pid), stars, strict=True)})


def _sets(bodies: list[bytes]) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each body."""
    hashes, starts = shingles(bodies)
    return [np.unique(s) for s in np.split(hashes, starts[1:])] if bodies else []


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _lots(batch, "x", "y"):
                left = some.column("x").dictionary_encode()
                xs, ys = _sets(left.dictionary.to_pylist()), _sets(some.column("y").to_pylist())
                keep = []
                for i, y in zip(left.indices.to_pylist(), ys, strict=True):
                    x = xs[i]
                    small, large = (x, y) if len(x) < len(y) else (y, x)
                    both = 0
                    if len(small) >= threshold * len(large):
                        at = np.searchsorted(large, small)
                        both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    keep.append(both >= threshold * (len(x) + len(y) - both))
                yield some.select(["a", "b", "u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pid, size, shingle) for each shingle of the set of (pid, body)."""
    for batch in batches:
        for some in _lots(batch, "body"):
            sets = _sets(some.column("body").to_pylist())
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            yield pa.record_batch({"pid": pa.array(np.repeat(some.column("pid").to_numpy(), size)), "size": pa.array(np.repeat(size, size)), "shingle": pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))})


def ranked(sets: DataFrame) -> DataFrame:
    """(pid, size, shingle, nth, sets) of the sets (pid, body): nth is the place of a shingle among its set's, the ones that the fewest sets hold first; sets is null where there is no other."""
    each = stored(sets.select("pid", "body").mapInArrow(_exploded, "pid long, size long, shingle long"), BATCH)
    often = each.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1")
    nth = F.row_number().over(Window.partitionBy("pid").orderBy(F.coalesce("sets", F.lit(1)), "shingle"))
    return stored(each.join(often, "shingle", "left").withColumn("nth", nth))


def prefix_pairs(places: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of sets of different roots (pid, root) that can have a similarity of at least threshold, from ranked().

    Sets of sizes m and n need threshold / (1 + threshold) * (m + n) shingles in common, so their first common one is
    among the first m + 1 less that of the one and the first n + 1 less that of the other. Of the sets
    that hold a shingle those of the most frequent root are met by the others only.
    """
    early = places.where((F.col("nth") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - F.lit(1e-9)) + 1) & F.col("sets").isNotNull()).join(roots, "pid")
    each = early.groupBy("shingle", "root").agg(F.count("*").alias("n"))
    hubs = each.groupBy("shingle").agg(F.max_by("root", "n").alias("hub"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    left = early.join(hubs, "shingle").where("root <> hub").select("shingle", F.col("pid").alias("a"), F.col("root").alias("r"), F.col("size").alias("m"), F.col("nth").alias("i"))
    right = early.select("shingle", F.col("pid").alias("b"), F.col("root").alias("s"), F.col("size").alias("n"), F.col("nth").alias("j"))
    common = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("m") + F.col("n")) - F.lit(1e-9))
    can = (F.col("r") != F.col("s")) & (F.col("i") <= F.col("m") - common + 1) & (F.col("j") <= F.col("n") - common + 1)
    return left.join(right, "shingle").where(can).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def clusters(given: DataFrame, threshold: float, least: int) -> DataFrame:
    """(node, check, root) for each class of the lines of text that has a similar other class; root is the least of its cluster."""
    if not 0 < threshold <= 1 or math.isclose(threshold, 0):
        raise ValueError("a similarity is above 0 and at most 1")
    n = buckets(given, "text")
    sent = given.select("text").mapInArrow(_banded(least, n), "bucket int, band binary, a binary, pid binary")
    met = stored(sent.groupBy("bucket").applyInArrow(_shared, "band long, a long, pid long"))
    members = met.select("band", "pid").union(met.select("band", F.col("a").alias("pid"))).distinct()
    # only texts of classes that collide are kept; all others end at this join
    asked_for = members.select("pid").distinct()
    found_again = given.select("text").mapInArrow(_bodies(least), "pid long, check long, body binary").join(asked_for, "pid", "left_semi")
    # of two classes of one name the lesser one is verified, and links are its own
    bodies = stored(found_again.groupBy("pid").agg(F.min("check").alias("check"), F.min_by("body", "check").alias("body")))

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda end, check, name: bodies.select(F.col("pid").alias(end), F.col("check").alias(check), F.col("body").alias(name))
        both = pairs.join(side("b", "v", "y"), "b").join(side("a", "u", "x"), "a").select("a", "b", "u", "v", "x", "y")
        return stored(both.mapInArrow(_similar(threshold), "a long, b long, u long, v long"), BATCH)

    def rooted(links: DataFrame) -> DataFrame:
        """(band, pid, root) of the bands whose members are in several components."""
        labels = components(links.select("a", "b")).withColumnsRenamed({"node": "pid"})
        found = stored(members.join(labels, "pid", "left").select("band", "pid", F.coalesce("root", "pid").alias("root")))
        mixed = found.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
        return found.join(mixed, "band", "left_semi")

    links = verified(met.select("a", F.col("pid").alias("b")).distinct())
    left = stored(rooted(links))
    places = ranked(bodies.join(left.select("pid").distinct(), "pid", "left_semi"))
    own = left.join(places.groupBy("pid").agg(F.count_if(F.col("sets").isNull()).alias("own")), "pid")
    middle = own.groupBy("band").agg(F.min_by(F.struct("pid", "root"), F.struct("own", "pid")).alias("m")).select("band", F.col("m")["pid"].alias("a"), F.col("m")["root"].alias("r"))
    links = links.union(verified(left.join(middle, "band").where("root <> r").select("a", F.col("pid").alias("b")).distinct()))
    rest = rooted(links).select("pid", "root").distinct()
    links = links.union(verified(prefix_pairs(places, rest, threshold)))
    checks = links.select(F.col("a").alias("node"), F.col("u").alias("check")).union(links.select("b", "v")).distinct()
    return components(links.select("a", "b")).join(checks, "node").select("node", "check", "root")


def _given(df: DataFrame, id_col: str, text, *tied: str) -> DataFrame:
    """(id, text, tie, at): tie hashes some columns; at names the row."""
    return df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(*tied).alias("tie"), F.monotonically_increasing_id().alias("at"))


def _told(given: DataFrame, least: int) -> DataFrame:
    """(id, tie, at, lines, pids, checks) of all rows, stored: at names a row from here on."""
    kind = given.schema["id"].dataType.simpleString()
    return stored(given.mapInArrow(_paragraphs(least), f"id {kind}, tie long, at long, lines array<int>, pids array<long>, checks array<long>"))


def _classed(lines: DataFrame, final: DataFrame) -> DataFrame:
    """lines (.., pid, check) with (component, apart) instead: the cluster that clusters() tells, or the class by all its bits."""
    met = lines.join(final.select(F.col("node").alias("pid"), "check", "root"), ["pid", "check"], "left")
    alone = F.when(F.col("root").isNull(), F.col("check")).otherwise(0)
    return met.withColumns({"component": F.coalesce("root", "pid"), "apart": alone}).drop("pid", "check", "root")


def different(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df without documents similar to another, by links of whole documents: of each cluster the least id stays, null last.

    A document of any length is one paragraph here. Repeated rows of the id and text that stay are all kept.
    """
    given = _given(df, id_col, F.translate(F.col(text_col), "\n", " "), id_col, text_col)
    told = _told(given, 0).select("id", "tie", F.col("pids")[0].alias("pid"), F.col("checks")[0].alias("check"))
    named = _classed(told, clusters(given, threshold, 0))
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "tie")).alias("first")
    chosen = stored(named.groupBy("component", "apart").agg(first).select(F.col("first")["tie"].alias("tie")))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    return df.select(row, F.xxhash64(id_col, text_col).alias("tie")).join(chosen, "tie", "left_semi").select("row.*")


def _removed(told: DataFrame, final: DataFrame) -> DataFrame:
    """(id, tie, line, component, removed) of the paragraphs of told; rows equal in id and tie are one."""
    lines = told.select("id", "tie", F.inline(F.arrays_zip("lines", "pids", "checks"))).toDF("id", "tie", "line", "pid", "check")
    named = stored(_classed(lines, final))
    place = F.struct(F.col("id").isNull().alias("n"), "id", "tie", "line")
    first = named.groupBy("component", "apart").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    return spread_join(named, first, ["component", "apart"]).select("id", "tie", "line", "component", (place != F.col("first")).alias("removed"))


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, min_words: int = SHINGLE) -> DataFrame:
    """(id, tie, line, component, removed) for each paragraph of the distinct rows of df; tie hashes the text, component is the least class of the cluster."""
    given = _given(df, id_col, F.col(text_col), text_col)
    return _removed(_told(given, min_words), clusters(given, threshold, min_words)).distinct()


def summary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, min_words: int = SHINGLE) -> DataFrame:
    """(id_col, n_paragraphs, n_removed, removed_lines) for each row of df."""
    given = _given(df, id_col, F.col(text_col), text_col)
    told = _told(given, min_words)
    judged = _removed(told, clusters(given, threshold, min_words)).where("removed")
    gone = judged.groupBy("id", "tie").agg(F.sort_array(F.collect_set("line")).alias("gone")).toDF("i", "t", "gone")
    again = told.groupBy("id", "tie").agg(F.min("at").alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("j"), F.col("tie").alias("u"), "least")
    met = told.join(gone, F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")), "left").join(again, F.col("id").eqNullSafe(F.col("j")) & (F.col("tie") == F.col("u")), "left")
    lines = F.when(F.col("at") > F.col("least"), F.col("lines")).otherwise(F.coalesce("gone", F.array().cast("array<int>")))
    return met.select(F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_paragraphs"), F.size(lines).cast("long").alias("n_removed"), lines.alias("removed_lines"))


def _lost(told: DataFrame, final: DataFrame) -> DataFrame:
    """(id, tie, line, word, size) of the lines and pieces of told of which an earlier one stays; rows equal in id and tie are one."""
    each = told.select("at", F.inline(F.arrays_zip("lines", "words", "sizes", "pids", "checks"))).toDF("at", "line", "word", "size", "pid", "check")
    # most classes have one place and no link; they end at this join
    places = each.select("pid", "check", F.lit(1).alias("n")).union(final.select("node", "check", F.lit(2)))
    many = places.groupBy("pid", "check").agg(F.sum("n").alias("n")).where("n > 1").select("pid", "check")
    named = stored(_classed(each.join(many, ["pid", "check"], "left_semi"), final).join(told.select("at", "id", "tie"), "at"))
    place = F.struct(F.col("id").isNull().alias("n"), "id", "tie", "line", "word")
    first = named.groupBy("component", "apart").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    return spread_join(named, first, ["component", "apart"]).where(place != F.col("first")).select("id", "tie", "line", "word", "size")


def passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, min_words: int = SHINGLE) -> DataFrame:
    """(id_col, n_paragraphs, n_removed, removed_lines, removed_pieces, n_short_repeats, short_repeats) for each row of df.

    Removed are lines of at least LONG words, as summary() does, and of other lines pieces (line, word, size: first word
    and number of words; from the first word of a short line they go on over the next ones). short_repeats are the
    shorter lines that summary() removes.
    """
    given = _given(df, id_col, F.col(text_col), text_col)
    final = clusters(given, threshold, min_words)
    cleaned(df.sparkSession)
    kind = given.schema["id"].dataType.simpleString()
    told = stored(given.mapInArrow(_parts(min_words), f"id {kind}, tie long, at long, lines array<int>, words array<int>, sizes array<int>, pids array<long>, checks array<long>"))
    whole, long = F.col("word") == -1, F.col("size") >= LONG
    part = F.when(~whole, F.struct("line", F.greatest("word", F.lit(0)).alias("word"), "size"))
    lines = _lost(told, final).groupBy("id", "tie", "line").agg(F.max(F.when(whole, F.col("size"))).alias("size"), F.collect_set(part).alias("pieces"))
    longs, shorts = F.when(long, F.col("line")), F.when(~long, F.col("line"))
    left = F.when(F.col("size").isNull() | ~long, F.col("pieces"))
    ordered = lambda c, name: F.sort_array(c).alias(name)
    gone = lines.groupBy("id", "tie").agg(ordered(F.collect_list(longs), "longs"), ordered(F.flatten(F.collect_list(left)), "pieces"), ordered(F.collect_list(shorts), "shorts")).withColumnsRenamed({"id": "i", "tie": "t"})
    again = told.groupBy("id", "tie").agg(F.min("at").alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("j"), F.col("tie").alias("u"), "least")
    met = told.join(gone, F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")), "left").join(again, F.col("id").eqNullSafe(F.col("j")) & (F.col("tie") == F.col("u")), "left")
    told_as = lambda word: F.filter(F.arrays_zip("lines", "words", "sizes"), lambda x: x["words"] == word)
    own = told_as(-1)
    number = lambda c: F.transform(c, lambda x: x["lines"])
    repeated = F.col("at") > F.col("least")
    none = F.array().cast("array<int>")
    removed = F.when(repeated, number(F.filter(own, lambda x: x["sizes"] >= LONG))).otherwise(F.coalesce("longs", none))
    empty = F.array().cast("array<struct<line:int,word:int,size:int>>")
    runs_on = F.transform(told_as(-2), lambda x: F.struct(x["lines"].alias("line"), F.lit(0).alias("word"), x["sizes"].alias("size")))
    pieces = F.when(repeated, runs_on).otherwise(F.coalesce("pieces", empty))
    short = F.when(repeated, number(F.filter(own, lambda x: x["sizes"] < LONG))).otherwise(F.coalesce("shorts", none))
    count = lambda c: F.size(c).cast("long")
    return met.select(F.col("id").alias(id_col), count(own).alias("n_paragraphs"), (count(removed) + count(pieces)).alias("n_removed"), removed.alias("removed_lines"), pieces.alias("removed_pieces"), count(short).alias("n_short_repeats"), short.alias("short_repeats"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_paragraph_minhash: paragraphs and removals of every document."""
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
