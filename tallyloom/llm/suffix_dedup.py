"""Operator 4: exact substring dedup by a hash-compared suffix sort.

Every byte covered by a `LENGTH`-byte string that also starts earlier, by document id and then
offset, is removed. All windows of LENGTH bytes of the corpus are judged; sorting all of them as
suffixes in one place is what a cluster can't do, so the sort is split by content:

* The anchor of a window is its least k-gram by hash (the leftmost of equals). Equal windows have
  equal anchors at equal offsets, so suffixes need comparing only within one anchor's k-gram
  and one offset. Neighbouring windows share an anchor: about one anchor for 35 bytes.
* An anchor's span is all bytes of its windows. A block of documents settles repeats of a span within it and sends
  (k-gram hash, span hash) of each first occurrence; the bucket of the k-gram tells which k-grams occur
  again. Windows of all other k-grams, most of a text, have no repeats, and nothing more is done about them.
* The bytes of spans whose k-gram occurs again go to the bucket of their k-gram, and there suffix sorts
  decide: first whole spans are sorted, and a span that is met earlier repeats with all its
  windows; then the windows of those spans that differ but share a k-gram, the edges of repeats.
* A suffix sort is a mergesort: prefix polynomial hashes give the common extension of two suffixes by binary
  search, so a comparison is logarithmic. Neighbours that agree in full are verified byte by byte. What has
  a hash of its own among the candidates equals nothing and is left out of the sort, and candidates are
  sorted in lots of `LOT` bytes that keep equal hashes together.
* A k-gram with more than `HOT` different spans (a line or passage end that many documents share) is
  spread: its windows are dealt by their offset, `RANGE` offsets at a time, and by the bytes that all
  windows of such a range have in common.

The text is read twice from the input, so the input must be read in the same order twice: a table
or a checkpoint; a second reading that differs is an error.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; null ids come
after all others; of rows that share an id one counts as earlier, in the order of their blocks, so that of
repeated rows one copy stays; an empty table gives an empty result; extra columns are ignored by
`repeats` and kept by `without_repeats`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import blocks, buckets, trimmed, trimmed_both
from .text import expand, mix64, ragged, runs, squeeze

LENGTH, GRAM = 100, 32
#: Bytes of text in a block (no result depends on it), and of window starts handled at once.
BLOCK, STEP = (4 << 20) - 1, 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LAST = (1 << 63) - 1
#: What becomes of a span whose k-gram occurs again: it goes to the k-gram's bucket, or is spread by ranges of offsets.
SENT, SPREAD = 1, 2
#: Different spans of one k-gram from which on they are spread, offsets of a range, and bytes sorted at once.
HOT, RANGE, LOT = 4096, 9, 3 << 20


class Hashes:
    """Polynomial hashes modulo 2**64 of any substring, from prefix sums."""

    up = down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(Hashes.up) < len(data) + 1:
            n = 1 << len(data).bit_length()
            Hashes.up = Hashes.down = np.ones(1, np.uint64)
            up, down = np.full(n, BASE), np.full(n, INVERSE)
            up[0] = down[0] = 1
            Hashes.up, Hashes.down = np.cumprod(up, out=up), np.cumprod(down, out=down)
        self.data, self.prefix = data, np.zeros(len(data) + 1, np.uint64)
        letters = mix64(np.arange(1, 257, dtype=np.uint64))
        np.cumsum(letters[data] * self.up[: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.down[start]

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, `most` at most, by binary search."""
        low, high = np.zeros(len(a), np.int64), most - 1
        same = self.of(a, most) == self.of(b, most)
        low[same] = most[same]
        open_ = np.flatnonzero(~same)
        while len(open_):
            middle = (low[open_] + high[open_] + 1) // 2
            equal = self.of(a[open_], middle) == self.of(b[open_], middle)
            low[open_] = np.where(equal, middle, low[open_])
            high[open_] = np.where(equal, high[open_], middle - 1)
            open_ = open_[low[open_] < high[open_]]
        return low

    def compare(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix at a is below, equal or above that at b in its first `most` bytes."""
        n = self.extension(a, b, most)
        at = np.minimum(n, most - 1)
        return np.where(n == most, 0, np.sign(self.data[a + at].astype(np.int16) - self.data[b + at]))


def suffix_sort(hashes: Hashes, starts: np.ndarray, group: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Order that sorts suffixes by their first `most` bytes, the same in a group, within each run of equal group, keeping the order of equals.

    A mergesort from the bottom, all runs and groups at once: an element's place in a merged run is
    its place in its own run plus the number of elements of the other run before it, found by binary search.
    """
    n = len(starts)
    order = np.arange(n)
    if not n:
        return order
    first = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    size = np.diff(np.append(first, n))
    begin, end = np.repeat(first, size), np.repeat(first + size, size)
    place, width = np.arange(n) - begin, 1
    while width < size.max():
        run = begin + place // width * width
        left = place // width % 2 == 0
        other = np.where(left, run + width, run - width)
        count = np.clip(np.minimum(end - other, width), 0, width)
        low, high = np.zeros(n, np.int64), count.copy()
        open_ = np.flatnonzero(count > 0)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            sign = hashes.compare(starts[order[other[open_] + middle]], starts[order[open_]], most[order[open_]])
            before = np.where(left[open_], sign < 0, sign <= 0)
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        merged = np.empty(n, np.int64)
        merged[np.minimum(run, np.where(left, run, other)) + (np.arange(n) - run) + low] = order
        order, width = merged, width * 2
    return order


def later_equals(hashes: Hashes, starts: np.ndarray, group: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Marks suffixes equal in `most` bytes to one that stands before them in their group.

    group must be sorted. Equal neighbours of the suffix sort are verified byte by byte; if hashes
    lied anywhere, that is done again on the bytes themselves.
    """
    order = suffix_sort(hashes, starts, group, most)
    a, b = order[:-1], order[1:]
    same = np.zeros(len(order), bool)
    pair = np.flatnonzero(group[a] == group[b]) if len(order) else np.zeros(0, np.int64)
    same[pair + 1] = hashes.extension(starts[a[pair]], starts[b[pair]], most[b[pair]]) == most[b[pair]]
    for at in range(0, len(order), 1 << 14):
        some = at + np.flatnonzero(same[at : at + (1 << 14)])
        one, two = order[some], order[some - 1]
        if (hashes.data[ragged(starts[one], most[one])] != hashes.data[ragged(starts[two], most[one])]).any():
            seen: set[tuple[int, bytes]] = set()
            out = np.zeros(len(starts), bool)
            for i, (g, s, n) in enumerate(zip(group.tolist(), starts.tolist(), most.tolist(), strict=True)):
                key = (g, hashes.data[s : s + n].tobytes())
                out[i] = key in seen
                seen.add(key)
            return out
    out = np.zeros(len(starts), bool)
    out[order] = same
    return out


def later(data: np.ndarray, starts: np.ndarray, most: np.ndarray, group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Marks the strings (starts, most) of data that are equal to an earlier one of their group.

    Equal strings of a group must have equal keys. Only strings whose key repeats are sorted, in lots of
    some megabytes that keep a key together; a key with more than a lot is compared with its first string,
    a lot at a time, and what differs from that is taken up again.
    """
    out = np.zeros(len(starts), bool)
    order = np.lexsort((key, group))
    while len(order):
        fresh = (np.diff(group[order], prepend=~group[order[:1]]) != 0) | (np.diff(key[order], prepend=~key[order[:1]]) != 0)
        run = np.cumsum(fresh) - 1
        many = np.bincount(run)[run] > 1
        order, run = order[many], run[many]
        left = [order[:0]]
        cuts = np.append(np.flatnonzero(np.diff(run, prepend=-1)), len(run))
        load = np.append(0, np.cumsum(most[order]))[cuts]
        at = 0
        while at < len(cuts) - 1:
            end = max(at + 1, int(np.searchsorted(load, load[at] + LOT, side="right")) - 1)
            one = order[cuts[at] : cuts[end]]
            whole = load[end] - load[at] <= LOT
            step = len(one) if whole else max(2, LOT // int(most[one[0]]))
            for lo in range(0, len(one), step):
                some = one[lo : lo + step] if not lo else np.append(one[0], one[lo : lo + step])
                size = most[some]
                body = Hashes(data[ragged(starts[some], size)])
                found = later_equals(body, np.cumsum(size) - size, np.cumsum(np.diff(group[some], prepend=group[some[0]]) != 0), size)
                out[some[found]] = True
                if not whole:
                    left.append(some[1 if lo else 0 :][~found[1 if lo else 0 :]])
            at = end
        # what is left of a large key beside its first string: strings that a lying hash put there
        rest = np.concatenate(left)
        order = rest[~np.isin(rest, order[cuts[:-1]])] if len(rest) else rest
    return out


def anchors(hashes: Hashes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor) of each anchor in texts laid end to end with these bounds."""
    n, wide = len(hashes.data), LENGTH - GRAM + 1
    lens = np.diff(bounds)
    full = lens >= LENGTH
    windows = n - LENGTH + 1
    low, high, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if windows <= 0 or not full.any():
        return low[0], high[0], place[0]
    valid = np.zeros(n + 1, np.int32)
    np.add.at(valid, bounds[:-1][full], 1)
    np.add.at(valid, bounds[1:][full] - LENGTH + 1, -1)
    valid = np.cumsum(valid)[:windows] > 0
    for at in range(0, windows, STEP):
        count = min(STEP, windows - at)
        grams = count + wide - 1
        key = mix64(hashes.of(np.arange(at, at + grams), GRAM)) >> np.uint64(24) << np.uint64(24) | np.arange(grams, dtype=np.uint64)
        tiles = np.full(-(-grams // wide) * wide, ~np.uint64(0))
        tiles[:grams] = key
        tiles = tiles.reshape(-1, wide)
        ahead = np.minimum.accumulate(tiles, axis=1).reshape(-1)
        back = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(back[:count], ahead[wide - 1 : wide - 1 + count])
        start = np.flatnonzero(valid[at : at + count])
        if not len(start):
            continue
        best = (least[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.flatnonzero((np.diff(best, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
        low.append(at + start[new])
        high.append(at + start[np.append(new[1:], len(start)) - 1])
        place.append(at + best[new])
    low, high, place = map(np.concatenate, (low, high, place))
    if len(low) > 1:  # an anchor cut in two by a step is one again
        new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.append(-1, high[:-1]) + 1 != low))
        high, low, place = high[np.append(new[1:], len(low)) - 1], low[new], place[new]
    return low, high, place


def _laid(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a block in id order, their ids for ordering, all their bytes and the bounds."""
    keys = pa.compute.fill_null(table.column("id"), LAST).to_numpy()
    rows = np.argsort(keys, kind="stable")
    texts = [(t or "").encode() for t in table.column("text").take(pa.array(rows)).to_pylist()]
    bounds = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
    return table.take(pa.array(rows)), keys[rows], np.frombuffer(b"".join(texts), np.uint8), bounds


def _spans(hashes: Hashes, bounds: np.ndarray):
    """Anchors of a block with k-gram hash and span hash, and which are the block's first of their kind."""
    low, high, place = anchors(hashes, bounds)
    gram = mix64(hashes.of(place, GRAM))
    shape = ((place - low).astype(np.uint64) << np.uint64(8)) + (high - low).astype(np.uint64)
    span = mix64(mix64(hashes.of(low, high - low + LENGTH)) + mix64(shape))
    return low, high, place, gram, span, ~later(hashes.data, low, high - low + LENGTH, mix64(gram + shape), span)


def _sent(buckets: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks(batches, "text", most, "id"):
            _, _, data, bounds = _laid(table)
            low, high, place, gram, span, first = _spans(Hashes(data), bounds)
            at = np.flatnonzero(first)
            of = (gram[at] % np.uint64(buckets)).astype(np.int32)
            at, of = at[order := np.argsort(of, kind="stable")], of[order]
            for a, b in runs(of):
                one = at[a:b]
                columns = (gram[one], span[one], low[one].astype(np.int32), (high[one] - low[one]).astype(np.uint8), (place[one] - low[one]).astype(np.uint8))
                yield pa.record_batch([pa.array([of[a]], pa.int32()), pa.array([block], pa.int64()), *(pa.array([squeeze(c)], pa.binary()) for c in columns)], names=["bucket", "block", "gram", "span", "low", "wide", "back"])

    return run


def _column(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    parts_ = [expand(x.as_py(), kind) for x in table.column(name)]
    return np.concatenate([np.zeros(0, kind), *parts_]), np.fromiter(map(len, parts_), np.int64, len(parts_))


def _judged(hot: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _told(table, hot)


def _told(table: pa.Table, hot: int) -> pa.Table:
    """The spans of a bucket whose k-gram occurs again, by block, and whether they are SENT to it or SPREAD."""
    gram, lens = _column(table, "gram", np.uint64)
    span, low, wide, back = (_column(table, n, k)[0] for n, k in (("span", np.uint64), ("low", np.int32), ("wide", np.uint8), ("back", np.uint8)))
    order = np.lexsort((span, gram))
    fresh = np.diff(gram[order], prepend=~gram[order[:1]]) != 0
    kind = fresh | (np.diff(span[order], prepend=~span[order[:1]]) != 0)
    group = np.cumsum(fresh) - 1
    state = np.zeros(len(order), np.uint8)
    state[order] = np.where(np.bincount(group)[group] < 2, 0, np.where(np.bincount(group, weights=kind)[group] > hot, SPREAD, SENT))
    out = {n: [] for n in ("block", "low", "wide", "back", "state")}
    start = 0
    for n, b in zip(lens.tolist(), table.column("block").to_pylist(), strict=True):
        at = start + np.flatnonzero(state[start : start + n])
        start += n
        if len(at):
            for c, v in zip(out, (b, low[at], wide[at], back[at], state[at]), strict=True):
                out[c].append(v if c == "block" else squeeze(v))
    return pa.table({"block": pa.array(out["block"], pa.int64())} | {n: pa.array(out[n], pa.binary()) for n in ("low", "wide", "back", "state")})


def _packed(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block as one row: its documents' ids, lengths and bytes, and the spans that repeat within it."""
        for block, table in blocks(batches, "text", most, "id"):
            rows, _, data, bounds = _laid(table)
            low, high, _, _, _, first = _spans(Hashes(data), bounds)
            yield pa.record_batch({
                "block": pa.array([block], pa.int64()), "ids": pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())), "rest": pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column("rest").combine_chunks()), "lens": pa.array([squeeze(np.diff(bounds))], pa.binary()),
                "data": pa.array([zstandard.compress(data.tobytes(), 3)], pa.binary()), "low": pa.array([squeeze(low[~first].astype(np.int32))], pa.binary()), "wide": pa.array([squeeze((high - low)[~first].astype(np.uint8))], pa.binary()),
            })

    return run


def _bytes(packed: pa.Table) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed.column("data")[0].as_py()), np.uint8)


def _ranges(low: np.ndarray, wide: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(span, low, wide, back, start of the bytes in common) of the ranges of offsets of spans.

    A window's offset is how far its k-gram stands from its start. Windows of a range hold the LENGTH - RANGE + 1
    bytes from the first of their last window on.
    """
    first, last = (back - wide) // RANGE, back // RANGE
    count = last - first + 1
    of = np.repeat(np.arange(len(low)), count)
    number = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = np.maximum(back[of] - number * RANGE - RANGE + 1, 0)
    end = np.minimum(back[of] - number * RANGE, wide[of])
    return of, low[of] + start, end - start, back[of] - start, low[of] + back[of] - number * RANGE


def _edges(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(packed: pa.Table, judged: pa.Table) -> pa.Table:
        """The bytes of spans whose k-gram occurs again, by the bucket of the k-gram, or of range and common bytes."""
        out = {n: [] for n in ("bucket", "block", "ids", "low", "wide", "back", "data")}
        if judged.num_rows:
            if not packed.num_rows:
                raise RuntimeError("the input changed between its two readings; store it first")
            low, wide, back, state = (_column(judged, n, k)[0].astype(np.int64) for n, k in (("low", np.int32), ("wide", np.uint8), ("back", np.uint8), ("state", np.uint8)))
            data = _bytes(packed)
            bounds = np.append(0, np.cumsum(expand(packed.column("lens")[0].as_py(), np.int64)))
            ids = pa.compute.fill_null(packed.column("ids").combine_chunks().flatten(), LAST).to_numpy(zero_copy_only=False)
            spread = state == SPREAD
            _, *cut, common = _ranges(low[spread], wide[spread], back[spread])
            keys = lambda at, n: mix64(Hashes(data[ragged(at, np.full(len(at), n))]).of(np.arange(len(at)) * n, n))
            key = np.concatenate([keys((low + back)[~spread], GRAM), keys(common, LENGTH - RANGE + 1)])
            low, wide, back = (np.concatenate([x[~spread], y]) for x, y in zip((low, wide, back), cut, strict=True))
            of = (mix64(key) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((low, of))
            id_ = ids[np.searchsorted(bounds, low, side="right") - 1]
            for a, b in runs(of[order]):
                one = order[a:b]
                body = data[ragged(low[one], wide[one] + LENGTH)]
                for n, v in zip(out, (of[one[0]], packed.column("block")[0].as_py(), squeeze(id_[one]), squeeze(low[one].astype(np.int32)), squeeze(wide[one].astype(np.uint8)), squeeze(back[one].astype(np.uint8)), zstandard.compress(body.tobytes(), 1)), strict=True):
                    out[n].append(v)
        kinds = {"bucket": pa.int32(), "block": pa.int64()}
        return pa.table({n: pa.array(v, kinds.get(n, pa.binary())) for n, v in out.items()})

    return run


def _hashed(data: np.ndarray, begin: np.ndarray, wide: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(span, shift, group by k-gram and offset, hash) of every window of spans, some megabytes of them at a time."""
    parts_, size = [], wide + LENGTH
    for lo, hi in runs(np.cumsum(size) // LOT):
        hashes, at = Hashes(data[ragged(begin[lo:hi], size[lo:hi])]), np.cumsum(size[lo:hi]) - size[lo:hi]
        count = wide[lo:hi] + 1
        of = np.repeat(np.arange(hi - lo), count)
        shift = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        gram = hashes.of(at + back[lo:hi], GRAM)
        parts_.append((of + lo, shift, mix64(gram[of] + mix64((back[lo:hi][of] - shift).astype(np.uint64))), hashes.of(at[of] + shift, LENGTH)))
    none = np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*parts_, strict=True))) if parts_ else (none, none, none.view(np.uint64), none.view(np.uint64))


def _decided(table: pa.Table) -> pa.Table:
    """The spans of a bucket that are met earlier, and the windows that come earlier in another span, by block."""
    low, lens = _column(table, "low", np.int32)
    ids, wide, back = (_column(table, n, k)[0].astype(np.int64) for n, k in (("ids", np.int64), ("wide", np.uint8), ("back", np.uint8)))
    row = np.repeat(np.arange(table.num_rows), lens)
    data = np.frombuffer(b"".join(zstandard.decompress(x.as_py()) for x in table.column("data")), np.uint8)
    begin = np.cumsum(wide + LENGTH) - wide - LENGTH
    order = np.lexsort((low, table.column("block").to_numpy()[row], ids))
    low, wide, back, row, begin = (x[order] for x in (low, wide, back, row, begin))
    size, gram, span = wide + LENGTH, np.zeros(len(low), np.uint64), np.zeros(len(low), np.uint64)
    for lo, hi in runs(np.cumsum(size) // LOT):
        hashes, at = Hashes(data[ragged(begin[lo:hi], size[lo:hi])]), np.cumsum(size[lo:hi]) - size[lo:hi]
        gram[lo:hi], span[lo:hi] = hashes.of(at + back[lo:hi], GRAM), hashes.of(at, size[lo:hi])
    whole = later(data, begin, size, mix64(gram + (back << 8 | wide).astype(np.uint64)), span)
    # what is left of k-grams with several spans
    _, group = np.unique(gram, return_inverse=True)
    edge = np.flatnonzero(~whole & (np.bincount(group, weights=~whole)[group] > 1)) if len(gram) else np.zeros(0, np.int64)
    of, shift, group, key = _hashed(data, begin[edge], wide[edge], back[edge])
    found = later(data, begin[edge][of] + shift, np.full(len(of), LENGTH), group, key)
    rows = np.concatenate([row[whole], row[edge][of[found]]])
    starts = np.concatenate([low[whole], low[edge][of[found]] + shift[found]]).astype(np.int32)
    wide = np.concatenate([wide[whole], np.zeros(int(found.sum()), np.int64)]).astype(np.uint8)
    by = np.lexsort((starts, rows))
    names, out = table.column("block").to_pylist(), {n: [] for n in ("block", "low", "wide")}
    for a, b in runs(rows[by]):
        for n, v in zip(out, (names[rows[by[a]]], squeeze(starts[by[a:b]]), squeeze(wide[by[a:b]])), strict=True):
            out[n].append(v)
    return pa.table({n: pa.array(v, pa.int64() if n == "block" else pa.binary()) for n, v in out.items()})


def _cleared(texts: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(packed: pa.Table, found: pa.Table) -> pa.Table:
        """Documents of a block with the covered runs and the bytes that stay; with texts, only whole characters of them."""
        out = {n: [] for n in ("n_bytes", "spans", "kept")}
        for one in packed.to_batches():
            for r in range(one.num_rows):
                line = pa.Table.from_batches([one.slice(r, 1)])
                data = _bytes(line)
                bounds = np.append(0, np.cumsum(expand(line.column("lens")[0].as_py(), np.int64)))
                low, wide = (expand(line.column(n)[0].as_py(), k) for n, k in (("low", np.int32), ("wide", np.uint8)))
                low = np.concatenate([low, _column(found, "low", np.int32)[0]])
                wide = np.concatenate([wide, _column(found, "wide", np.uint8)[0]])
                n = len(data)
                cover = np.bincount(low, minlength=n + 1) - np.bincount(low.astype(np.int64) + wide + LENGTH, minlength=n + 1)
                gone = np.cumsum(cover)[:n] > 0
                change = np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))
                # windows never cross documents, but runs of neighbours may touch
                starts = np.union1d(np.flatnonzero(change == 1), bounds[1:-1][gone[np.minimum(bounds[1:-1], max(n - 1, 0))] & (bounds[1:-1] < n)] if n else bounds[:0])
                ends = np.union1d(np.flatnonzero(change == -1), bounds[1:-1][gone[bounds[1:-1] - 1] & (bounds[1:-1] > 0)] if n else bounds[:0])
                cut = np.searchsorted(starts, bounds)
                kept = data[~gone].tobytes()
                left = np.append(0, np.cumsum(~gone))[bounds]
                for i in range(len(bounds) - 1):
                    own = slice(cut[i], cut[i + 1])
                    out["n_bytes"].append(int(bounds[i + 1] - bounds[i]))
                    out["spans"].append([{"start": int(x), "end": int(y)} for x, y in zip(starts[own] - bounds[i], ends[own] - bounds[i], strict=True)])
                    own = kept[left[i] : left[i + 1]]
                    out["kept"].append(own.decode(errors="ignore").encode() if texts else own)
        return pa.table({"rest": packed.column("rest").combine_chunks().flatten(), "n_bytes": pa.array(out["n_bytes"], pa.int64()), "spans": pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(out["kept"], pa.binary())})

    return run


def _found(df: DataFrame, id_col: str, text_col: str, block: int, texts: bool = False, hot: int = HOT) -> DataFrame:
    """(rest, n_bytes, spans, kept); rest holds all columns but the text."""
    many = buckets(df, text_col)
    rest = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text_col))
    given = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), rest.alias("rest"))
    kind = given.schema["rest"].dataType
    long, binary = T.LongType(), T.BinaryType()
    arrays = "low binary, wide binary, back binary"
    sent = given.select("id", "text").mapInArrow(_sent(many, block), f"bucket int, block long, gram binary, span binary, {arrays}")
    judged = sent.groupBy("bucket").applyInArrow(trimmed(_judged(hot)), f"block long, {arrays}, state binary")
    columns = {"block": long, "ids": T.ArrayType(long), "rest": T.ArrayType(kind), "lens": binary, "data": binary, "low": binary, "wide": binary}
    packed = given.mapInArrow(_packed(block), T.StructType([T.StructField(*c) for c in columns.items()]))
    edges = packed.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(trimmed_both(_edges(many)), f"bucket int, block long, ids binary, {arrays}, data binary")
    found = edges.groupBy("bucket").applyInArrow(trimmed(_decided), "block long, low binary, wide binary")
    columns = {"rest": kind, "n_bytes": long, "spans": T.ArrayType(T.StructType([T.StructField("start", long), T.StructField("end", long)])), "kept": binary}
    return packed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(trimmed_both(_cleared(texts)), T.StructType([T.StructField(*c) for c in columns.items()]))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(id_col, n_bytes, spans array<struct<start, end>>, kept binary) for each row of df; ids are longs. No result depends on block and hot."""
    found = _found(df.select(id_col, text_col), id_col, text_col, block, hot=hot)
    return found.select(F.col("rest")[id_col].alias(id_col), "n_bytes", "spans", "kept")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of df with what stays of their texts; rows without a word left are dropped.

    Characters that a removed run cut in two are dropped with it.
    """
    found = _found(df, id_col, text_col, block, texts=True)
    kept = found.withColumn("left", F.col("kept").cast("string"))
    names = [F.col("left").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in df.columns]
    return kept.where(F.col("left").rlike(r"[^\x20\x09-\x0D]")).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_suffix_dedup: what is removed from every document, and a digest of what stays."""
    found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
