"""Operator 9: language-model scores from an Elias-Fano n-gram trie.

The model is a backoff model with absolute discounting. Its counts come from the training documents; level by
level, the n-grams of all documents go to the shard of their context, as each block's distinct n-grams with
their training counts. A shard sums the counts, builds its part of the trie level in memory-mapped
files, answers the n-grams by looking them up there, and sends a quantised answer for each n-gram
back to its block, where documents add up their tokens. The model is thus as large as the
corpus makes it and never in one place.

A trie level of a shard holds: the contexts as an Elias-Fano sequence; pointers, monotone and
Elias-Fano coded, to each context's successors; the successors as another Elias-Fano sequence,
monotone because each context's first one is lifted above the last of the context before; an 8-bit
code of log10 p for each successor and of the backoff weight for each context. A query finds its
context, then searches the successors between that context's two pointers, relative to its lift.
The places of the zeros among the high parts narrow a search to values of the same high part.

    p(w | h) = (c(hw) - D(h)) / c(h)         if hw was trained on
             = a(h) * p(w | h without its first word)    otherwise, a(h) = 1 for an unseen h
    a(h) = D(h) * types(h) / c(h) / (1 - sum over trained w of p(w | shorter h))
    p(w) = (c(w) + 1) / (N + V + 1)
    D(h) = (n1 + PRIOR * WEIGHT) / (n1 + 2 * n2 + WEIGHT)

n1 and n2 are the words that followed h once and twice: a context estimates its own discount, drawn
to PRIOR where it is rare, so a score depends on the corpus alone and not on how it is dealt.

Keys of contexts and n-grams are hashes of word ids; where keys are equal the ids are compared, and if
any differ they are told apart by the ids themselves.

The text is read twice from the input, so the input must be read in the same order each time: a
table or a checkpoint. A second reading that differs is an error.

Defined results: a null text is empty and has one token, its end; null ids are training documents
(no crc32); repeated rows count as often as they occur; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import tempfile
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .frames import blocks, buckets, stored
from .text import expand, mix64, squeeze

FOLDS, HELD_OUT, ORDER = 7, 2, 3
BLOCK = 8 << 20
#: The discount of a context of which nothing is known, and how many words that counts for.
PRIOR, WEIGHT = 0.75, 4.0
#: The end of a text and what stands before its first word; words hold no white space.
END, BEGIN = b" ", b"\n"
#: Grids of the 8-bit codes: log10 p from -10 to 0 (p_grid() reaches lower in large corpora), log10 of a backoff weight from -5 to 2.
P_GRID, A_GRID = (-10.0, 0.0), (-5.0, 2.0)
NO_CONTEXT = 512
#: The bits of a context's key that its n-grams' keys begin with; shards are ranges of them.
HEAD = np.uint64(((1 << 24) - 1) << 40)


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def quantised(x: np.ndarray, grid: tuple[float, float]) -> np.ndarray:
    return np.clip(np.rint((x - grid[0]) / (grid[1] - grid[0]) * 255), 0, 255).astype(np.uint8)


def p_grid(n: int, v: int) -> tuple[float, float]:
    """The grid of log10 p in a corpus: two below that of an unknown word at least, so that no word's is cut off however many tokens there are."""
    return min(P_GRID[0], -math.log10(n + v + 1) - 2), P_GRID[1]


def restored(code: np.ndarray, grid: tuple[float, float]) -> np.ndarray:
    return grid[0] + code.astype(np.float64) / 255 * (grid[1] - grid[0])


class EliasFano:
    """A monotone sequence of unsigned numbers in memory-mapped arrays: packed low bits and a bit vector of high parts."""

    def __init__(self, values: np.ndarray, folder: str, name: str):
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        self.n, self.bits = n, max(0, (top // max(n, 1)).bit_length() - 1)
        self.width = np.uint64(self.bits)
        self.mask = np.uint64((1 << self.bits) - 1)
        at = np.arange(n, dtype=np.uint64) * self.width
        low = np.zeros(int(n * self.bits) // 64 + 2, np.uint64)
        values = values.astype(np.uint64)
        part, shift = values & self.mask, at & np.uint64(63)
        np.bitwise_or.at(low, (at >> np.uint64(6)).astype(np.int64), part << shift)
        over = shift + self.width > 64
        np.bitwise_or.at(low, (at[over] >> np.uint64(6)).astype(np.int64) + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (values >> self.width).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) if n else 0) // 64 * 64 + 64, np.uint8)
        bits[ones] = 1
        self.zeros = self._mapped(f"{folder}/{name}.zeros", np.flatnonzero(bits == 0).astype(np.uint32))
        high = np.packbits(bits, bitorder="little")
        self.low, self.high = (self._mapped(f"{folder}/{name}.{k}", v) for k, v in (("low", low), ("high", high)))
        self.ones = self.high.view(np.uint64)
        counts = np.bitwise_count(self.ones)
        self.before = self._mapped(f"{folder}/{name}.rank", np.append(0, np.cumsum(counts, dtype=np.int64)).astype(np.uint32))

    @staticmethod
    def _mapped(path: str, values: np.ndarray) -> np.ndarray:
        values.tofile(path)
        return np.memmap(path, values.dtype, "r").view(np.ndarray)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at positions i."""
        word = np.searchsorted(self.before, i.astype(np.uint32), side="right") - 1
        bits = self.ones[word] if len(i) else np.zeros(0, np.uint64)
        rest = (i - self.before[word]).astype(np.uint64)
        # set bits of each byte, then of each byte and all before it, side by side in a word
        count = bits - (bits >> np.uint64(1) & PAIRS)
        count = (count & FOURS) + (count >> np.uint64(2) & FOURS)
        count = ((count + (count >> np.uint64(4))) & BYTES) * EACH
        byte = np.bitwise_count((rest * EACH | TOPS) - count & TOPS).astype(np.uint64) << np.uint64(3)
        rest -= count << np.uint64(8) >> byte & np.uint64(255)
        place = word.astype(np.uint64) * np.uint64(64) + byte + SELECT[(bits >> byte & np.uint64(255)) << np.uint64(3) | rest]
        high = place - i.astype(np.uint64) << self.width
        if not self.bits:
            return high
        bit = i.astype(np.uint64) * self.width
        cell, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        value = self.low[cell] >> shift
        spill = np.where(shift > 0, self.low[cell + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return high | (value | spill) & self.mask

    def _below(self, part: np.ndarray) -> np.ndarray:
        """How many values have a high part less than part: the ones before the zero that ends part - 1."""
        at = np.minimum(part, np.uint64(len(self.zeros))).astype(np.int64)
        ended = self.zeros[np.clip(at - 1, 0, max(len(self.zeros) - 1, 0))].astype(np.int64) - (at - 1) if len(self.zeros) else at
        return np.where(part > np.uint64(len(self.zeros)), self.n, np.where(at > 0, ended, 0))

    def successor(self, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first position in [low, high) with a value of at least wanted, else high."""
        part = wanted.astype(np.uint64) >> self.width
        low, high = np.clip(self._below(part), low, high), np.clip(self._below(part + np.uint64(1)), low, high)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            less = self.at(middle) < wanted[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        return low


#: Position of the k-th set bit of a byte b, at 8 * b + k, and masks of a word's bits.
SELECT = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint64).reshape(-1)
PAIRS, FOURS, BYTES, EACH, TOPS = (np.uint64(x * 0x0101010101010101) for x in (0x55, 0x33, 0x0F, 0x01, 0x80))


class Level:
    """A shard's part of a trie level, from distinct trained (context, word) with counts and lower-order log10 p."""

    def __init__(self, context: np.ndarray, word: np.ndarray, count: np.ndarray, lower: np.ndarray, folder: str, grid: tuple[float, float] = P_GRID):
        first = np.flatnonzero(np.diff(context, prepend=~context[:1]))
        size = np.diff(np.append(first, len(context)))
        total, once, twice = (np.add.reduceat(x, first, dtype=np.int64) if len(first) else count[:0] for x in (count, count == 1, count == 2))
        discount = (once + PRIOR * WEIGHT) / (once + 2 * twice + WEIGHT)
        of = np.repeat(np.arange(len(first)), size)
        p = np.log10((count - discount[of]) / total[of])
        seen = np.add.reduceat(10.0**lower, first) if len(first) else lower[:0]
        weight = np.log10(discount * size / total / np.maximum(1 - seen, 1e-5))
        self.span = np.uint64(int(word.max()) + 1 if len(word) else 1)
        self.contexts = EliasFano(context[first] >> np.uint64(2), folder, "contexts")
        self.exact = EliasFano._mapped(f"{folder}/contexts.rest", (context[first] & np.uint64(3)).astype(np.uint8))
        self.pointers = EliasFano(np.append(first, len(context)).astype(np.uint64), folder, "pointers")
        self.successors = EliasFano(of.astype(np.uint64) * self.span + word, folder, "successors")
        self.p = EliasFano._mapped(f"{folder}/p", quantised(p, grid))
        self.a = EliasFano._mapped(f"{folder}/a", quantised(weight, A_GRID))

    def answer(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """For each query 0..255 (a code of p), 256..511 (a code of the backoff weight) or NO_CONTEXT."""
        out = np.full(len(context), NO_CONTEXT, np.uint16)
        n = self.contexts.n
        if not n:
            return out
        fresh = np.diff(context, prepend=~context[:1]) != 0
        ask, of = context[fresh], np.cumsum(fresh) - 1
        at = self.contexts.successor(ask >> np.uint64(2), np.zeros(len(ask), np.int64), np.full(len(ask), n))
        for _ in range(3):  # contexts that share all but the last two bits stand side by side
            here = np.minimum(at, n - 1)
            step = (at < n) & (self.contexts.at(here) == ask >> np.uint64(2)) & (self.exact[here] < (ask & np.uint64(3)))
            at = at + step
        here = np.minimum(at, n - 1)
        known = (at < n) & (self.contexts.at(here) == ask >> np.uint64(2)) & (self.exact[here] == (ask & np.uint64(3)))
        low, high = self.pointers.at(here).astype(np.int64), self.pointers.at(here + 1).astype(np.int64)
        ask = np.flatnonzero(known[of] & (word < self.span))
        c = of[ask]
        wanted = here[c].astype(np.uint64) * self.span + word[ask]
        at = self.successors.successor(wanted, low[c], high[c])
        found = (at < high[c]) & (self.successors.at(np.minimum(at, self.successors.n - 1)) == wanted)
        out[known[of]] = 256 + self.a[here[of[known[of]]]].astype(np.uint16)
        out[ask[found]] = self.p[at[found]]
        return out


def _tokens(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of a block, frequent first; codes of all texts end to end; lengths; which are trained on."""
    texts = pa.compute.ascii_lower(pa.compute.fill_null(table.column("text").combine_chunks(), ""))
    lists = pa.compute.ascii_split_whitespace(texts)
    doc = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy())
    found = lists.flatten()
    some = pa.compute.greater(pa.compute.binary_length(found), 0)
    doc, coded = doc[some.to_numpy(zero_copy_only=False)], found.filter(some).dictionary_encode()
    names = [*coded.dictionary.cast(pa.binary()).to_pylist(), END]
    lens = np.bincount(doc, minlength=len(lists)) + 1
    flat = np.full(len(doc) + len(lists), len(names) - 1, np.uint32)
    flat[np.arange(len(doc)) + doc] = coded.indices.to_numpy()
    by = np.argsort(-np.bincount(flat, minlength=len(names)), kind="stable")
    rank = np.empty(len(names), np.uint32)
    rank[by] = np.arange(len(names), dtype=np.uint32)
    train = np.array([not held_out(i) for i in table.column("id").to_pylist()], bool)
    return [names[i] for i in by], rank[flat], lens, train


def _bucketed(of: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A stable order by bucket and the (bucket, from, to) runs in it."""
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order], prepend=-1))
    return order, [(int(of[order[a]]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(of)], strict=True)]


def _lists(buckets: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct tokens of each block by bucket, with their training counts."""
        for key, table in blocks(batches, "text", most, "id"):
            names, flat, lens, train = _tokens(table)
            counts = np.bincount(flat[np.repeat(train, lens)], minlength=len(names))
            of = np.fromiter((zlib.crc32(w) % buckets for w in names), np.int32, len(names))
            order, runs = _bucketed(of)
            for bucket, a, b in runs:
                yield pa.record_batch({"bucket": pa.array([bucket], pa.int32()), "block": pa.array([key], pa.int64()), "words": pa.array([[names[i] for i in order[a:b]]], pa.list_(pa.binary())), "counts": pa.array([squeeze(counts[order[a:b]].astype(np.int32))], pa.binary())})

    return run


def _counted(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """Corpus counts and ids of a bucket's words for each block, and the bucket's totals on its first row."""
        lists = table.column("words").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        counts = np.bincount(index, weights=np.concatenate([expand(c.as_py(), np.int32) for c in table.column("counts")]), minlength=len(coded.dictionary)).astype(np.int64)
        # ids are ranks by count, so that frequent words have small ids; ties by the word itself
        texts = coded.dictionary.to_pylist()
        by = sorted(range(len(texts)), key=lambda i: (-counts[i], texts[i]))
        ids = np.empty(len(texts), np.int64)
        ids[by] = np.arange(len(texts)) * buckets + table.column("bucket")[0].as_py() + 1
        cuts = np.append(0, np.cumsum(pa.compute.list_value_length(lists).to_numpy()))
        rows = [index[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        first = [r == 0 for r in range(len(rows))]
        return pa.table({
            "block": table.column("block"), "bucket": table.column("bucket"), "ids": pa.array([squeeze(ids[r]) for r in rows], pa.binary()), "counts": pa.array([squeeze(counts[r]) for r in rows], pa.binary()),
            "n": pa.array([int(counts.sum()) * f for f in first], pa.int64()), "v": pa.array([int((counts > 0).sum()) * f for f in first], pa.int64()),
        })

    return run


def _documents(buckets: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block as one row: ids, lengths, token codes and the codes' places in the bucketed word lists."""
        for key, table in blocks(batches, "text", most, "id"):
            names, flat, lens, train = _tokens(table)
            of = np.fromiter((zlib.crc32(w) % buckets for w in names), np.int32, len(names))
            place = np.empty(len(names), np.uint32)
            place[np.argsort(of, kind="stable")] = np.arange(len(names), dtype=np.uint32)
            ids = table.column("id").combine_chunks()
            yield pa.record_batch([pa.array([key], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([squeeze(c)], pa.binary()) for c in (lens, train.astype(np.uint8), flat, place))], names=["block", "docs", "lens", "train", "codes", "places"])

    return run


def _context(words_: list[np.ndarray]) -> np.ndarray:
    """The key of a context from the ids of its words."""
    context = np.ones(len(words_[0]), np.uint64)
    for word in words_:
        context = mix64(context * np.uint64(0x9E3779B97F4A7C15) + word)
    return context


class _Block:
    """A block's tokens as word ids, with the model's lower levels as far as they are known."""

    def __init__(self, docs: pa.Table, lists: pa.Table, n: int, v: int):
        self.lens, self.train = expand(docs.column("lens")[0].as_py(), np.int64), expand(docs.column("train")[0].as_py(), np.uint8) > 0
        lists = lists.sort_by("bucket")
        ids, counts = (np.concatenate([expand(x.as_py(), np.int64) for x in lists.column(c)]) for c in ("ids", "counts"))
        place = expand(docs.column("places")[0].as_py(), np.uint32)
        if len(place) != len(ids):
            raise RuntimeError("the input changed between its two readings; store it first")
        own = place[expand(docs.column("codes")[0].as_py(), np.uint32)]
        self.ids, self.counts = ids[own], counts[own]
        self.base, self.grid = np.log10((self.counts + 1) / (n + v + 1)), p_grid(n, v)
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        self.place = np.arange(len(own)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)

    def before(self, order: int) -> list[np.ndarray]:
        """The words before each token, farthest first; 0 stands before a text."""
        out = []
        for back in range(order - 1, 0, -1):
            word = np.zeros(len(self.ids), np.uint64)
            word[back:] = self.ids[: len(self.ids) - back]
            word[self.place < back] = 0
            out.append(word)
        return out

    def grams(self, order: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(representatives of the distinct n-grams by shard and key, gram of each token, context keys, shards, words before)."""
        before = self.before(order)
        context = _context(before)
        # one sort brings n-grams together and their contexts in order: the key begins as the context's does
        key = context & HEAD | mix64(context + mix64(self.ids.astype(np.uint64))) & ~HEAD
        by = np.argsort(key)
        fresh = np.diff(key[by], prepend=~key[by[:1]]) != 0
        again = np.flatnonzero(~fresh)
        if any((x[by[again]] != x[by[again - 1]]).any() for x in (self.ids, *before)):
            # keys lied: n-grams of one key are put in the order of their words
            by = np.lexsort((self.ids, *before, key))
            fresh = np.append(True, np.any([x[by[1:]] != x[by[:-1]] for x in (key, self.ids, *before)], axis=0))
        first, of = by[fresh], np.empty(len(by), np.int64)
        of[by] = np.cumsum(fresh) - 1
        shard = ((context[first] >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int32)
        return first, of, context, shard, before

    def lowered(self, order: int, answers: list[pa.Table], shards: int) -> np.ndarray:
        """log10 p of each token by the levels below order; answers: a table a level from the second on."""
        p = restored(quantised(self.base, self.grid), self.grid)
        for level in range(2, order):
            table = answers[level - 2].sort_by("shard")
            codes = np.concatenate([expand(x.as_py(), np.uint16) for x in table.column("answers")])
            code = codes[self.grams(level, shards)[1]]
            p = np.where(code < 256, restored(code, self.grid), np.where(code < NO_CONTEXT, p + restored(code - np.uint16(256), A_GRID), p))
        return p


def _split(right: pa.Table, order: int) -> tuple[pa.Table, list[pa.Table]]:
    level = right.column("level").to_numpy()
    of = lambda k: right.filter(pa.array(level == k))
    return of(1), [of(k) for k in range(2, order)]


def _asked(order: int, shards: int, n: int, v: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, right: pa.Table) -> pa.Table:
        """The distinct n-grams of a block by shard: contexts, words, training counts and lower-order codes."""
        lists, answers = _split(right, order)
        block = _Block(docs, lists, n, v)
        first, of, context, shard, before = block.grams(order, shards)
        counts = np.bincount(of[block.train[block.doc]], minlength=len(first)).astype(np.int32)
        lower = quantised(block.lowered(order, answers, shards), block.grid)[first]
        out = {k: [] for k in ("shard", "block", "heads", "sizes", "words", "counts", "lower")}
        _, runs = _bucketed(shard)
        ids = np.uint64 if block.ids.max() >> 32 else np.uint32
        for s, a, b in runs:
            own = first[a:b]
            head = np.flatnonzero(np.append(True, np.any([x[own[1:]] != x[own[:-1]] for x in before], axis=0)))
            row = (s, docs.column("block")[0].as_py(), squeeze(np.concatenate([w[first[a:b][head]] for w in before]).astype(ids)), squeeze(np.diff(np.append(head, b - a)).astype(np.int32)), squeeze(block.ids[first[a:b]].astype(ids)), squeeze(counts[a:b]), squeeze(lower[a:b]))
            for k, x in zip(out, row, strict=True):
                out[k].append(x)
        kinds = {"shard": pa.int32(), "block": pa.int64()}
        return pa.table({k: pa.array(x, kinds.get(k, pa.binary())) for k, x in out.items()})

    return run


def _wide(data: bytes, n: int) -> np.ndarray:
    import zstandard

    kind = np.uint32 if len(zstandard.decompress(data)) == 4 * n else np.uint64
    return expand(data, kind).astype(np.uint64)


def _contexts(heads: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A key for each context of blocks' (words, contexts) arrays and the key's rank; equal keys are equal words."""
    words_ = np.concatenate(heads, axis=1)
    key = _context(list(words_))
    by = np.argsort(key)
    fresh = np.diff(key[by], prepend=key[by[:1]]) != 0
    again = np.flatnonzero(~fresh)[1:]
    if (words_[:, by[again]] != words_[:, by[again - 1]]).any():
        key = np.unique(words_, axis=1, return_inverse=True)[1].reshape(-1).astype(np.uint64)
        return key, key
    rank = np.empty(len(by), np.uint64)
    rank[by] = np.cumsum(fresh)
    return key, rank


def _answered(level: int, grid: tuple[float, float]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """Builds a shard's trie level and answers every block's n-grams, in the order in which they were sent."""
        sizes = [expand(x.as_py(), np.int32) for x in table.column("sizes")]
        lens = np.fromiter((s.sum() for s in sizes), np.int64, len(sizes))
        heads = [_wide(x.as_py(), (level - 1) * len(s)).reshape(level - 1, len(s)) for x, s in zip(table.column("heads"), sizes, strict=True)]
        context, rank = (np.repeat(x, np.concatenate(sizes)) for x in _contexts(heads))
        del heads
        word = np.concatenate([_wide(x.as_py(), int(k)) for x, k in zip(table.column("words"), lens, strict=True)])
        count = np.concatenate([expand(x.as_py(), np.int32) for x in table.column("counts")]).astype(np.int64)
        lower = restored(np.concatenate([expand(x.as_py(), np.uint8) for x in table.column("lower")]), grid)
        order = np.lexsort((word, rank)) if word.max(initial=0) >> np.uint64(32) else np.argsort(rank << np.uint64(32) | word)
        del rank
        fresh = (np.diff(context[order], prepend=~context[order[:1]]) != 0) | (np.diff(word[order], prepend=~word[order[:1]]) != 0)
        group = np.cumsum(fresh) - 1
        total = np.bincount(group, weights=count[order]).astype(np.int64)
        kinds = order[np.flatnonzero(fresh)]
        trained = total > 0
        with tempfile.TemporaryDirectory() as folder:
            trie = Level(context[kinds[trained]], word[kinds[trained]], total[trained], lower[kinds[trained]], folder, grid)
            said = trie.answer(context[kinds], word[kinds])
        answers = np.empty(len(order), np.uint16)
        answers[order] = said[group]
        cuts = np.append(0, np.cumsum(lens))
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "answers": pa.array([squeeze(answers[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()), "level": pa.array([level] * len(lens), pa.int32())})

    return run


def _scored(order: int, shards: int, n: int, v: int, kind: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, right: pa.Table) -> pa.Table:
        lists, answers = _split(right, order + 1)
        block = _Block(docs, lists, n, v)
        p = block.lowered(order + 1, answers, shards)
        total = lambda x: np.bincount(block.doc, weights=x, minlength=len(block.lens))
        return pa.table({
            "id": docs.column("docs").combine_chunks().flatten().cast(kind), "held_out": pa.array(~block.train), "n_tokens": pa.array(block.lens), "n_known": pa.array(total(block.counts > 0).astype(np.int64)),
            "train_tokens": pa.array([n] * len(block.lens), pa.int64()), "base_score": pa.array(total(block.base)), "score": pa.array(total(p)),
        })

    return run


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block: int = BLOCK) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of df."""
    shards = buckets(df, text_col)
    given = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, binary = given.schema["id"].dataType, T.BinaryType()
    lists = given.mapInArrow(_lists(shards, block), "bucket int, block long, words array<binary>, counts binary")
    counted = stored(lists.groupBy("bucket").applyInArrow(_counted(shards), "block long, bucket int, ids binary, counts binary, n long, v long"))
    n, v = (x or 0 for x in counted.agg(F.sum("n"), F.sum("v")).first())
    columns = {"block": T.LongType(), "docs": T.ArrayType(kind)} | dict.fromkeys(("lens", "train", "codes", "places"), binary)
    docs = given.mapInArrow(_documents(shards, block), T.StructType([T.StructField(*c) for c in columns.items()]))
    # each part of what is known is dealt by block once: the union keeps its parts' partitions and their exchanges are used again
    known = counted.repartition("block").select("block", "bucket", "ids", "counts", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("answers"), F.lit(1).alias("level"))
    for level in range(2, order + 1):
        asked = docs.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_asked(level, shards, n, v), "shard int, block long, heads binary, sizes binary, words binary, counts binary, lower binary")
        answers = asked.groupBy("shard").applyInArrow(_answered(level, p_grid(n, v)), "block long, shard int, answers binary, level int")
        known = known.unionByName(answers.repartition("block"), allowMissingColumns=True)
    done = docs.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        _scored(order, shards, n, v, to_arrow_type(kind)),
        T.StructType([T.StructField("id", kind), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))]),
    )
    return done.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_ngram_trie: score of every document."""
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
