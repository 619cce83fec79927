"""Operator 1: SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary holds a white-space marker after another character, so a merge never
crosses the start of a marker run, nor a line break when no piece holds one. A text is cut there;
each distinct chunk of the corpus is segmented once, by the library, in the task that its hash
names, and its ids go back to the blocks of documents that use it, where they are joined by
position.

Data flow: scan -> (block, bucket, distinct chunks) -> by bucket: segment -> (block, ids of its
chunks) -> by block, together with the documents as codes into the block's chunk list: ids and
decoded texts. What is shuffled is the distinct chunks of each block and the codes, never a row
for each word. The scan runs twice, so the input must be read in the same order twice: a table
or a checkpoint. A block whose second pass differs is an error, never a wrong result.

Defined results: a null text is an empty text, with no ids and an empty decoded text; null ids,
repeated rows and repeated ids each keep their own row; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .frames import blocks, buckets, trimmed, trimmed_both
from .text import expand, ragged, runs, squeeze

MARK = "▁"
#: Bytes of text in a block: the documents that share one chunk list.
BLOCK = 32 << 20
#: Chunks that are decoded, or joined to result rows, at once.
SLICE = 200_000


@cache
def _processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


@cache
def _cutter(model: str) -> re.Pattern:
    """What cuts a text, with spaces for markers and a leading one, into chunks that no piece crosses."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(model, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("the model must keep texts as they are and add a leading marker")
    pieces = [p.piece for p in proto.pieces if p.type in (1, 4)]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError("a piece crosses a white-space marker, so chunks can't be segmented apart")
    lines = not any("\n" in p for p in pieces) and proto.trainer_spec.byte_fallback
    return re.compile(" *[^ \n]+| +|\n" if lines else " *[^ ]+| +")


def _cut(cutter: re.Pattern, text: str | None) -> list[str]:
    return cutter.findall(" " + text.replace(MARK, " ")) if text else []


def segment(model: str, chunks: list[str]) -> list[list[int]]:
    """The ids of each chunk as it stands within a text."""
    sp = _processor(model)
    mark = sp.piece_to_id(MARK)
    given = [c[1:] if c[0] == " " else "\n" + c for c in chunks]
    return [[mark] if c == " " else ids if c[0] == " " else ids[2:] for c, ids in zip(chunks, sp.encode(given, num_threads=1), strict=True)]


def _bucket(chunk: str, buckets: int) -> int:
    return zlib.crc32(chunk.encode()) % buckets


def _block(cutter: re.Pattern, texts: pa.ChunkedArray, buckets: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct chunks of a block in the order of their buckets, their buckets, the place of each code
    in that order, the codes of all texts end to end and their numbers; frequent chunks have low codes."""
    seen: defaultdict[str, int] = defaultdict()
    seen.default_factory = seen.__len__
    codes = [np.fromiter(map(seen.__getitem__, _cut(cutter, t.as_py())), np.uint32) for t in texts]
    names = list(seen)
    of = np.fromiter((_bucket(c, buckets) for c in names), np.int32, len(names))
    order = np.argsort(of, kind="stable")
    place = np.empty(len(names), np.uint32)
    place[order] = np.arange(len(names), dtype=np.uint32)
    flat = np.concatenate(codes)
    by = np.argsort(-np.bincount(flat, minlength=len(names)), kind="stable")
    rank = np.empty(len(names), np.uint32)
    rank[by] = np.arange(len(names), dtype=np.uint32)
    return [names[i] for i in order], of[order], place[by], rank[flat], np.fromiter(map(len, codes), np.int32, len(codes))


def _lists(model: str, text: str, buckets: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cutter(model)
        for key, table in blocks(batches, text, most):
            names, of, _, _, _ = _block(cutter, table.column(text), buckets)
            for lo, hi in runs(of):
                data = [c.encode() for c in names[lo:hi]]
                yield pa.record_batch({"bucket": pa.array([of[lo]], pa.int32()), "block": pa.array([key], pa.int64()), "sizes": pa.array([squeeze(np.fromiter(map(len, data), np.int32, len(data)))], pa.binary()), "chunks": pa.array([zstandard.compress(b"".join(data), 3)], pa.binary())})

    return run


def _codes(model: str, id_col: str, text: str, buckets: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block as one row: ids, numbers of chunks, codes, and the chunks' places in the block's lists."""
        cutter = _cutter(model)
        for key, table in blocks(batches, text, most):
            _, _, place, codes, lens = _block(cutter, table.column(text), buckets)
            ids = table.column(id_col).combine_chunks()
            columns = [squeeze(c) for c in (lens, codes, place)]
            yield pa.record_batch([pa.array([key], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([c], pa.binary()) for c in columns)], names=["block", "ids", "lens", "codes", "places"])

    return run


def _segmented(model: str) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        sizes = [expand(x.as_py(), np.int32) for x in table.column("sizes")]
        ends = np.append(0, np.cumsum(np.concatenate(sizes))).astype(np.int64)
        data = b"".join(zstandard.decompress(x.as_py()) for x in table.column("chunks"))
        given = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data))
        coded = given.dictionary_encode()
        ids = segment(model, coded.dictionary.to_pylist())
        lens = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for one in ids for i in one), np.int32, int(lens.sum()))
        starts, at = np.cumsum(lens) - lens, coded.indices.to_numpy()
        bounds = np.append(0, np.cumsum([len(x) for x in sizes]))
        rows = [(lens[at[lo:hi]], flat[ragged(starts[at[lo:hi]], lens[at[lo:hi]])]) for lo, hi in zip(bounds, bounds[1:], strict=False)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "lens": pa.array([r[0].tobytes() for r in rows], pa.binary()), "ids": pa.array([r[1].tobytes() for r in rows], pa.binary())})

    return run


def _joined(model: str, id_type: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    kinds = pa.schema([("id", id_type), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(docs: pa.Table, lists: pa.Table) -> pa.Table:
        sp = _processor(model)
        mark = sp.piece_to_id(MARK)
        lists = lists.sort_by("bucket")
        lens = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x.as_py(), np.int32) for x in lists.column("lens"))])
        flat = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x.as_py(), np.int32) for x in lists.column("ids"))])
        ends = np.cumsum(lens)
        starts, said = ends - lens, []
        for at in range(0, len(lens), SLICE):
            pairs = zip(starts[at : at + SLICE].tolist(), ends[at : at + SLICE].tolist(), strict=True)
            said += sp.decode([[mark, *flat[lo:hi].tolist()] for lo, hi in pairs])
        batches = []
        for r in range(docs.num_rows):
            ids, sizes, codes, places = (docs.column(c)[r] for c in ("ids", "lens", "codes", "places"))
            places = expand(places.as_py(), np.uint32)
            if len(places) != len(lens):
                raise RuntimeError("the input changed between its two readings; store it first")
            codes, sizes = places[expand(codes.as_py(), np.uint32)], expand(sizes.as_py(), np.int32)
            cuts = np.append(0, np.cumsum(sizes))
            a = 0
            while a < len(sizes):
                b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + SLICE, side="right")) - 1)
                own = codes[cuts[a] : cuts[b]]
                tokens = np.append(0, np.cumsum(lens[own]))[cuts[a : b + 1] - cuts[a]]
                texts = ["".join(map(said.__getitem__, codes[cuts[i] : cuts[i + 1]].tolist()))[1:] for i in range(a, b)]
                columns = [ids.values.slice(a, b - a), pa.ListArray.from_arrays(pa.array(tokens, pa.int32()), pa.array(flat[ragged(starts[own], lens[own])], pa.int32())), pa.array(texts, pa.string())]
                batches.append(pa.RecordBatch.from_arrays(columns, schema=kinds))
                a = b
        return pa.Table.from_batches(batches, schema=kinds)

    return run


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id_col, ids array<int>, decoded string) for each row of df.

    ids are those of the library's encode() of the whole text, without begin or end ids; decoded
    is its decode() of them. model is the path of a model file on every machine. No result depends on block.
    """
    many = buckets(df, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    _cutter(model)
    given = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lists = given.select("text").mapInArrow(_lists(model, "text", many, block), "bucket int, block long, sizes binary, chunks binary")
    tables = lists.groupBy("bucket").applyInArrow(trimmed(_segmented(model)), "block long, bucket int, lens binary, ids binary")
    codes = given.mapInArrow(_codes(model, "id", "text", many, block), f"block long, ids array<{kind}>, lens binary, codes binary, places binary")
    run = _joined(model, to_arrow_type(df.schema[id_col].dataType))
    return codes.groupBy("block").cogroup(tables.groupBy("block")).applyInArrow(trimmed_both(run), f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_sentencepiece: digests of the ids and decoded text of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = encode(docs, default_model())
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
