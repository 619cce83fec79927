"""Operator 3: quality rules with compression bands.

Every text is compressed whole and in fixed chunks; what is left after the last full chunk is judged in a
chunk that ends with the text and overlaps the one before, and a text shorter than a chunk by its whole
ratio alone. Text that repeats itself compresses too well, noise compresses too badly; the limits depend
on the length, as short texts compress less. The
rule reads one document at a time, so it is a projection of the scan without a shuffle; a batch
of documents is handled at once where counts need sorting.

Defined results: a null text has no words and fails the base rule; an empty table gives an empty
result; repeated rows and ids are judged row by row; `rate` keeps only the id column, `keep` all
columns of its input whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import WHITE, mix64

#: (bytes from, least and most ratio of compressed to plain bytes). Under 128 bytes the frame of
#: the format itself weighs most, so the band is wide.
WHOLE = (
    (1, 0.50, 1.40),
    (128, 0.45, 1.10),
    (256, 0.50, 0.88),
    (512, 0.47, 0.80),
    (1024, 0.43, 0.70),
    (2048, 0.42, 0.64),
    (4096, 0.40, 0.60),
    (8192, 0.375, 0.60),
    (32768, 0.33, 0.60),
)
#: Bytes of a fixed chunk, its band, and the share of chunks that may lie outside it.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 2048, (0.44, 0.66), 0.25
LEVEL = 3
MIN_WORDS, MAX_REPEATED = 20, 30
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, whole_ratio double, n_chunks long, n_chunks_out long"


def repeated_words(docs: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """For each list of words, how many lie in a window of words that the list holds twice or more.

    All windows of all lists are hashed and sorted together; windows of one hash are compared
    word by word with the first of them, and if any differs the windows are ranked exactly.
    """
    lens = np.fromiter(map(len, docs), np.int64, len(docs))
    total = int(lens.sum())
    out = np.zeros(len(docs), np.int64)
    if total < window:
        return out
    codes, _ = pd.factorize(np.array([w for d in docs for w in d], dtype=object))
    doc = np.repeat(np.arange(len(docs)), lens)
    starts = np.flatnonzero(doc[: total - window + 1] == doc[window - 1 :])
    if not len(starts):
        return out
    key = mix64(doc[starts].astype(np.uint64) + np.uint64(1))
    for j in range(window):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + codes[starts + j].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
    group = np.cumsum(np.diff(key[order], prepend=~key[order[:1]]) != 0) - 1
    head = starts[order[first[group]]]
    many = np.bincount(group)[group] > 1
    a, b = starts[order[many]], head[many]
    if (doc[a] != doc[b]).any() or any((codes[a + j] != codes[b + j]).any() for j in range(window)):
        rows = np.column_stack([doc[starts], *(codes[starts + j] for j in range(window))])
        _, group, sizes = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        a = starts[sizes[group.reshape(-1)] > 1]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, a + window, -1)
    covered = np.cumsum(edge)[:total] > 0
    return np.bincount(doc[covered], minlength=len(docs))


def _measures(texts: pd.Series) -> pd.DataFrame:
    """Counts of texts, some megabytes of them at a time."""
    lot = (texts.str.len().fillna(0).cumsum() // (4 << 20)).to_numpy()
    return pd.concat([_lot(t) for _, t in texts.groupby(lot, sort=False)] or [_lot(texts)], ignore_index=True)


def _lot(texts: pd.Series) -> pd.DataFrame:
    press = zstandard.ZstdCompressor(level=LEVEL)
    rows, docs = [], []
    for text in texts:
        text = text if isinstance(text, str) else ""
        data = text.encode()
        found = data.split()
        lines = [x for x in text.split("\n") if x.strip(WHITE)]
        chunks = [data[i : i + CHUNK] for i in range(0, len(data) - CHUNK + 1, CHUNK)]
        if chunks and len(data) % CHUNK:
            chunks.append(data[-CHUNK:])
        ratios = [len(press.compress(c)) / CHUNK for c in chunks]
        rows.append((
            len(found),
            len(text) - sum(map(text.count, WHITE)),
            len(data) - len(data.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)),
            0,
            len(data),
            len(press.compress(data)) / len(data) if data else 0.0,
            len(chunks),
            sum(not CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in ratios),
        ))
        docs.append(found)
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in COUNTS.split(", ")])
    out["n_repeat_words"] = repeated_words(docs)
    return out


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (id, text) with the counts in place of the text."""
    for batch in batches:
        yield pd.concat([batch.drop(columns="text").reset_index(drop=True), _measures(batch["text"])], axis=1)


def verdict(df: DataFrame) -> DataFrame:
    """Adds base_failed and kept to a frame with the counts."""
    inside = F.lit(True)
    for i, (least, low, high) in enumerate(WHOLE):
        most = WHOLE[i + 1][0] if i + 1 < len(WHOLE) else 1 << 62
        inside = F.when(F.col("n_bytes").between(least, most - 1), F.col("whole_ratio").between(low, high)).otherwise(inside)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    steady = F.col("n_chunks_out") <= CHUNK_SHARE * F.col("n_chunks")
    return df.withColumn("base_failed", base).withColumn("kept", ~base & inside & steady)


def rate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, counts, base_failed, kept) for each row of df."""
    kind = df.schema[id_col].dataType.simpleString()
    given = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return verdict(given.mapInPandas(_measured, f"id {kind}, {COUNTS}")).withColumnRenamed("id", id_col)


def keep(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df whose text passes, with the columns of df."""
    measures = F.pandas_udf(_measures, COUNTS)
    judged = verdict(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), measures(F.col(text_col)).alias("m")).select("row", "m.*"))
    return judged.where("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_quality_rules: counts and verdict for every document."""
    return rate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
