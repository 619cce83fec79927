"""CSV files cut at any line break: one large file is many tasks, quoted line breaks included.

The text source deals a file out by byte ranges and gives its lines in order. Whether a line break ends a record depends on
all quotes before it, but only through one bit: whether a quoted cell is open. For each line and each value of that bit, the
bit after the line and the records that start in it are known from the line alone, so a first pass folds each byte
range to one small row, a prefix over these rows tells each range its bit and its first record number, and a second pass
cuts the lines into records. What a record has in several ranges is put together by its number. Records become cells
by the built-in CSV parser, and row numbers are places in the file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import CORRUPT

#: Folds of ranges that come to the driver, as Spark's own list of ranges does.
RANGES = 1_000_000
RANGE = "file string, start long, open0 boolean, starts0 long, open1 boolean, starts1 long"
RECORDS = "file string, number long, start long, part boolean, record string"


def closers(separator: str) -> tuple[re.Pattern, re.Pattern]:
    """Patterns of lines that end a record, if no quoted cell is open at their start, and if one is.

    A cell that begins with a quote ends at the next quote that isn't doubled, and may have more text up to
    the separator; quotes elsewhere are text. Possessive throughout, so that a line is read once.
    """
    d = re.escape(separator)
    rest = rf'"(?:[^"]*+"")*+[^"]*+"[^{d}]*+'
    cell = rf'(?:{rest}|(?!")[^{d}]*+)'
    more = rf"(?:{d}{cell})*+\Z"
    return re.compile(cell + more, re.DOTALL), re.compile(rest[1:] + more, re.DOTALL)


def _opens(line: str, open_: bool, patterns: tuple[re.Pattern, re.Pattern]) -> bool:
    """Whether a quoted cell is open after a line."""
    if '"' not in line:
        return open_
    return patterns[open_].match(line) is None


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        for file, start, line in zip(*(batch.column(n).to_pylist() for n in ("file", "start", "value")), strict=True):
            yield file, start, line.removesuffix("\r")


def _folded(separator: str) -> Callable:
    """One row for each range: for each value of the bit before it, the bit after it and how many records start in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, place, bits, starts = closers(separator), None, [False, True], [0, 0]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(dict(zip(("file", "start", "open0", "starts0", "open1", "starts1"), ([x] for x in (*place, bits[0], starts[0], bits[1], starts[1])), strict=True)))

        for file, start, line in _lines(batches):
            if place != (file, start):
                if place:
                    yield row()
                place, bits, starts = (file, start), [False, True], [0, 0]
            for i in (0, 1):
                # blank lines between records are none
                starts[i] += not bits[i] and line != ""
                bits[i] = _opens(line, bits[i], patterns)
        if place:
            yield row()

    return run


def placed(folds: list[tuple]) -> dict[tuple[str, int], tuple[bool, int]]:
    """For each range (file, start) its bit and the number of records that start before it."""
    out: dict[tuple[str, int], tuple[bool, int]] = {}
    last, open_, number = None, False, 0
    for file, start, open0, starts0, open1, starts1 in sorted(folds):
        if file != last:
            last, open_, number = file, False, 0
        out[file, start] = (open_, number)
        number += starts1 if open_ else starts0
        open_ = open1 if open_ else open0
    return out


def _cut(separator: str, told) -> Callable:
    """Records with their number in the file, from 0; part: those that go on in another range, or come from one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, known = closers(separator), told.value
        place, held, rows = None, [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)], names=["file", "number", "start", "part", "record"])

        for file, start, line in _lines(batches):
            if place != (file, start):
                if held:
                    rows.append((*place[:1], number - 1, place[1], True, "\n".join(held)))
                place, held = (file, start), []
                open_, number = known[file, start]
                part = open_
            if not open_:
                if line == "":
                    continue
                number += 1
            held.append(line)
            open_ = _opens(line, open_, patterns)
            if not open_:
                rows.append((file, number - 1, start, part, "\n".join(held)))
                held, part = [], False
                if len(rows) >= 2000:
                    yield batch()
                    rows = []
        if held:
            rows.append((place[0], number - 1, place[1], True, "\n".join(held)))
        if rows:
            yield batch()

    return run


def records(spark: SparkSession, paths: Sequence[str], separator: str = ",") -> DataFrame:
    """(file, number, record): the records of CSV files in UTF-8 as texts, numbered from 0 in each file.

    Line breaks in cells are \\n; a cell that is never closed ends with its file, without the last line break.
    """
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    folds = [tuple(r) for r in lines.mapInArrow(_folded(separator), RANGE).limit(RANGES + 1).collect()]
    if len(folds) > RANGES:
        raise ValueError("too many byte ranges at once; read fewer files or raise spark.sql.files.maxPartitionBytes")
    cut = lines.mapInArrow(_cut(separator, spark.sparkContext.broadcast(placed(folds))), RECORDS)
    whole = cut.where("NOT part").select("file", "number", "record")
    pieces = F.array_sort(F.collect_list(F.struct("start", "record")))
    split = cut.where("part").groupBy("file", "number").agg(F.array_join(F.transform(pieces, lambda x: x["record"]), "\n").alias("record"))
    return whole.unionByName(split).withColumn("record", F.when(F.col("number") == 0, F.ltrim(F.col("record"), F.lit("﻿"))).otherwise(F.col("record")))


def read_csv(spark: SparkSession, paths: Sequence[str], separator: str = ",", audit: bool = False, name: Callable[[str], str] = str) -> DataFrame:
    """files.read_csv() for files of any size in UTF-8: strings by the header of the first file, source_file and source_row_number from 1.

    With audit, rows with more or fewer cells than the header come whole in _corrupt_record. name: what becomes of a header.
    """
    options = {"sep": separator, "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    names = [name(c.lstrip("﻿")) for c in spark.read.options(header=True, **options).csv(list(paths)[:1]).columns]
    # places for names, as a header may have any character
    kinds = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField(CORRUPT, T.StringType())]
    ddl = ", ".join(f"{k.name} STRING" for k in kinds)
    cells = F.from_csv("record", F.lit(ddl), options | {"columnNameOfCorruptRecord": CORRUPT})
    rows = records(spark, paths, separator).where("number > 0").select(cells.alias("cells"), F.col("file").alias("source_file"), F.col("number").cast("int").alias("source_row_number"))
    out = [F.col(f"cells.c{i}").alias(n) for i, n in enumerate(names)] + ([F.col(f"cells.{CORRUPT}").alias(CORRUPT)] if audit else [])
    return rows.select(*out, "source_file", "source_row_number")
