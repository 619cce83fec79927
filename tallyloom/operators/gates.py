"""Gates before raw rows are stored: limits, reserved names, formulas, long cells."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S


def admitted(files: DataFrame, rows: DataFrame | None = None, max_bytes: int = fixed.MAX_FILE_BYTES, max_rows: int | None = fixed.MAX_ROWS) -> DataFrame:
    """Adds blocked_by to a manifest (path, length, ...): size, rows or null; rows: (path) one row a record."""
    out = files
    if rows is not None:
        out = out.join(rows.groupBy("path").agg(F.count("*").alias("n_rows")), "path", "left")
    else:
        out = out.withColumn("n_rows", F.lit(None).cast("long"))
    many = F.lit(False) if max_rows is None else F.coalesce(F.col("n_rows") > max_rows, F.lit(False))
    return out.withColumn("blocked_by", F.when(F.col("length") > max_bytes, "size").when(many, "rows"))


CHANGES = "array<struct<rule: string, column: string>>"


def safe_name(name: str) -> str:
    """A header in Unicode NFC, with raw_ in front of the engine's own names."""
    nfc = unicodedata.normalize("NFC", name)
    return f"raw_{nfc}" if nfc.strip().lower() in fixed.RESERVED_NAMES else nfc


def safe_names(df: DataFrame) -> DataFrame:
    """Headers by safe_name()."""
    return df.withColumnsRenamed({c: safe_name(c) for c in df.columns})


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]


def sanitised(df: DataFrame, most: int = fixed.MAX_CELL) -> DataFrame:
    """Formulas marked, then cells cut to `most` characters."""
    return df.withColumns({c: F.left(S.neutralised(F.col(f"`{c}`")), F.lit(most)) for c in _texts(df)})


def changes(df: DataFrame, columns: Sequence[str], most: int = fixed.MAX_CELL) -> Column:
    """An array of (rule, column) for the cells of a row that sanitised() changes."""

    def hit(c: str, rule: str, on: Column) -> Column:
        return F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column")))

    found = [h for c in columns for h in (hit(c, "formula", S.neutralised(F.col(f"`{c}`")) != F.col(f"`{c}`")), hit(c, "length", F.length(F.col(f"`{c}`")) > most))]
    return F.array_compact(F.array(*found)) if found else F.array().cast(CHANGES)


def warnings(df: DataFrame, key: str, most: int = fixed.MAX_CELL) -> DataFrame:
    """(key, rule, column) for each cell that sanitised() changes."""
    return df.select(F.col(key), F.inline(changes(df, [c for c in _texts(df) if c != key], most)))


def mended(df: DataFrame, keys: Sequence[str], most: int = fixed.MAX_CELL, told: str = "gate_warnings") -> DataFrame:
    """Rows with all text cells but the keys in Unicode NFC, formulas marked and cells cut to `most` characters; told: an array of what changed."""
    texts = [c for c in _texts(df) if c not in keys]
    plain = df.withColumns({c: nfc_column(F.col(f"`{c}`")) for c in texts})
    return plain.withColumns({told: changes(plain, texts, most)} | {c: F.left(S.neutralised(F.col(f"`{c}`")), F.lit(most)) for c in texts})


def nfc_column(c: Column) -> Column:
    """A text column in Unicode NFC; there is no built-in, so batches go through Python."""

    @F.pandas_udf("string")
    def nfc(s):
        return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    return nfc(c)


def chain(files: DataFrame, rows: DataFrame, key: str, max_bytes: int = fixed.MAX_FILE_BYTES, max_rows: int | None = fixed.MAX_ROWS, most: int = fixed.MAX_CELL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All gates on the rows (path, key, ...) of the files (path, length) of a manifest: (clean rows, warnings, verdicts).

    Sizes and row counts block a file with all its rows; names, Unicode form, formulas and long cells of the others are
    mended, and each cell that was changed has a warning (key, rule, column).
    """
    verdicts = admitted(files, rows.select("path"), max_bytes, max_rows)
    passed = safe_names(rows.join(verdicts.where("blocked_by is null").select("path"), "path", "left_semi"))
    clean = mended(passed, ("path", key), most)
    return clean.drop("gate_warnings"), clean.select(key, F.inline("gate_warnings")), verdicts
