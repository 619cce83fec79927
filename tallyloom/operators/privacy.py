"""Personal data in tables, and what may leave them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions import scalars as S
from .medallion import settled


class BoundaryError(ValueError):
    """Columns that may not leave; `blocked` lists them."""

    def __init__(self, blocked: list[str]):
        super().__init__(f"columns that may not leave: {', '.join(blocked)}")
        self.blocked = blocked


def scan(df: DataFrame, fields: Sequence[str] = fixed.PII_FIELDS) -> DataFrame:
    """Adds pii, the array of matches of a row; settled, as masks and summaries refer to it many times."""
    return settled(df.drop("pii"), pii=S.pii_matches({f: F.col(f) for f in fields if f in df.columns}))


def mask_rows(df: DataFrame, fields: Sequence[str] = fixed.PII_FIELDS, mode: str = "places") -> DataFrame:
    """The fields of a scanned frame with tokens in place of their matches; mode as of scalars.mask_tokens()."""
    return df.withColumns({f: S.mask_tokens(F.col(f), F.col("pii"), f, mode) for f in fields if f in df.columns})


def report(df: DataFrame, fields: Sequence[str] = fixed.PII_FIELDS) -> DataFrame:
    """Rows, rows with personal data, their percentage, sorted types and flagged columns."""
    flat = lambda part: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(part)))), ",")
    seen = scan(df, fields).select(F.size("pii").alias("n"), F.array_distinct(F.transform("pii", lambda m: m["type"])).alias("t"), F.array_distinct(F.transform("pii", lambda m: m["field"])).alias("f"))
    return seen.agg(
        F.count("*").alias("rows_scanned"), F.count_if(F.col("n") > 0).alias("rows_with_pii"), F.coalesce(F.round(100.0 * F.count_if(F.col("n") > 0) / F.count("*"), 1), F.lit(0.0)).alias("pii_percentage"),
        flat(F.col("t")).alias("pii_types_detected"), flat(F.col("f")).alias("flagged_columns"),
    )


def verdict(names: Iterable[str], local: Iterable[str] = fixed.LOCAL_ONLY, safe: Iterable[str] = fixed.CLOUD_SAFE) -> dict[str, list[str]]:
    """Names split into blocked, allowed and unknown."""
    local, safe = set(local), set(safe)
    out: dict[str, list[str]] = {"blocked": [], "allowed": [], "unknown": []}
    for n in names:
        out["blocked" if n.lower() in local else "allowed" if n.lower() in safe else "unknown"].append(n)
    return out


def blocked_paths(schema: T.StructType, local: Iterable[str] = fixed.LOCAL_ONLY) -> list[str]:
    """Dotted names of all columns and fields, at every depth of structs, arrays and maps, that may not leave.

    What stands within a blocked one is not named again. Keys of maps are data and have no name here.
    """
    local, found = set(local), []

    def walk(kind: T.DataType, at: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                name = f"{at}.{f.name}" if at else f.name
                if f.name.lower() in local:
                    found.append(name)
                else:
                    walk(f.dataType, name)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, at)
        elif isinstance(kind, T.MapType):
            walk(kind.keyType, at)
            walk(kind.valueType, at)

    walk(schema, "")
    return found


def for_cloud(df: DataFrame, strict: bool = False, unknown: str = "drop") -> DataFrame:
    """Columns that may leave, at every depth of structs, arrays and maps; unknown: drop or keep.

    strict raises if a column or field of any depth is blocked. The entries of a map are judged by their keys, which
    only its rows tell: they are dropped, and strict does not raise for them. What has no part left that may leave is dropped.
    """
    if strict and (blocked := blocked_paths(df.schema)):
        raise BoundaryError(blocked)

    def may(name: str) -> bool:
        state = verdict([name])
        return not state["blocked"] and (bool(state["allowed"]) or unknown == "keep")

    def within(c: Column, kind: T.DataType) -> Column | None:
        if isinstance(kind, T.StructType):
            inner = [(f.name, within(c[f.name], f.dataType)) for f in kind.fields if may(f.name)]
            kept = [x.alias(n) for n, x in inner if x is not None]
            return F.when(c.isNotNull(), F.struct(*kept)) if kept else None
        if isinstance(kind, T.ArrayType):
            return None if within(F.lit(None), kind.elementType) is None else F.transform(c, lambda x: within(x, kind.elementType))
        if isinstance(kind, T.MapType):
            if within(F.lit(None), kind.valueType) is None:
                return None
            key = lambda k: F.lower(k.cast("string"))
            fine = lambda k: ~key(k).isin(*fixed.LOCAL_ONLY) & (key(k).isin(*fixed.CLOUD_SAFE) if unknown == "drop" else F.lit(True))
            return F.transform_values(F.map_filter(c, lambda k, v: fine(k)), lambda k, v: within(v, kind.valueType))
        return c

    chosen = [(f.name, within(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema.fields if may(f.name)]
    return df.select(*(c.alias(n) for n, c in chosen if c is not None))
