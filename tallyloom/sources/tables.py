"""Database tables through JDBC, read-only."""

from __future__ import annotations

import re
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

READ_ONLY = re.compile(r"^\s*(select|with)\b", re.IGNORECASE)
WRITES = re.compile(r"\b(insert|update|delete|drop|alter|create|truncate|merge|grant|replace)\b", re.IGNORECASE)


def checked(sql: str) -> str:
    """sql if it only reads; the JDBC source also wraps it as a sub-select."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", sql)
    if not READ_ONLY.match(bare) or WRITES.search(bare) or ";" in bare.rstrip().rstrip(";"):
        raise ValueError("only one SELECT or WITH query is allowed")
    return sql.rstrip().rstrip(";")


def read_table(spark: SparkSession, url: str, table: str, limit: int | None = None, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table, in ranges of a numeric column (name, low, high, parts) on request; the limit is pushed down."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        name, low, high, parts = partition
        reader = reader.option("partitionColumn", name).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    df = reader.load()
    return df if limit is None else df.limit(limit)


NAME = re.compile(r'(?:[A-Za-z_]\w*|"[^"]+")(?:\.(?:[A-Za-z_]\w*|"[^"]+"))*')


def literal(value) -> str:
    """A value as SQL text that databases agree on."""
    if isinstance(value, bool) or value is None:
        raise ValueError("ranges are of numbers, dates or texts")
    if isinstance(value, int | float | Decimal):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def probe(table: str, column: str, parts: int) -> str:
    """A query for the least value of each of `parts` equal shares of a table's rows, by the order of a column."""
    if not NAME.fullmatch(table) or not NAME.fullmatch(column):
        raise ValueError("table and column are plain or quoted names")
    return f"select min(v) as low, count(*) as n from (select {column} as v, ntile({int(parts)}) over (order by {column}) as b from {table} where {column} is not null) t group by b"


def predicates(column: str, lows: Sequence) -> list[str]:
    """Conditions that hold for one share each and together for every row once, nulls with the first; equal bounds are one."""
    cuts = [literal(v) for v in sorted(set(lows))][1:]
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *inner, f"{column} >= {cuts[-1]}"]


def read_shares(spark: SparkSession, url: str, table: str, column: str, parts: int = 16, **options: str) -> DataFrame:
    """A table in shares of about as many rows each, however its values lie: a probing query finds the bounds of a number, date or text column."""
    lows = [r["low"] for r in read_query(spark, url, probe(table, column, parts), **options).collect()]
    return spark.read.jdbc(url, table, predicates=predicates(column, lows), properties=options)


def require_driver(spark: SparkSession, url: str) -> None:
    """Ends with a plain word where no JDBC driver takes the address."""
    try:
        spark._jvm.java.sql.DriverManager.getDriver(url)
    except Exception as e:
        raise RuntimeError(f"no JDBC driver for {url.split('//')[0]}; add its jar to spark.jars") from e


def read_query(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("query", checked(sql)).options(**options).load()


def list_tables(spark: SparkSession, url: str, **options: str) -> DataFrame:
    return read_query(spark, url, "select table_name from information_schema.tables where table_schema not in ('information_schema', 'pg_catalog')", **options)


def columns(df: DataFrame) -> list[tuple[str, str, bool]]:
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
