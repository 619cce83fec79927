"""Files: admission, manifest, software, delimiters, encodings, CSV."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions import scalars as S

DELIMITERS = (",", "\t", ";", "|")


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r".(\.[^.]*)$", 1))


def source_type(path: Column) -> Column:
    """The kind of a file that can be taken in, null for others."""
    out = F
    for ext, kind in fixed.EXTENSIONS.items():
        out = out.when(extension(path) == ext, kind)
    return out


def ignored(path: Column) -> Column:
    """Hidden files, lock files and temporary ones."""
    return name_of(path).startswith(".") | name_of(path).startswith("~$") | extension(path).isin(*fixed.IGNORED_EXTENSIONS)


def wanted(path: Column) -> Column:
    return ~ignored(path) & source_type(path).isNotNull()


def software(path: Column) -> Column:
    """(software, confidence) by the first rule that the file name meets, else by kind of file."""
    name, out = name_of(path), F
    pair = lambda s, c: F.struct(F.lit(s).alias("software"), F.lit(c).alias("confidence"))
    for pattern, s, c in fixed.SOFTWARE:
        out = out.when(name.rlike(f"(?i){pattern}"), pair(s, c))
    for kind, (s, c) in fixed.SOFTWARE_BY_TYPE.items():
        out = out.when(source_type(path) == kind, pair(s, c))
    return out


def described(found: DataFrame) -> DataFrame:
    """Adds sha256, source_type and detected to files (path, content)."""
    return found.withColumn("sha256", F.sha2("content", 256)).withColumn("source_type", source_type(F.col("path"))).withColumn("detected", software(F.col("path")))


def manifest(spark: SparkSession, folder: str, contents: bool = False) -> DataFrame:
    """Wanted files below a folder with size, time, SHA-256 and kind."""
    full = described(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(wanted(F.col("path"))))
    return full if contents else full.drop("content")


def delimiter(content: Column, sniffed: int = 8192) -> Column:
    """The delimiter of a text.

    One that stands equally often in every line of the first 8 KB, the most frequent of such; else the most
    frequent in the first line; a comma if none is there. Earlier ones win ties.
    """
    count = lambda x, d: F.length(x) - F.length(F.replace(x, d, F.lit("")))
    lines = F.filter(F.split(F.left(content, F.lit(sniffed)), "\r?\n"), lambda x: F.trim(x) != "")
    # the last line may be cut
    whole = F.when((F.length(content) > sniffed) & (F.size(lines) > 1), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    listed = F.array(*(F.struct(F.lit(d).alias("mark"), F.lit(-i).alias("place")) for i, d in enumerate(DELIMITERS)))

    def best(score) -> Column:
        """The delimiter of the highest score above 0."""
        top = F.array_max(F.transform(listed, lambda x: F.struct(score(x["mark"]).alias("n"), x["place"], x["mark"])))
        return S.let(top, lambda t: F.when(t["n"] > 0, t["mark"]))

    steady = lambda counts: F.when((F.size(counts) > 1) & (F.array_min(counts) == F.array_max(counts)), F.array_max(counts)).otherwise(0)
    even = S.let(whole, lambda found: best(lambda d: S.let(F.transform(found, lambda x: count(x, d)), steady)))
    return F.coalesce(even, S.let(F.substring_index(content, "\n", 1), lambda first: best(lambda d: count(first, d))), F.lit(","))


def encoding(content: Column) -> Column:
    """UTF-8 if the bytes are valid, else windows-1252, or ISO-8859-1 where bytes have no place in that."""
    undefined = F.hex(content).rlike("^(..)*?(81|8D|8F|90|9D)")
    return F.when(F.is_valid_utf8(content.cast("string")), "UTF-8").when(undefined, "ISO-8859-1").otherwise("windows-1252")


def header(content: Column, charset: Column) -> Column:
    """The first line of a CSV file."""
    text = F.when(charset == "UTF-8", content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(F.substring_index(text, "\n", 1), "^\ufeff|\r$", "")


def csv_groups(files: DataFrame) -> list[tuple[str, str, list[str]]]:
    """(encoding, delimiter, paths) of the CSV files of a manifest with contents: files of one encoding, delimiter and header are read together.

    Paths come to the driver, as Spark's file listing has them there too; contents don't.
    """
    told = files.where("source_type = 'csv'").select("path", encoding(F.col("content")).alias("encoding"), delimiter(F.col("content").cast("string")).alias("delimiter"), "content")
    rows = told.groupBy("encoding", "delimiter", header(F.col("content"), F.col("encoding")).alias("header")).agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    return [(r["encoding"], r["delimiter"], r["paths"]) for r in rows]


CORRUPT = "_corrupt_record"
#: The characters of windows-1252 that ISO-8859-1 has as controls, and these controls.
CURLY = "".join(c for c in bytes(range(0x80, 0xA0)).decode("cp1252", "ignore"))
CONTROLS = "".join(map(chr, CURLY.encode("cp1252")))


def read_csv(spark: SparkSession, paths: Sequence[str], charset: str = "UTF-8", separator: str = ",", audit: bool = False, name: Callable[[str], str] = str) -> DataFrame:
    """CSV files of one header as strings, with source_file and source_row_number; extra cells of ragged rows are dropped.

    Row numbers follow the place in the file: files are read whole, one task each, so that quoted
    line breaks are kept together. With audit, rows with more or fewer cells than the header come whole in _corrupt_record.
    name: what becomes of a header.
    """
    # the CSV source has no windows-1252, which differs from ISO-8859-1 by some characters only
    curly = charset == "windows-1252"
    plain = str.maketrans(CONTROLS, CURLY) if curly else {}
    reader = spark.read.option("header", True).option("sep", separator).option("encoding", "ISO-8859-1" if curly else charset).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
    names = reader.csv(list(paths)[:1]).columns
    types = [T.StructField(name(c.lstrip("\ufeff").translate(plain)), T.StringType()) for c in names]
    if audit:
        types.append(T.StructField(CORRUPT, T.StringType()))
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    df = reader.schema(T.StructType(types)).csv(list(paths)).withColumn("source_file", F.col("_metadata.file_path"))
    if curly:
        df = df.withColumns({t.name: F.translate(F.col(f"`{t.name}`"), CONTROLS, CURLY) for t in types})
    placed = df.withColumn("__at", F.monotonically_increasing_id())
    w = Window.partitionBy("source_file").orderBy("__at")
    return placed.withColumn("source_row_number", F.row_number().over(w)).drop("__at")


def read_folder(spark: SparkSession, folder: str) -> list[DataFrame]:
    """One frame of strings for each encoding, delimiter and header found below a folder."""
    return [read_csv(spark, paths, e, d) for e, d, paths in csv_groups(manifest(spark, folder, contents=True))]


def first_value(columns: Sequence[str]) -> Column:
    """The first cell of a row that isn't blank, trimmed and in lower case."""
    return F.coalesce(*(F.when(F.trim(F.col(f"`{c}`")) != "", F.lower(F.trim(F.col(f"`{c}`")))) for c in columns))


def strip_summary(df: DataFrame, columns: Sequence[str], file: str = "source_file", number: str = "source_row_number", most: int = 5) -> DataFrame:
    """Rows without the summary rows at the foot of each file, at most five of them.

    Only the last rows of each file meet in a task; all others meet a bound of their file.
    """
    foot = df.select(file, number, F.coalesce(first_value(columns).isin(*fixed.SUMMARY_WORDS), F.lit(False)).alias("__summary"))
    from_end = Window.partitionBy(file).orderBy(F.desc(number))
    last = foot.withColumn("__nth", F.row_number().over(from_end)).where(F.col("__nth") <= most)
    marked = last.withColumn("__row", F.max(~F.col("__summary")).over(from_end.rowsBetween(Window.unboundedPreceding, 0)))
    bounds = marked.where("NOT __row").groupBy(F.col(file).alias("__file")).agg(F.min(number).alias("__bound"))
    met = df.join(bounds, F.col(file).eqNullSafe(F.col("__file")), "left")
    return met.where(F.col("__bound").isNull() | (F.col(number) < F.col("__bound"))).drop("__file", "__bound")


def unioned(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
