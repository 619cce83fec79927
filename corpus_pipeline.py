"""A corpus pipeline of five operators: quality rules, near-dedup, exact dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import cube_mixing, paragraph_minhash, quality_bands, sentencepiece_codec, simhash_anchors, suffix_dedup
from tallyloom.llm.frames import Tables


#: Bytes of text in a block of the two stages that hash or code whole blocks: less than the operators' own, as workers of other stages still hold memory.
DEDUP_BLOCK, CODING_BLOCK = (2 << 20) - 1, 8 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules (operator 3)."""
    return quality_bands.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no two have a five-word Jaccard similarity of 0.8, one of each group of SimHash near-duplicates (operator 6).

    Such pairs differ in some 10 of 64 bits, beyond operator 6's 4, so they are found by MinHash bands and verified first.
    """
    return simhash_anchors.representatives(paragraph_minhash.different(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier (operator 4); n_chars follows the text."""
    return suffix_dedup.without_repeats(docs, block=DEDUP_BLOCK).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it (operator 10)."""
    return cube_mixing.take(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix (operator 1)."""
    done = sentencepiece_codec.encode(docs, sentencepiece_codec.default_model(), block=CODING_BLOCK)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality), ("simhash near-dedup", near_dedup), ("suffix-array dedup", exact_dedup), ("source mixing", mixture), ("sentencepiece encoding", encoding)]

#: SQL can't express the fingerprints, compression ratios or sampling; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is a table of the shared checkpoint folder until the next one's is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Tables(spark)
    for _, stage in STAGES[:-1]:
        docs = tables.put(stage(spark, docs, sf_dir))
        tables.drop()
    return STAGES[-1][1](spark, docs, sf_dir)
