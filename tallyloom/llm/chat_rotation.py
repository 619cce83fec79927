"""Operator 7: chat formatting by multi-party perspective rotation.

Every participant of a conversation in turn is the assistant: the dialogue is rendered once for each, with
that speaker's turns as the assistant's, all others as named users, and a loss mask over the
assistant's words. The result has a row for each message of each rendering with its place in the
rendered dialogue, so that a dialogue of any length is spread over tasks: places are sums
over stretches of `STRETCH` turn numbers, and within a stretch. `dialogues` puts renderings together
for conversations that fit a row.

Defined results: messages are ordered by turn (null first), role and text; a null text is empty; a
message without a role is a user's named `unknown` and gets no rendering of its own; rows without a
conversation are left out; repeated rows are messages of their own; empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ASSISTANT, NAMED, CLOSE, STRETCH = "<|assistant|>\n", "<|user name={}|>\n", "\n<|end|>\n", 1024


def rotate(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, nth, loss, piece, start, loss_start, loss_end) for each message of each rendering.

    start is the place of the piece in the rendered dialogue in characters, from 0; loss_start and
    loss_end bound the assistant's words and closing mark, null where the speaker is another.
    """
    turns = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.floor(F.coalesce(F.col(turn_col), F.lit(-1)) / STRETCH).alias("stretch")
    )
    speakers = turns.where("role is not null").select("conv_id", F.col("role").alias("perspective")).distinct()
    loss = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    head = F.when(loss, ASSISTANT).otherwise(F.format_string(NAMED.replace("{}", "%s"), F.coalesce("role", F.lit("unknown"))))
    told = turns.join(speakers, "conv_id").withColumn("loss", loss).withColumn("head", head).withColumn("piece", F.concat("head", "text", F.lit(CLOSE)))
    own = ["conv_id", "perspective", "stretch"]
    # what comes before a stretch: one row for each stretch of a rendering
    sums = told.groupBy(*own).agg(F.sum(F.length("piece")).alias("chars"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*own, F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_n"))
    within = Window.partitionBy(*own).orderBy("turn", "role", "text")
    placed = told.withColumn("nth", F.row_number().over(within)).withColumn("in", F.sum(F.length("piece")).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece"))
    start = F.col("base") + F.col("in")
    return placed.join(bases, own).select(
        "conv_id", "perspective", (F.col("base_n") + F.col("nth")).alias("nth"), "loss", "piece", start.alias("start"),
        F.when(F.col("loss"), start + F.length("head")).alias("loss_start"), F.when(F.col("loss"), start + F.length("piece")).alias("loss_end"),
    )


def dialogues(rotated: DataFrame) -> DataFrame:
    """(conv_id, perspective, rendered, mask array<struct<start, end>>): whole renderings, one a row."""
    rows = F.array_sort(F.collect_list(F.struct("nth", "piece", "loss", "loss_start", "loss_end")))
    whole = rotated.groupBy("conv_id", "perspective").agg(rows.alias("m"))
    mask = F.transform(F.filter("m", lambda x: x["loss"]), lambda x: F.struct(x["loss_start"].alias("start"), x["loss_end"].alias("end")))
    return whole.select("conv_id", "perspective", F.array_join(F.transform("m", lambda x: x["piece"]), "").alias("rendered"), mask.alias("mask"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_chat_rotation: every message of every rendering of `conversations`."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role IS NOT NULL),
j AS (
  SELECT t.conv_id, s.perspective, t.turn, t.role, t.text, coalesce(t.role = s.perspective, false) AS loss,
         CASE WHEN coalesce(t.role = s.perspective, false) THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || coalesce(t.role, 'unknown') || '|>' || chr(10) END AS head
  FROM t JOIN s USING (conv_id)),
p AS (SELECT *, head || text || chr(10) || '<|end|>' || chr(10) AS piece FROM j),
w AS (
  SELECT *, row_number() OVER o AS nth, CAST(sum(length(piece)) OVER (o ROWS UNBOUNDED PRECEDING) - length(piece) AS BIGINT) AS start
  FROM p WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text))
SELECT conv_id, perspective, nth, loss, piece, start,
       CASE WHEN loss THEN start + length(head) END AS loss_start, CASE WHEN loss THEN start + length(piece) END AS loss_end
FROM w
"""
