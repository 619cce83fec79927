"""Operator 13: conversation structure repair with a suffix-shared DAWG.

Every message becomes one symbol: its role's initial (s, u, a or other) with or without the fault `truncated`, or `must go`
for blank and duplicate ones. Conversations are strings of symbols, cut at multiples of `STRETCH` turns and after
`CHUNK` messages, so that one conversation of any length is worked on by many tasks. Distinct strings of all conversations
are sorted by their ends and walked as an automaton that shares suffixes: a node is a distinct suffix, and for each node
and grammar state the cost-to-go and the best audit suffix are computed once, towards the end of the conversation and
towards each grammar state in which a chunk can end. A conversation then is the fold of its chunks from the last to the
first, on four states.

Edits that follow a chunk's last message belong to the next chunk, so no audit of a chunk is the beginning of another one for
the same messages: two audits differ within the chunk, and the least of a whole is made of the least of its chunks.

Grammar: `(s?(ua)+)?` over role initials. Keep costs 0, Rerole to user or assistant 2, Delete 3 (required for blank and
duplicate messages), Insert of an empty user or assistant message 2; an undeleted truncated message adds 1. Of the cheapest
repairs the one with the ASCII-least audit (initials of the edits in order) is taken.

Defined results: messages are ordered by turn (null first), role, then the MD5 of role and text; a null role or text is one space; a
null conversation is one of its own; repeated rows are duplicates; a conversation of which nothing is left has zeros and an empty audit;
empty tables give empty results; extra columns are ignored. Gaps beyond 64 bits are given as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .frames import spread_join, stored
from .text import WHITE

STRETCH, CHUNK = 1024, 64
GONE = "x"  # the symbol of a message that must go; others are a letter for role and fault
#: Symbols by role (s, u, a, other), sound and truncated.
SOUND, CUT = "suao", "SUAO"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or re-roled message, and after a kept one, by state.
NEXT = (USER, USER, ASSISTANT, USER)
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
FAR = 1 << 40
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

Best = list[tuple[int, str]]


def seeds() -> list[Best]:
    """Cost and audit after the last message by state: towards the end, then towards each state."""
    end = [(0, ""), (4, "II"), (2, "I"), (0, "")]
    return [end, *([(0, "") if e == x else (FAR, "") for e in range(4)] for x in range(4))]


def before(symbol: str, after: list[Best]) -> list[Best]:
    """A node of the automaton from the node of its suffix without the first symbol."""
    role, extra = symbol.lower(), 0 if symbol.islower() else 1
    out = []
    for best in after:
        own = []
        for e in range(4):
            found = [(best[e][0] + 3, "D" + best[e][1])]
            if symbol != GONE:
                if (to := KEEP[e].get(role)) is not None:
                    found.append((best[to][0] + extra, "K" + best[to][1]))
                to = NEXT[e]
                found.append((best[to][0] + 2 + extra, "R" + best[to][1]))
            own.append(min(found))
        for _ in range(3):  # inserts before this message: three go around all states
            own = [min(own[e], (own[NEXT[e]][0] + 2, "I" + own[NEXT[e]][1])) for e in range(4)]
        out.append(own)
    return out


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs and audits of chunks that come in the order of their reversed symbols; what two neighbours share at the end is computed once."""
    path, nodes = "", [seeds()]
    for batch in batches:
        found = []
        for back in batch.column("back").to_pylist():
            same = 0
            while same < min(len(path), len(back)) and path[same] == back[same]:
                same += 1
            del nodes[same + 1 :]
            for symbol in back[same:]:
                nodes.append(before(symbol, nodes[-1]))
            path = back
            found.append([x for best in nodes[-1] for x in best])
        yield pa.record_batch({"symbols": batch.column("symbols"), "n": batch.column("n"), "costs": pa.array([[c for c, _ in x] for x in found], pa.list_(pa.int64())), "audits": pa.array([[a for _, a in x] for x in found], pa.list_(pa.string()))})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _sent(make: Callable, ddl: str, many: int = 2000) -> Callable:
    """A function for mapInArrow from one that turns rows into rows; at most `many` rows go on at once."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in make(_rows(batches)):
            held.append(row)
            if len(held) == many:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    return run


CHUNKS = "stretch long, nth long, symbols string, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_role string, last_role string"


def _chunks(most: int) -> Callable:
    """A function from rows (conv, stretch, turn, role, body, init, blank, cut, later) in order to chunks of at most `most` messages."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        place, last, chunk = None, None, None

        def closed() -> tuple:
            return (*place, nth, "".join(symbols), *chunk.values())

        for conv, stretch, turn, _, body, init, blank, cut, later in rows:
            if chunk and (place != (conv, stretch) or len(symbols) == most):
                yield closed()
                nth, chunk = nth + 1, None
            if place != (conv, stretch):
                place, last, nth = (conv, stretch), None, 0
            if chunk is None:
                symbols, chunk = [], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "first": turn, "last": turn, "first_role": init, "last_role": None}
            again = later or last == (turn, body)
            fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
            if fault:
                chunk[fault] += 1
            symbols.append(GONE if blank or again else (CUT if cut else SOUND)[SOUND.index(init)])
            chunk["illegal"] += chunk["last_role"] is not None and (chunk["last_role"], init) not in LEGAL
            chunk["turns"] += turn is not None and (last is None or last[0] != turn)
            chunk["last"], chunk["last_role"], last = turn, init, (turn, body)
        if chunk:
            yield closed()

    return run


def _folded(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, *STATS, audit) from chunks (conv, *CHUNKS, costs, audits) in order of conversation, the last chunk first."""
    conv, state, back = None, None, []

    def closed() -> tuple:
        audit, e = [], START
        for step in reversed(back):
            text, e = step[e]
            audit.append(text)
        gaps = state["high"] - state["low"] + 1 - state["turns"] if state["low"] is not None else 0
        return (conv, min(gaps, (1 << 63) - 1), state["blank"], state["duplicate"], state["truncated"], state["illegal"], state["best"][START], "".join(audit))

    for own, _, _, _, blank, duplicate, truncated, illegal, turns, low, high, head, tail, costs, audits in rows:
        if state is None or own != conv:
            if state is not None:
                yield closed()
            conv, back, state = own, [], {"low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "best": None, "head": None}
        if state["best"] is None:
            best = [(costs[e], audits[e], START) for e in range(4)]
        else:
            best = [min((costs[4 * x + 4 + e] + state["best"][x], audits[4 * x + 4 + e], x) for x in range(4)) for e in range(4)]
            state["illegal"] += (tail, state["head"]) not in LEGAL
        back.append([(audit, to) for _, audit, to in best])
        state["best"], state["head"] = [cost for cost, _, _ in best], head
        for name, value in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated), ("illegal", illegal), ("turns", turns)):
            state[name] += value
        if low is not None:
            state["low"], state["high"] = low, state["high"] if state["high"] is not None else high
    if state is not None:
        yield closed()


def _repaired(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, nth, edit, role, text, *STATS, audit) from rows (conv, kind, turn, role, body, text, *STATS, audit): kind 0 a fold, 1 a conversation's name, 2 a message."""
    conv, open_, state, nth, audit, at = None, False, START, 0, "", 0
    none = (None,) * 7

    def inserts(more: bool) -> Iterator[tuple]:
        nonlocal state, nth, at
        while audit[at : at + 1] == "I":
            state, nth, at = NEXT[state], nth + 1, at + 1
            yield (conv, nth, "I", NAMES[state], "", *none)
        if more == (at == len(audit)):
            raise RuntimeError("the second reading of the conversations differs; give a table or a checkpoint")

    for own, kind, _, role, _, text, *told in rows:
        if not open_ or own != conv:
            if open_:
                yield from inserts(False)
            conv, open_, state, nth, audit, at = own, True, START, 0, told[-1] or "", 0
            yield (conv, 0, None, None, None, *(x or 0 for x in told[:-1]), audit)
        if kind < 2:
            continue
        yield from inserts(True)
        edit, at = audit[at], at + 1
        if edit != "D":
            state, nth = KEEP[state][role[0]] if edit == "K" else NEXT[state], nth + 1
            yield (conv, nth, edit, role if edit == "K" else NAMES[state], text, *none)
    if open_:
        yield from inserts(False)


def _digest(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, *STATS, audit, sha256) from the rows of _repaired()."""
    head, digest = None, None
    for conv, nth, _, role, text, *told in rows:
        if not nth:
            if head:
                yield (*head, digest.hexdigest())
            head, digest = (conv, *told), hashlib.sha256()
        else:
            digest.update(f"{chr(10) if nth > 1 else ''}{role}:{text}".encode())
    if head:
        yield (*head, digest.hexdigest())


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, lost): rows damaged by the CRC-32 of `conv:turn` modulo 20; those that are dropped are lost."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"), (F.crc32(F.concat_ws(":", told(conv_col), told(turn_col))) % 20).alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("how") == 0).alias("lost"), copies.alias("copy")).drop("copy")


def repair(rows: DataFrame) -> DataFrame:
    """Repaired messages of rows (conv, turn, role, text, lost), which must be a table's or a checkpoint's as they are read twice.

    Columns: conv, nth, edit, role, text, then the counts of STATS and the audit, which the head row
    of each conversation (nth 0) has. Rows of a conversation stand together and in order in one partition; lost rows
    only name their conversation.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    body = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    own = rows.where("NOT lost").withColumn("body", body)
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    init = F.substring("role", 1, 1)
    narrow = own.select(
        "conv", "turn", F.floor(F.col("turn") / STRETCH).alias("stretch"), "role", "body", F.when(init.isin("s", "u", "a"), init).otherwise("o").alias("init"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut")
    )
    first = narrow.groupBy(F.col("conv").alias("c"), F.col("body").alias("b")).agg(F.min(F.struct("turn")).alias("first"))
    narrow = narrow.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("body") == F.col("b")))
    narrow = narrow.select("conv", "stretch", "turn", "role", "body", "init", "blank", "cut", (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("later"))
    sorted_ = narrow.repartition("conv", "stretch").sortWithinPartitions("conv", "stretch", "turn", "role", "body")
    chunks = stored(sorted_.mapInArrow(_sent(_chunks(CHUNK), f"conv {kind}, {CHUNKS}"), f"conv {kind}, {CHUNKS}"))
    known = chunks.groupBy("symbols").agg(F.count("*").alias("n")).withColumn("back", F.reverse("symbols"))
    solved = stored(known.repartitionByRange("back").sortWithinPartitions("back").mapInArrow(_solve, "symbols string, n long, costs array<long>, audits array<string>"))
    joined = spread_join(chunks, solved, "symbols")
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    ordered = joined.select("conv", *names, "costs", "audits").repartition("conv").sortWithinPartitions("conv", F.desc_nulls_last("stretch"), F.desc("nth"))
    told = f"conv {kind}, {', '.join(f'{x} long' for x in STATS)}, audit string"
    folds = ordered.mapInArrow(_sent(_folded, told, 200), told)
    blank = [F.lit(None).cast("long").alias(x) for x in STATS]
    none = F.lit(None).cast("string")
    heads = folds.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), none.alias("role"), F.lit(None).cast("binary").alias("body"), none.alias("text"), *STATS, "audit")
    lost = rows.where("lost").select("conv", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("turn"), none.alias("role"), F.lit(None).cast("binary").alias("body"), none.alias("text"), *blank, none.alias("audit"))
    wide = own.select("conv", F.lit(2).alias("kind"), "turn", "role", "body", "text", *blank, none.alias("audit"))
    whole = heads.unionByName(lost).unionByName(wide).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "body")
    out = f"conv {kind}, nth long, edit string, role string, text string, {', '.join(f'{x} long' for x in STATS)}, audit string"
    return whole.mapInArrow(_sent(_repaired, out), out)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, *STATS, audit, repaired_sha256) of what repair() returns, one row a conversation."""
    out = f"conv {repaired.schema['conv'].dataType.simpleString()}, {', '.join(f'{x} long' for x in STATS)}, audit string, repaired_sha256 string"
    return repaired.mapInArrow(_sent(_digest, out), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_chat_repair: the damaged `conversations`, repaired."""
    return digests(repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))).withColumnRenamed("conv", "conv_id")
