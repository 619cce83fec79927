"""Operator 13 against a repair found by trying edits in order of cost."""

import hashlib
import heapq
import random
import re
import zlib

from pyspark.sql import functions as F

from tallyloom.llm import chat_repair

BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")
VALID = re.compile(r"(s?(ua)+)?\Z")


def body(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def wrecked(rows):
    """Rows after damage by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        told = lambda x: " " if x is None else str(x)
        role, text = told(role), told(text)
        how = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub(r"[.!?]", "", text) if how == 2 else text
        own += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), body(*r[1:])))
    return out


def cheapest(rows, faults):
    """Dijkstra over (row, output so far modulo its grammar state) with (cost, audit) as length; checks outputs with the pattern itself."""
    state = lambda out: ("" if not out else out if len(out) < 2 or out == "su" else "ua"[-2:] if out[-1] == "a" else "u")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, out, text = heapq.heappop(heap)
        if i == len(rows) and VALID.match(out):
            return cost, audit, "\n".join(text)
        if (key := (i, state(out), out[:1] == "s" and len(out) == 1)) in done:
            continue
        done.add(key)
        fits = lambda r: any(VALID.match(out + r + rest) for rest in ("", "a", "ua"))  # noqa: E731, B023
        for role in ("user", "assistant"):
            if fits(role[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", i, out + role[0], (*text, f"{role}:")))
        if i < len(rows):
            _, role, t = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, out, text))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if role[:1] in ("s", "u", "a") and fits(role[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, out + role[0], (*text, f"{role}:{t}")))
                for name in ("user", "assistant"):
                    if fits(name[0]):
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, out + name[0], (*text, f"{name}:{t}")))


def told(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, text = cheapest(rows, faults)
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_repairs_equal_the_cheapest_edits(spark, monkeypatch):
    monkeypatch.setattr(chat_repair, "CHUNK", 5)
    monkeypatch.setattr(chat_repair, "STRETCH", 8)
    rng = random.Random(13)
    rows = []
    for conv in range(300):
        turn = rng.choice([-9, 0, 0, 0, 5, 1 << 40])
        for _ in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ape", "ünder"])
            text = rng.choice(["Yes.", "Yes.", "No", " \t\n", "", "Why? ", "x. ", None, f"Body {rng.randrange(99)}!\n", "漢字。"])
            rows.append((conv, None if rng.random() < 0.05 else turn, role, text))
            turn += rng.choice([0, 1, 1, 1, 1, 2, 7])
    rows += [(None, i, "user" if i % 2 else "assistant", f"t{i}.") for i in range(40)]
    rows += [(10**6, None, r, "same.") for r in ("user", "assistant") * 9]
    rows += [(10**6 + 1, i, ("user", "assistant")[i // 3 % 2], f"{'w ' * 30000}{i}.") for i in range(30)]
    lost = next(c for c in range(10**7, 10**8) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "gone."))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit("clash"), "lost": F.lit(1)}).repartition(5)
    found = chat_repair.digests(chat_repair.repair(chat_repair.damaged(df))).collect()
    want = {conv: told(own) for conv, own in wrecked(rows).items()}
    assert len(found) == len(want)
    for row in found:
        assert tuple(row)[1:] == want[row["conv"]], row
    assert tuple(next(r for r in found if r["conv"] == lost))[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_the_repaired_messages_are_given(spark):
    rows = [("a", 1, "user", "Hi.", False), ("a", 2, "user", "Still here?", False), ("a", 3, "assistant", "Yes", False)]
    out = chat_repair.repair(spark.createDataFrame(rows, "conv string, turn long, role string, text string, lost boolean")).collect()
    heads, messages = [r for r in out if not r["nth"]], [tuple(r)[:5] for r in out if r["nth"]]
    assert [(r["truncated"], r["illegal"], r["cost"], r["audit"]) for r in heads] == [(1, 1, 3, "KIKK")]
    assert messages == [("a", 1, "K", "user", "Hi."), ("a", 2, "I", "assistant", ""), ("a", 3, "K", "user", "Still here?"), ("a", 4, "K", "assistant", "Yes")]


def test_suffixes_are_shared_and_folds_agree_with_one_walk():
    rng = random.Random(5)
    for _ in range(200):
        symbols = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(1, 12)))
        nodes = [chat_repair.seeds()]
        for c in reversed(symbols):
            nodes.append(chat_repair.before(c, nodes[-1]))
        cut = rng.randrange(len(symbols) + 1)
        tail = nodes[len(symbols) - cut][0]
        head = chat_repair.seeds()
        for c in reversed(symbols[:cut]):
            head = chat_repair.before(c, head)
        for e in range(4):
            both = min((head[x + 1][e][0] + tail[x][0], head[x + 1][e][1] + tail[x][1]) for x in range(4))
            assert both == nodes[-1][0][e]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_repair.digests(chat_repair.repair(chat_repair.damaged(df))).count() == 0
