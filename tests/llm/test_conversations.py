"""Conversation repair against a plain search over (cost, edits), whole and cut into small chunks."""

import hashlib
import random
import sys
import zlib
from functools import lru_cache

import pytest

from tests.llm.util import no_rows, table
from tianguis.llm import conversations, turns
from tianguis.llm.queries import op13_conversation_structure_repair

sys.setrecursionlimit(20_000)  # of the plain search, four calls a row
BLANK = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kind = ""
        if not text.strip(BLANK):
            kind = "blank"
        elif (role, text) in seen:
            kind = "duplicate"
        elif text.strip(BLANK)[-1] not in ".!?":
            kind = "truncated"
        seen.add((role, text))
        out.append(kind)
    return out


def brute(conv, rows):
    """The report of a conversation's rows (turn, role, text) in order, by trying every edit in every state."""
    faults = faults_of(rows)
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state, inserted):
        """(cost, edits) of the cheapest way from row i on; at most three insertions in a row."""
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            ways += [(2 + c, "I" + e) for s in follow[state] if s != "s" for c, e in [best(i, s, inserted + 1)]]
        if i < len(rows):
            role = rows[i][1]
            c, e = best(i + 1, state, 0)
            ways.append((3 + c, "D" + e))
            if faults[i] in ("", "truncated"):
                more = int(faults[i] == "truncated")
                if role[:1] and role[:1] in follow[state]:
                    c, e = best(i + 1, role[:1], 0)
                    ways.append((more + c, "K" + e))
                for s in follow[state]:
                    if s != "s":
                        c, e = best(i + 1, s, 0)
                        ways.append((2 + more + c, "R" + e))
        return min(ways) if ways else (10**9, "")

    cost, audit = best(0, "", 0)
    said, state, left = [], "", list(rows)
    for e in audit:
        if e == "I" or e == "R":
            state = next(s for s in follow[state] if s != "s")
            text = "" if e == "I" else left.pop(0)[2]
            said.append({"u": "user", "a": "assistant"}[state] + ":" + text)
        else:
            _, role, text = left.pop(0)
            if e == "K":
                state = role[:1]
                said.append(f"{role}:{text}")
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def damaged(rows):
    """(conv, turn, role, text) after damage, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        mine = out.setdefault(conv, [])
        if fault == 1:
            text = ""
        elif fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif fault == 4:
            role = "user"
        mine += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def answers(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def expected(by_conv):
    return sorted((brute(c, r) for c, r in by_conv.items()), key=repr)


def random_rows(seed, convs=60, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(0, longest) + 1):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "s", "User"])
            text = rng.choice(["Hello.", "Why?", "cut off", "", " \t", None, "No!", "x\x85", f"n{rng.random()}.", "Ja. "])
            turn = rng.choice([t, t, t, t, t + 5, None, 0])
            rows.append((c if c else None, turn, role, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_query_on_the_table(spark):
    rows = [tuple(r) for r in table(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert answers(op13_conversation_structure_repair(spark, "/root/testdata/sf0.001")) == expected(damaged(rows))


@pytest.mark.parametrize("seed,chunk", [(1, 4096), (2, 1), (3, 2), (4, 3)])
def test_random_conversations_whole_and_in_chunks(spark, seed, chunk):
    rows = random_rows(seed)
    df = conversations.damaged(frame(spark, rows).repartition(3))
    assert answers(conversations.audits(df, chunk_rows=chunk)) == expected(damaged(rows))


def test_a_long_conversation_in_many_chunks_and_partitions(spark):
    """All blank stretches pass a cost vector on unchanged, so the fix-up takes several passes."""
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant"]), "" if 60 < t < 260 else f"t{rng.randint(0, 150)}.") for t in range(320)]
    rows += [(2, t, ["user", "assistant"][t % 2], f"fine {t}.") for t in range(6)]
    by_conv = damaged(rows)
    df = conversations.damaged(frame(spark, rows).repartition(6))
    assert answers(conversations.audits(df, chunk_rows=4)) == expected(by_conv)
    edits = [r for r in conversations.repaired(df, chunk_rows=4).collect() if r.conv_id == 1]
    audit = brute(1, by_conv[1])
    assert "".join(r.edit for r in sorted(edits, key=lambda r: r.position)) == audit[7]
    said = "\n".join(f"{r.role}:{r.text}" for r in sorted(edits, key=lambda r: r.position) if r.edit != "D")
    assert hashlib.sha256(said.encode()).hexdigest() == audit[8]


def test_passes_do_not_grow_with_the_chunks(spark, monkeypatch):
    """200 chunks of blank rows in a row: vectors never meet, and yet a handful of tables is written."""
    written = []
    monkeypatch.setattr(conversations, "saved", lambda df, name, keep=conversations.saved: written.append(name) or keep(df, name))
    rows = [(1, t, "user", "") for t in range(400)] + [(1, 400, "assistant", "x.")]
    assert answers(conversations.audits(frame(spark, rows), chunk_rows=2)) == [brute(1, [r[1:] for r in rows])]
    assert written.count("costs") <= 6


def test_vectors_meet_again():
    codes = bytes([turns.U, turns.A] * 20)
    begin = turns.backward(codes, turns.GUESS)[0][0]
    assert turns.refitted(codes, turns.GUESS, turns.FINAL, begin) == turns.backward(codes, turns.FINAL)[0][0] == begin


def test_dropped_conversations_odd_columns_and_no_rows(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = frame(spark, [(dropped, 0, "user", "Hi.")])
    for name in ("part", "seq", "place", "head", "mix", "row", "copy", "fault", "key", "codes", "end"):
        df = df.withColumn(name, df.text)
    assert answers(conversations.audits(conversations.damaged(df))) == [(dropped, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    assert conversations.audits(conversations.damaged(no_rows(df))).collect() == []
    assert conversations.repaired(no_rows(df)).collect() == []
