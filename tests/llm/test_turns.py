"""Repair of conversations against an exhaustive search over the grammar, and its edges."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from wavecairn.llm import queries, turns

BLANK, ENDS = "\x20\x09\x0a\x0b\x0c\x0d", ".!?"


def cheapest_by_hand(rows):
    """Uniform-cost search over (turns used, grammar state); cost, audit and repaired lines. The queue is ordered by (cost, audit)."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        for to, role in (("u", "user"), ("a", "assistant")):
            if (state, to) in after:
                heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*out, f"{role}:")))
        if i < len(rows):
            role, text, dead, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if not dead:
                if role[:1] and (state, role[:1]) in after:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
                for to, name in (("u", "user"), ("a", "assistant")):
                    if (state, to) in after:
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, to, (*out, f"{name}:{text}")))


def conversation_by_hand(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of given rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, counts, flagged = set(), [0, 0, 0], []
    for _, role, text in rows:
        bare = text.strip(BLANK)
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ENDS else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        flagged.append((role, text, fault in (0, 1), fault == 2))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest_by_hand(flagged)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged_by_hand(rows):
    out = {}
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        mine = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: conversation_by_hand(r) for c, r in out.items()}


def found(df):
    return {r[0]: tuple(r[1:]) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_search(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").collect()]
    assert found(queries.op12_turns(spark, f"/root/testdata/{sf}")) == damaged_by_hand(rows)


def test_edges(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "a."), (1, 0, "tool", "x"), (1, None, "system", "s."), (1, 3, "user", "y?"), (1, 3, "user", "y?"), (2, 5, "", "long " * 50_000),
        (3, 1, "assistant", " \n"), (4, 0, "system", "only."), (5, -2, "üser", "日本。"), (5, 9, "assistant", "end!\n"), (5, 9, "assistant", None),
    ]
    talks = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, source int, plan string")
    assert found(turns.digests(talks, *turns.repair(turns.damage(talks)))) == damaged_by_hand(rows)
    fine = talks.where("conv_id > 1")
    want = {}
    for conv, turn, role, text in rows:
        if conv and conv > 1:
            want.setdefault(conv, []).append((turn, role, " " if text is None else text))
    assert found(turns.digests(fine, *turns.repair(fine))) == {c: conversation_by_hand(r) for c, r in want.items()}
    assert found(turns.digests(talks.limit(0), *turns.repair(talks.limit(0)))) == {}


def test_alignment_equals_search():
    rng = random.Random(5)
    for _ in range(1500):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), "t", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(10))]
        rows = [(r, t, dead, cut and not dead) for r, t, dead, cut in rows]
        assert turns.align([(r[:1], dead, cut) for r, _, dead, cut in rows]) == cheapest_by_hand(rows)[:2]


def test_long_conversation():
    rng = random.Random(6)
    rows = [("ua"[i % 2] if rng.random() > 0.02 else rng.choice("uas"), rng.random() < 0.01, False) for i in range(1200)]
    assert turns.align(rows) == cheapest_by_hand([({"u": "user", "a": "assistant", "s": "system"}[r], "t", d, c) for r, d, c in rows])[:2]
