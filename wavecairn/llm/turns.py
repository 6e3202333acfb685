"""Repair of conversations: turns aligned with the alternating grammar, at the least cost.

The roles of a repaired conversation read (s?(ua)+)?, by their initials. For each feasible length that is one
target string, and the turns are aligned with it by the Wagner-Fischer recurrence. Targets of one kind (with
or without the leading s) are prefixes of each other, so one matrix of each kind has the costs of all lengths
in its last row. Cells outside Ukkonen's band, which follows from the cost of the incumbent, are not computed.
Each length of the least cost is traced back, and the least of these audits is the result.

Rows are numbered, flagged and joined by Spark; the alignment of a conversation sees an initial, two flags and
a hash for each turn, never its texts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecairn.llm.common import column, map_rows
from wavecairn.session import cut_lineage

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
_FAR = 1 << 60
ROLES = {"u": "user", "a": "assistant"}
PLAN = "array<struct<place:int,source:int,role:string>>"


def target(leading: bool, j: int) -> str:
    """Character j of the endless target string."""
    if leading and not j:
        return "s"
    return "ua"[(j - leading) % 2]


def _substitute(initial: str, dead: bool, cut: bool, goal: str) -> int:
    """Cost of letting a turn stand for a target character."""
    if dead:
        return _FAR
    if initial == goal:
        return KEEP + CUT * cut
    return _FAR if goal == "s" else REROLE + CUT * cut


def _incumbent(turns: list[tuple[str, bool, bool]]) -> int:
    """Cost of some valid repair: everything deleted, or each turn kept or given the next role in order."""
    best = DELETE * len(turns)
    for leading in (False, True):
        j = cost = 0
        for turn in turns:
            step = _substitute(*turn, target(leading, j))
            cost, j = (cost + step, j + 1) if step < _FAR else (cost + DELETE, j)
        if leading and not j:
            continue
        short = 2 if leading and j == 1 else (j - leading) % 2
        best = min(best, cost + INSERT * short)
    return best


def _lengths(leading: bool, low: int, high: int) -> list[int]:
    """Feasible lengths between ``low`` and ``high``."""
    return [n for n in range(max(low, 3 if leading else 0), high + 1) if n % 2 == leading]


def _costs(turns: list[tuple[str, bool, bool]], leading: bool, bound: int) -> dict[int, int]:
    """Length to cost, for the lengths that stay within ``bound``."""
    n, below, above = len(turns), bound // DELETE, bound // INSERT
    row: dict[int, int] = {}
    for i in range(n + 1):
        now: dict[int, int] = {}
        for j in range(max(0, i - below), i + above + 1):
            best = 0 if i == j == 0 else _FAR
            if i:
                best = min(best, row.get(j, _FAR) + DELETE)
                if j:
                    best = min(best, row.get(j - 1, _FAR) + _substitute(*turns[i - 1], target(leading, j - 1)))
            if j and target(leading, j - 1) != "s":
                best = min(best, now.get(j - 1, _FAR) + INSERT)
            if best <= bound:
                now[j] = best
        row = now
    return {j: row[j] for j in _lengths(leading, 0, max(row, default=-1)) if j in row}


def _audit(turns: list[tuple[str, bool, bool]], leading: bool, length: int, cost: int) -> str:
    """The least audit of cost ``cost`` for one target length: costs to the end, then the first letter that is on a cheapest way."""
    n, below, above = len(turns), cost // DELETE, cost // INSERT
    rest: list[dict[int, int]] = [{} for _ in range(n + 2)]
    for i in range(n, -1, -1):
        here, after = rest[i], rest[i + 1]
        for j in range(min(length, i + above), max(0, i - below) - 1, -1):
            best = 0 if i == n and j == length else _FAR
            if i < n:
                best = min(best, after.get(j, _FAR) + DELETE)
                if j < length:
                    best = min(best, after.get(j + 1, _FAR) + _substitute(*turns[i], target(leading, j)))
            if j < length and target(leading, j) != "s":
                best = min(best, here.get(j + 1, _FAR) + INSERT)
            if best <= cost:
                here[j] = best
    letters, i, j = [], 0, 0
    while i < n or j < length:
        left = rest[i][j]
        if i < n and rest[i + 1].get(j, _FAR) + DELETE == left:
            letters.append("D")
            i += 1
        elif j < length and target(leading, j) != "s" and rest[i].get(j + 1, _FAR) + INSERT == left:
            letters.append("I")
            j += 1
        else:
            letters.append("K" if turns[i][0] == target(leading, j) else "R")
            i, j = i + 1, j + 1
    return "".join(letters)


def align(turns: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Least cost and audit of turns (role initial, must be deleted, truncated)."""
    bound, found = _incumbent(turns), []
    for leading in (False, True):
        costs = _costs(turns, leading, bound)
        found += [(cost, leading, length) for length, cost in costs.items()]
        bound = min([bound, *costs.values()])
    cost = min(found)[0]
    return cost, min(_audit(turns, leading, length, cost) for c, leading, length in found if c == cost)


def plan_of(audit: str) -> list[dict]:
    """Turns of the repaired conversation: place, source (place among the given turns, or null) and role (null: as it is)."""
    leading = (len(audit) - audit.count("D")) % 2 == 1
    out, source = [], 0
    for letter in audit:
        if letter != "D":
            role = None if letter == "K" else ROLES[target(leading, len(out))]
            out.append({"place": len(out), "source": None if letter == "I" else source, "role": role})
        source += letter != "I"
    return out


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (null: one space), source (place from 0, by turn, nulls first; then role, text)."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return cut_lineage(rows.withColumn("source", F.row_number().over(order) - 1))


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, plan of every conversation in ``numbered`` rows."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    turn = F.struct(
        "source", F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"),
        F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"))
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"))
    kind = T.StructType([whole.schema["conv_id"], whole.schema["gaps"]] + [T.StructField(c, T.LongType()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
                        + [T.StructField("audit", T.StringType()), T.StructField("plan", T._parse_datatype_string(PLAN))])

    def run(batch: pa.RecordBatch) -> dict:
        out = {f.name: [] for f in kind}
        for turns in column(batch, "turns").to_pylist():
            seen, rows, counts = set(), [], [0, 0, 0]
            for t in turns:
                key = (t["h1"], t["h2"])
                fault = 0 if t["blank"] else 1 if key in seen else 2 if t["cut"] else None
                seen.add(key)
                if fault is not None:
                    counts[fault] += 1
                rows.append((t["initial"], fault in (0, 1), fault == 2))
            cost, audit = align(rows)
            for name, n in zip(("blank", "duplicate", "truncated"), counts):
                out[name].append(n)
            out["illegal"].append(sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])))
            out["cost"].append(cost)
            out["audit"].append(audit)
            out["plan"].append(plan_of(audit))
        return out | {"conv_id": column(batch, "conv_id"), "gaps": column(batch, "gaps")}

    return cut_lineage(map_rows(whole, run, kind, 256))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Turns after repair: conv_id, place, role, text, source (null where inserted)."""
    steps = found.select("conv_id", F.explode("plan").alias("p")).select(F.col("conv_id").alias("c"), "p.place", F.col("p.source").alias("s"), F.col("p.role").alias("r"))
    given = rows.select("conv_id", "source", "role", "text")
    joined = steps.join(given, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("s") == F.col("source")), "left")
    return joined.select(F.col("c").alias("conv_id"), "place", F.coalesce("r", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("s").alias("source"))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audit of every conversation, its turns after repair) of conversations (conv_id, turn, role, text).

    A null role or text is one space. Turns are taken by turn (null first), equal ones by role and text. A
    turn's first fault counts: blank, duplicate (role and text stood earlier), truncated (does not end in
    ``.!?``). Keeping a turn costs 0, changing its role 2, deleting it 3 (blank and duplicate ones must be
    deleted), inserting an empty turn 2; a truncated turn that stays adds 1. ``audit`` has the letters K, R,
    D, I of the cheapest edits in order, the ASCII-least of equally cheap ones. A null conv_id is a
    conversation like any other; an empty table gives two empty ones; other columns are not read. A
    conversation of any length is sorted and joined by Spark; its alignment holds some 20 bytes a turn, and
    the band's width for each turn.
    """
    rows = numbered(conversations)
    found = audits(rows)
    return found, repaired(rows, found)


def damage(conversations: DataFrame) -> DataFrame:
    """Known faults at repeatable places: by crc32 of ``conv_id:turn`` (nulls: one space) modulo 20.

    0 drops a row, 1 empties its text, 2 removes its full stops, 3 repeats it, 4 makes it the user's.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), changed.alias("text"), copies.alias("copy")).drop("copy")


def digests(conversations: DataFrame, found: DataFrame, turns: DataFrame) -> DataFrame:
    """Every conv_id of ``conversations`` with its audit and the SHA-256 of its repaired ``role:text`` lines."""
    line = F.struct("place", F.concat("role", F.lit(":"), "text").alias("line"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n")
    hashed = turns.groupBy(F.col("conv_id").alias("h")).agg(F.sha2(text, 256).alias("sha"))
    every = conversations.select(F.col("conv_id").alias("every")).distinct()
    joined = every.join(found, F.col("every").eqNullSafe(F.col("conv_id")), "left").join(hashed, F.col("every").eqNullSafe(F.col("h")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("every").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
