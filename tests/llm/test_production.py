"""Queries and stages with their production thresholds against brute force."""

import re
from collections import defaultdict

import corpus_pipeline
from wavecairn.llm import linededup, queries
from tests.llm.test_operators import union

SF = "/root/testdata/sf0.001"


def allowed(n, classes):
    return max((t for least, t in classes if n >= least), default=-1)


def near_lines(lines, classes):
    """Pairs within the edits of the shorter line's class. No two lines within t edits lack a common run of (n - t) / (t + 1)."""
    runs, pairs = defaultdict(set), set()
    for x in lines:
        if len(x) >= 20:
            for k in range(len(x) - 8):
                runs[x[k : k + 9]].add(x)
    for x in lines:
        for y in set().union(*[runs[x[k : k + 9]] for k in range(len(x) - 8)]) if len(x) >= 20 else ():
            t = allowed(len(x), classes)
            if x != y and (len(x), x) < (len(y), y) and len(y) - len(x) <= t and re.sub("[^0-9]", "", x) == re.sub("[^0-9]", "", y) and within(x, y, t):
                pairs.add(frozenset((x, y)))
    return pairs


def within(x, y, t):
    while x and y and x[0] == y[0]:
        x, y = x[1:], y[1:]
    while x and y and x[-1] == y[-1]:
        x, y = x[:-1], y[:-1]
    row = {0: 0, **{j: j for j in range(1, min(t, len(y)) + 1)}}
    for i in range(1, len(x) + 1):
        now = {0: i} if i <= t else {}
        for j in range(max(1, i - t), min(len(y), i + t) + 1):
            now[j] = min(row.get(j, 99) + 1, now.get(j - 1, 99) + 1, row.get(j - 1, 99) + (x[i - 1] != y[j - 1]))
        if not now or min(now.values()) > t:
            return False
        row = now
    return row.get(len(y), 99) <= t


def dedup(table, classes):
    where = [(d, k, line) for d, text in sorted(table) for k, line in enumerate((text or "").split("\n")) if line.strip(" ")]
    kinds = {line for _, _, line in where}
    group = union([tuple(p) for p in near_lines(kinds, classes)], kinds)
    first = {}
    for d, k, line in where:
        first.setdefault(group[line], (d, k))
    gone = {(d, k) for d, k, line in where if first[group[line]] != (d, k)}
    return {d: None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (d, k) not in gone) for d, text in table}


def test_lines_with_a_changed_word_are_one(spark):
    import hashlib

    raw = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = dedup(raw, linededup.PRODUCTION)
    got = queries.op3_line_dedup(spark, SF).collect()
    assert {r["doc_id"]: r["text_md5"] for r in got} == {d: None if x is None else hashlib.md5(x.encode()).hexdigest() for d, x in want.items()}
    assert sum(r["n_near"] for r in got) > 0


def test_length_classes_equal_brute_force(spark):
    """Lengths on both sides of the borders; a pair follows its shorter line."""
    import numpy as np

    rng, lines = np.random.default_rng(7), set()
    for size in (20, 21, 58, 59, 60, 61, 118, 120, 122, 196, 199, 200, 201, 205):
        for _ in range(2):
            base = "".join(rng.choice(list("abcdefgh é"), size))
            lines.add(base)
            for n in range(1, 7):
                c = list(base)
                for _ in range(n):
                    k = int(rng.integers(0, len(c)))
                    c[k : k + 1] = [[], ["x"], [c[k], "y"]][int(rng.integers(0, 3))]
                lines.add("".join(c))
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(s,) for s in sorted(lines)], "text string").withColumn("line", F.xxhash64("text"))
    number = {r["line"]: r["text"] for r in frame.collect()}
    got = {frozenset((number[r["a"]], number[r["b"]])) for r in linededup.class_links(frame, linededup.PRODUCTION).collect()}
    plain = sorted(lines, key=lambda s: (len(s), s))
    want = {frozenset((a, b)) for k, a in enumerate(plain) for b in plain[k + 1 :] if len(a) >= 20 and len(b) - len(a) <= 4 and within(a, b, allowed(len(a), linededup.PRODUCTION))}
    assert got == want and len(want) > 40


def test_no_clean_document_leaves_with_language_id(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = {r["doc_id"] for r in docs.collect() if r["lang"] and any(c.isalpha() for c in r["text"] or "")}
    # The same texts without a label, and beginnings of 20 code points: what stays must not follow the length.
    bare = docs.withColumns({"doc_id": F.col("doc_id") + 1_000_000, "lang": F.lit(None).cast("string")})
    short = bare.withColumns({"doc_id": F.col("doc_id") + 1_000_000, "text": F.substr("text", F.lit(1), F.lit(20))})
    odd = [(-1, "Все люди рождаются свободными и равными в своём достоинстве и правах.", None), (-2, "123 456", "en"), (-3, None, "en"),
           (-4, "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", None)]
    more = spark.createDataFrame([(*r, "x", len(r[1] or "")) for r in odd], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    every = docs.unionByName(bare).unionByName(short).unionByName(more.select(docs.columns))
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, every, SF).select("doc_id").collect()}
    assert clean <= kept and not kept & {-1, -2, -3, -4}
    assert {d + 1_000_000 for d in clean} <= kept
    letters = {r["doc_id"] + 2_000_000 for r in docs.collect() if any(c.isalpha() for c in (r["text"] or "")[:20])}
    assert letters <= kept


def test_all_classes_take_one_pass_over_first_places(spark):
    """Keys of every class come out of one plan, and a repeated line makes them once."""
    from pyspark.sql import functions as F

    long = "one fairly long line of a text that is repeated here and there without any change at all, "
    docs = spark.createDataFrame([(1, f"{long}\n{long}\nshort line of some words"), (2, f"{long}\nshort line of some word"), (None, long)], "doc_id long, text string")
    spread = linededup.occurrences(docs)
    single = spread.groupBy("line", "line2").agg(F.min(F.struct("doc", "version", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
    got = [r["text"] for r in linededup.firsts(docs, spread.drop("text"), single).collect()]
    assert sorted(got) == sorted([long, "short line of some words", "short line of some word"])
    kinds = linededup.ranges(linededup.PRODUCTION)
    keys = linededup.segment_keys(spark.createDataFrame([(n, "".join(chr(97 + (7 * k + k // 5) % 26) for k in range(n))) for n in (19, 20, 59, 60, 61, 120, 200, 203, 204)], "line long, text string"), kinds)
    found = {(r["line"], r["t"]) for r in keys.select("line", "t").distinct().collect()}
    assert found == {(20, 1), (59, 1), (60, 1), (60, 2), (61, 2), (120, 2), (120, 3), (200, 3), (200, 4), (203, 4), (204, 4)}
    assert keys.groupBy("key").agg(F.count_distinct("t").alias("n")).where("n > 1").count() == 0
