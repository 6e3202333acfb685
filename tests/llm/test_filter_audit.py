"""The filter audit against a plain count, with retractions over several micro-batches, and its SQL."""

import re
from itertools import permutations

import duckdb
import pytest

from wavecairn.llm import filter_audit, queries

SF = "/root/testdata/sf0.001"
NAMES = ["part", "filter_order", "step", *filter_audit.REPORT]


def by_hand(docs, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    smallest = {}
    for d, text, _ in docs:
        if d is not None:
            smallest[text or ""] = min(smallest.get(text or "", d), d)
    rows = []
    for d, text, source in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if d is not None and d > smallest[text] else set()
        rows.append((source or "", fails, d in good, d in toxic))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [r for r in mine if f in r[1] and not r[1] & before]
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
                out[part, "".join(order), k + 1] = [
                    sum(not r[1] & (before | {f}) for r in mine), len(here), sum(f in r[1] and bool(r[1] & before) for r in mine), sum(r[1] == {f} for r in mine),
                    sum(r[2] for r in here), sum(r[3] for r in here), (part, f)]
    return {k: tuple([*v[:-1], shapley[v[-1]]]) for k, v in out.items()}


def found(df):
    rows = df.select(*NAMES).collect()
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    want = by_hand(rows, labels)
    assert found(queries.op13_filter_audit(spark, SF)) == want
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(f"SELECT {', '.join(NAMES)} FROM ({filter_audit.ORACLE_SQL})").fetchall()
    assert {(r[0], r[1], r[2]): tuple(r[3:]) for r in got} == want


@pytest.mark.parametrize("batches", [1, 4, 100])
def test_retractions(spark, tmp_path, batches):
    """The same text comes with smaller and smaller ids, file after file."""
    long = " ".join(f"w{k}" for k in range(250))
    rows = [(d, [long, "short # text", None, "", "UPPER CASE"][d % 5], [None, "a", "b"][d % 3]) for d in range(60, 0, -1)]
    rows += [(None, long, "a"), (None, long, "a"), (7, long, "c"), (7, long, "c"), (1, long, "b"), (1, long, None), (61, "word " * 30_000, "a")]
    for k in range(8):
        part = spark.createDataFrame([(*r, 1, "x") for r in rows[k * 9 : (k + 1) * 9]], "doc_id bigint, text string, source string, mask int, part string")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    labels = [(1, 1, 0), (1, 0, 1), (7, 1, None), (None, 1, 1), (60, 0, 1), (33, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    want = by_hand(rows, [x for x in labels if x[0] is not None])
    assert found(filter_audit.audit_filters(spark, f"{tmp_path}/docs", marks, batches)) == want


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/none")
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit_filters(spark, f"{tmp_path}/none", marks).collect() == []
