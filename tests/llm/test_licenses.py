"""License scans: wrapped headers and whole files, against the same calculation in SQL over every piece of every text."""

import random
import textwrap

import duckdb
import pandas as pd

from wavecairn.llm import licenses
from wavecairn.llm.license_texts import TEMPLATES

#: The first template of at least 25 words.
LONG = {name: text for name, text in reversed(TEMPLATES) if len(text.split()) >= 25}


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    rows, expected = [], {}

    def add(path, text, licence):
        expected[len(rows)] = licence
        rows.append((len(rows), path, text))

    for k, (name, text) in enumerate(sorted(LONG.items())):
        for width, mark in ((40, "# "), (60, " * "), (76, "// "), (70, "")):
            wrapped = "\n".join(mark + x for x in textwrap.wrap(text, width))
            add(f"p{k}/src/{width}.c", f"{prose(rng, 30)}\n{wrapped}\n\n{prose(rng, 400)}", name)
        add(f"p{k}/one_line.txt", f"{prose(rng, 900)}. {text} {prose(rng, 20)}", name)
        add(f"w{k}/TERMS.txt", f"Copyright (c) 2020 {prose(rng, 3)}\n\n{textwrap.fill(text, 70)}\n", name)
        add(f"w{k}/a/b/x.c", prose(rng, 50), None)
    add("n/a", "the license of this software is not stated, and use of the work in any form is permitted by law only", None)
    add("n/b", "You may copy the list of names. " + prose(rng, 100), None)
    for path, text in ((None, None), ("n/c", None), ("n/d", ""), ("n/e", " \n\t\n"), (None, "Released under the MIT License.")):
        add(path, text, "MIT" if text and "MIT" in text else None)
    rows += [(1000, "p0/again.c", rows[0][2])] * 2
    return rows, expected


def compare(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y", 1.0) for r in rows], "id bigint, path string, text string, h string, own_license string, cosine double")
    got = licenses.scan_licenses(frame).withColumnRenamed("id", "doc_id").toPandas()
    con = duckdb.connect()
    con.register("given_files", pd.DataFrame(rows, columns=["id", "path", "text"]).astype({"id": "Int64", "path": "string", "text": "string"}))
    want = con.sql(licenses.oracle_sql("SELECT id, path, text FROM given_files")).df()
    clean = lambda df: sorted(tuple("" if pd.isna(v) else str(v) for v in r) for r in df[list(want.columns)].astype({"doc_id": "Int64"}).itertuples(index=False))
    assert clean(got) == clean(want)
    return got


def test_wrapped_headers_and_whole_files(spark):
    rows, expected = corpus()
    got = compare(spark, rows)
    own = {r.doc_id: None if pd.isna(r.own_license) else r.own_license for r in got.itertuples()}
    assert {k: own[k] for k in expected} == expected
    below = got[got["path"].fillna("").str.endswith("/a/b/x.c")]
    assert (below["origin"] == "inherited").all() and list(below["inherited_from"]) == [p.split("/")[0] for p in below["path"]]
    assert (got["doc_id"] == 1000).sum() == 2


def test_ties_long_texts_and_an_empty_table(spark):
    mit = "Released under the MIT License."
    rows = [(1, "a/LICENSE", mit), (2, "a/COPYING", mit), (3, "a/x", ("word " * 30_000) + mit), (4, "a/y", "word\n" * 30_000), (5, "a/b//z", "x"), (6, "/r", "x"), (None, "a/q", "x")]
    got = compare(spark, rows)
    assert got.set_index("path").loc["a/q", "license"] == "MIT"
    empty = licenses.scan_licenses(spark.createDataFrame([], "id bigint, path string, text string"))
    assert empty.count() == 0


def test_keys_of_texts_are_sixteen_bytes(spark):
    from pyspark.sql import functions as F

    from wavecairn.llm.licenses import name_of

    row = spark.createDataFrame([("abc",)], "s string").select(name_of(F.col("s")).alias("k"), F.md5("s").alias("h")).first()
    assert bytes(row["k"]).hex() == row["h"] and len(row["k"]) == 16
