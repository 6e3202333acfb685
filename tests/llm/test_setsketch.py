"""Set sketches and near-duplicates against brute force over full sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, EDGES, union
from wavecairn.llm import queries, setsketch

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def set_by_hand(text, words=5):
    import re

    parts = re.findall("[^\x20\x09-\x0d]+", lower(text))
    if not parts:
        return frozenset()
    return frozenset(tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1)))


def expected(rows):
    """Rows (doc_id, n, component, kept) of (doc_id, text) with ids that are not null and not repeated."""
    sets = {d: set_by_hand(t) for d, t in rows}
    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in where.values() for a in ds for b in ds if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    group = union(links, list(sets))
    least = {}
    for d, g in group.items():
        least[g] = min(least.get(g, d), d)
    return sorted((d, len(sets[d]), least[g], d == least[g]) for d, g in group.items())


def found(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op11_minhash(spark, f"/root/testdata/{sf}")) == expected(rows)


def near_copies(n, seed=3):
    """Copies of one text with words changed at random, of other texts with the same start, and unlinked ones."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    base, other = [word() for _ in range(300)], [word() for _ in range(300)]
    rows = []
    for d in range(n):
        text = list(base if d % 3 else base[:150] + other[150:])
        for _ in range(int(rng.integers(0, 12))):
            text[int(rng.integers(0, 300))] = word()
        rows.append((d, " ".join(text)))
    return rows


@pytest.mark.parametrize("tile_rows", [1024, 16])
def test_large_group_of_near_copies(spark, tile_rows, monkeypatch):
    rows = near_copies(240)
    monkeypatch.setattr(setsketch.set_links, "__defaults__", (2, tile_rows, None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(setsketch.near_duplicates(docs)) == expected(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z") for r in EDGES], DOCS)
    out = {}
    for r in setsketch.near_duplicates(docs.withColumn("n", F.lit(1)).withColumn("id", F.lit(2))).collect():
        out.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert out[1] == [(0, 1, True)] and out[2] == [(0, 2, True)] and out[3] == [(0, 3, True)]
    assert out[4] == [(1, 4, True)] * 2
    assert out[None] == [(2, None, True)]
    assert out[7] == [(1, 7, True)]
    assert setsketch.near_duplicates(docs.limit(0)).collect() == []


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    config = setsketch.SketchConfig()
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = pool[:2600], pool[600:]
    ra, rb = setsketch.registers(a, config), setsketch.registers(b, config)
    assert (np.maximum(ra, rb) == setsketch.registers(pool, config)).all()
    got = setsketch.similarities(ra[None], rb[None], np.array([2600]), np.array([3400]), config)[0]
    assert abs(got - 2000 / 4000) < 0.12
    near = [(len(pool) * f // 100) for f in (85, 90, 99)]
    for n in near:
        got = setsketch.similarities(ra[None] if n == 0 else setsketch.registers(pool[:n], config)[None], setsketch.registers(pool, config)[None], np.array([n]), np.array([len(pool)]), config)[0]
        assert abs(got - n / len(pool)) < 0.1
