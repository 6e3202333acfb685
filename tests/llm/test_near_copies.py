"""Near copies by fingerprints, confirmed on full sets, one row of each group kept."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_operators import union
from tests.llm.test_setsketch import expected, found, near_copies, set_by_hand
from wavecairn.llm import components, setsketch, simhash

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def texts(n=40, seed=1):
    """Originals with copies of a similarity of about 0.8 to 1 each, and as many unrelated texts."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    rows = []
    for k in range(n):
        base = [word() for _ in range(250)]
        rows.append((10 * k, " ".join(base)))
        for copy in range(2):
            mine = list(base)
            for _ in range(int(rng.integers(0, 5))):
                mine[int(rng.integers(0, 250))] = word()
            rows.append((10 * k + 1 + copy, " ".join(mine)))
    return rows


def test_near_copies_go_and_clean_documents_stay(spark):
    rows = texts()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], KIND)
    kept = [r["doc_id"] for r in simhash.one_of_each(docs).collect()]
    assert len(kept) == len(set(kept)) and {d for d, _ in rows if d % 10 == 0} <= set(kept)
    sets = {d: set_by_hand(t) for d, t in rows}
    near = {d for d in sets if d % 10 and len(sets[d] & sets[d - d % 10]) >= 0.8 * len(sets[d] | sets[d - d % 10])}
    assert len(near) > 60 and len(near & set(kept)) <= 0.02 * len(near)


def test_edges(spark):
    a, b = "one two three four five six seven", "other words that have nothing in common at all"
    rows = [(1, a), (5, b), (5, a), (5, a), (None, b), (7, None), (8, ""), (None, " \n"), (None, "alone in the world of texts here"), (9, "short"), (9, "short")]
    docs = spark.createDataFrame([(d, t, None, "s", 1) for d, t in rows], KIND)
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.one_of_each(docs).collect()), key=str)
    assert kept == sorted([(1, a), (5, b), (7, None), (None, "alone in the world of texts here"), (9, "short")], key=str)
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def clustered(n, seed=5, bits=14):
    """Distinct fingerprints, in families whose members differ by up to some 14 bits."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, max(1, n // 20), dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, bits // 2 + 1), replace=False)) for _ in range(n)], dtype=np.uint64)
    return np.unique(base[rng.integers(0, len(base), n)] ^ flips)


def test_close_pairs_are_all_pairs_of_any_radius():
    values = clustered(600)
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    for radius in (0, 1, 2, 3, 4, 7, 12, 13):
        assert sum(r + 1 for r in simhash.reaches(radius)) == radius + 1
        got = {(int(i), int(j)) for left, right in simhash.close_pairs(values, values, radius) for i, j in zip(left, right)}
        assert got == {(int(i), int(j)) for i, j in np.argwhere(apart <= radius)}


def test_twelve_bits_look_at_few_pairs(monkeypatch):
    """pipeline at 6 GB: the tiles compared four fifths of all pairs at 12 bits, which did not end."""
    a, b = (np.random.default_rng(k).integers(0, 1 << 63, 20_000, dtype=np.uint64) for k in (1, 2))
    looked, count = [], np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: (looked.append(x.size), count(x))[1])
    near = {(int(i), int(j)) for left, right in simhash.close_pairs(a, b, 12) for i, j in zip(left, right)}
    assert near and sum(looked) < 0.02 * len(a) * len(b)


def test_every_two_chunks_meet_and_no_copies_are_broadcast(spark):
    """pipeline at 0.6 GB: tiles were copied 157 times by an explode, sized as one copy, and broadcast from that side."""
    values = clustered(9000)
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")
    plain = values.view(np.int64).tolist()
    want = None
    for options in ({}, {"chunk_rows": 700, "block_rows": 2800}, {"chunk_rows": 700, "block_rows": 10}):
        links = simhash.links(fps, 12, **options)
        assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
        got = union([(r.a, r.b) for r in links.collect()], plain)
        want = want or union([(plain[i], plain[j]) for i, j in np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 12)], plain)
        assert got == want


def test_a_group_of_a_chance_chain_is_not_compared_pair_by_pair(spark, monkeypatch):
    """pipeline at 6 GB: 12 bits join very many unlike texts, which met in tiles, each with each."""
    monkeypatch.setattr(setsketch, "DIRECT_ROWS", 10)
    rows = texts(60)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], KIND)
    config, sketches = setsketch.SketchConfig(), []
    sets = setsketch.distinct_sets(setsketch.sketch_rows(docs, config))
    ids = {r.id: r["first"] for r in sets.collect()}
    one = sets.select("id", F.lit(7).cast("bigint").alias("key"), F.lit(len(ids)).cast("bigint").alias("m"))
    whole = setsketch._pairs_of_tiles
    monkeypatch.setattr(setsketch, "_pairs_of_tiles", lambda tall, group, n, *rest: (sketches.append(tall.agg(F.max(n)).first()[0]), whole(tall, group, n, *rest))[1])
    links = setsketch.set_links(docs, sets.select("id", "n", "regs", "t1", "t2"), 80, 5, config, bucket=one)
    got = union([(ids[r.a], ids[r.b]) for r in links.collect()], list(ids.values()))
    hand = {d: set_by_hand(t) for d, t in rows}
    near = [(a, b) for a in ids.values() for b in ids.values() if a < b and len(hand[a] & hand[b]) * 100 >= 80 * len(hand[a] | hand[b])]
    assert len(near) > 60 and got == union(near, list(ids.values()))
    assert sketches[0] <= 6


def test_short_bands_find_what_whole_buckets_find(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "DIRECT_ROWS", 2)
    rows = near_copies(80)
    assert found(setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))) == expected(rows)


def test_few_links_take_no_rounds(spark, monkeypatch):
    """pipeline on check_h: hundreds of joins over a few links filled the driver's memory with their plans."""
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(900, 900)], "a bigint, b bigint")
    written, write = [], components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda df: (written.append(1), write(df))[1])
    for native in (False, True):
        written.clear()
        got = {r.node: r.component for r in components.connected_components(links, native=native).collect()}
        assert got == {900: 900} | dict.fromkeys(range(61), 0) and len(written) <= 3
        assert components.connected_components(links.limit(0), native=native).collect() == []
    monkeypatch.setattr(components, "LOCAL_ROWS", 10)
    monkeypatch.setattr(components, "DRIVER_ROWS", 10)
    monkeypatch.setattr(components, "FOREST_ROWS", 50)
    for native in (False, True):
        got = {r.node: r.component for r in components.connected_components(links, native=native).collect()}
        assert got == {900: 900} | dict.fromkeys(range(61), 0)
