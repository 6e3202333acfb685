"""The ten operators against brute force on small tables, and their defined results at the edges."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecairn.llm import ann, arrow_stream, components, langid, licenses, linededup, mixing, packing, queries, secrets, simhash, tokens, topk

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, size string, `key` string"
EDGES = [
    (1, None, None, None), (2, "", "en", "a"), (3, "  \n\t", "en", "a"), (4, "one two", "en", None), (4, "one two", "en", None),
    (None, "a b c d e f", "fr", "b"), (6, "line one is long enough here\nline one is long enough hers\n\nother", "fr", "b"),
    (7, "word " * 30_000, "en", "a"), (8, "日本 é password = 'abcdefghijklmno' x", "de", "ñ"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z") for r in EDGES], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.orderBy("doc_id").collect()


def union(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


# 1 ------------------------------------------------------------------------------------------------------
def fingerprint_by_hand(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark, rows):
    want = {r["doc_id"]: fingerprint_by_hand(r["text"]) for r in rows}
    near = [(a, b) for a in want for b in want if a < b and (want[a] ^ want[b]).bit_count() <= 4]
    group = union(near, want)
    got = {r["doc_id"]: r for r in queries.op1_simhash(spark, SF).collect()}
    assert {d: int(r["fingerprint"], 16) for d, r in got.items()} == want
    assert {d: r["component_id"] for d, r in got.items()} == group


def test_tile_links_find_exactly_the_close_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(2000)], dtype=np.uint64)
    values = np.unique(np.concatenate([base, base[rng.integers(0, 300, 2000)] ^ flips]))
    half = lambda v: (np.bitwise_count(v >> np.uint64(32)), np.bitwise_count(v & np.uint64(0xFFFFFFFF)))
    tiles = {}
    for v, a, b in zip(values, *half(values)):
        tiles.setdefault((int(a), int(b)), []).append(v)
    links = []
    for p in tiles:
        for q in tiles:
            if p <= q and abs(p[0] - q[0]) + abs(p[1] - q[1]) <= 4:
                u, v = simhash.tile_links(np.array(tiles[p]), np.array(tiles[q]), 4)
                links += list(zip(u.tolist(), v.tolist()))
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    plain = values.tolist()
    near = np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4)
    assert union(links, plain) == union([(plain[i], plain[j]) for i, j in near], plain)


def test_simhash_edges(spark, edges):
    got = simhash.near_duplicates(edges).collect()
    assert len(got) == len(EDGES)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fp"] == by[2]["fp"] == by[3]["fp"] == 0 and by[3]["component_id"] == 1
    assert simhash.near_duplicates(edges.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 400)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == union(links, {x for p in links for x in p})


def test_few_links_do_not_become_a_file_for_each_partition(spark, monkeypatch, tmp_path):
    """pipeline on check_h: rounds over a few links wrote a file for each of 211 shuffle partitions, which filled the disk."""
    from wavecairn import session

    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    edges = [(10 * k + j + 1, 10 * k + j) for k in range(50) for j in range(9)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        monkeypatch.setattr(session, "shared_folder", lambda s: str(tmp_path))
        got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {n: n // 10 * 10 for n in range(500)}
    tables = sorted(tmp_path.glob("wavecairn-*"), key=lambda t: t.stat().st_mtime)
    assert len(tables) > 2 and all(len(list(t.glob("*.parquet"))) == 1 for t in tables[1:])


# 2 and 7 ------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 12)).astype("float32")
    x[300:340] = x[20]
    found = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    odd = [(800, None, 1), (850, [0.0] * 12, 1), (900, [float("nan")] + [1.0] * 11, 1), (950, [None] + [1.0] * 11, 1), (1000, [], 1), (1050, [1.0, 2.0], 1), (1100, [float("inf")] * 12, 1), (1, x[2].tolist(), 1), (None, x[3].tolist(), 1)]
    return spark.createDataFrame(found + odd, "vec_id bigint, embedding array<float>, score int")


def usable(vectors, zero):
    out = []
    for r in vectors.collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v and all(c is not None and np.isfinite(c) for c in v) and (zero or any(v)):
            out.append((r["vec_id"], np.array(v, dtype=float)))
    return out


def test_top_k_equals_brute_force(vectors):
    data = [(i, np.floor(256 * v).astype(int)) for i, v in usable(vectors, True)]
    want = []
    for q, x in data:
        if q % 50 == 0:
            scored = sorted([(-int(x @ y), i) for i, y in data if i != q and len(y) == len(x)])[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    got = topk.exact_top_k(vectors, F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.exact_top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_recall_scores_and_ties(spark, vectors):
    data = usable(vectors, False)
    truth = {}
    for q, x in data:
        if q % 10 == 0:
            truth[q] = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in data if i != q and len(y) == len(x))
    got = {}
    for r in ann.nearest(vectors, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    hits = sum(len({i for _, i in v} & {i for _, i in truth[q][:10]}) for q, v in got.items())
    assert hits >= 0.9 * sum(min(10, len(truth[q])) for q in got)
    for q, v in got.items():
        assert v == sorted(v) and len(v) == min(10, len(truth[q])) and all(p in truth[q] for p in v)
    assert [i for _, i in got[20][:10]] == list(range(300, 310))
    assert ann.nearest(vectors.where("vec_id < 5"), F.col("vec_id") == 2).count() == 5


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_recall_on_the_embeddings(spark, table):
    frame = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet").toPandas()
    ids, x = frame["vec_id"].to_numpy(), np.stack(frame["embedding"].to_numpy()).astype(float)
    asked = ids[ids % 100 == 0][:30]
    got = ann.nearest(spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet"), F.col("vec_id").isin(asked.tolist())).toPandas()
    hits = 0
    for q in asked:
        d = ((x - x[ids == q]) ** 2).sum(axis=1)
        d[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & set(got["vec_id"][got["query_id"] == q]))
    assert hits / (10 * len(asked)) >= 0.9


# 3 ------------------------------------------------------------------------------------------------------
def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("t,rounds,pair_rows", [(1, 2, 256), (1, 1, 4), (2, 2, 16), (2, 0, 32)])
def test_edit_links_equal_brute_force(spark, t, rounds, pair_rows):
    rng = np.random.default_rng(t)
    base = ["".join(rng.choice(list("abcé ü"), 12)) for _ in range(6)]
    found = set(base)
    for s in base * 25:
        c = list(s)
        for _ in range(rng.integers(1, t + 2)):
            k = int(rng.integers(0, len(c)))
            c[k : k + 1] = [[], ["x"], [c[k], "y"]][int(rng.integers(0, 3))]
        found.add("".join(c))
    lines = spark.createDataFrame([(s,) for s in sorted(found)] * 2, "text string").withColumn("line", F.xxhash64("text"))
    number = {r["line"]: r["text"] for r in lines.collect()}
    got = {frozenset((number[r["a"]], number[r["b"]])) for r in linededup.edit_links(lines, t, 8, rounds=rounds, pair_rows=pair_rows).collect()}
    want = {frozenset((a, b)) for a in found for b in found if a < b and min(len(a), len(b)) >= 8 and edits(a, b) <= t}
    # Every link is true, and no two lines that true links join come apart; within a ball not every pair is written.
    assert got <= want
    assert union([tuple(p) for p in got], found) == union([tuple(p) for p in want], found)
    if not rounds:
        assert got == want


def test_a_ball_of_near_lines_is_linked_by_pivots(spark):
    """60 lines with one changed letter each: about a link a line, not 1770 pairs."""
    base = "the quick brown fox jumps over the lazy dog and runs along the river bank until evening"
    lines = [base[:k] + "#" + base[k + 1 :] for k in range(5, 65)]
    df = spark.createDataFrame([(x,) for x in lines], "text string").withColumn("line", F.xxhash64("text"))
    got = [(r["a"], r["b"]) for r in linededup.edit_links(df, 2, 20).collect()]
    assert len(got) <= 2 * len(lines)
    assert len(set(union(got, {n for p in got for n in p}).values())) == 1 and len({n for p in got for n in p}) == 60


def dedup_by_hand(table, least=20):
    """table: (doc_id, text) of different documents; the kept text of each."""
    where = [(d, k, line) for d, text in sorted(table) for k, line in enumerate((text or "").split("\n")) if line.strip(" ")]
    kinds = sorted({line for _, _, line in where})
    digits = {line: re.sub("[^0-9]", "", line) for line in kinds}
    short = {}
    for line in kinds:
        if len(line) >= least:
            short.setdefault(len(line), []).append(line)
    near = []
    for n, group in short.items():
        for a in group:
            for b in group + short.get(n + 1, []):
                if a < b or len(a) != len(b):
                    half = n // 2
                    if (a[:half] == b[:half] or a[-half:] == b[-half:]) and digits[a] == digits[b] and edits(a, b) <= 1:
                        near.append((a, b))
    group = union(near, kinds)
    first = {}
    for d, k, line in where:
        first.setdefault(group[line], (d, k))
    gone = {(d, k) for d, k, line in where if first[group[line]] != (d, k)}
    return {d: None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (d, k) not in gone) for d, text in table}


def test_line_dedup_equals_brute_force(docs, rows):
    want = dedup_by_hand([(r["doc_id"], r["text"]) for r in rows])
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    assert {d: r["text"] for d, r in got.items()} == want
    assert all(r["n_lines"] - r["n_exact"] - r["n_near"] == (len(want[d].split("\n")) if want[d] else 0) or not want[d] for d, r in got.items())


def test_line_dedup_edges(edges):
    out = linededup.dedup_lines(edges)
    assert out.columns[: len(edges.columns)] == edges.columns and out.count() == len(EDGES)
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[1]["text"] is None and by[1]["n_lines"] == 0
    assert by[6]["text"] == "line one is long enough here\n\nother" and by[6]["n_near"] == 1
    assert by[4]["text"] == "one two"
    assert linededup.dedup_lines(edges.limit(0)).count() == 0


# 4 ------------------------------------------------------------------------------------------------------
KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = {
    "assign": (re.compile(rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}


def secrets_by_hand(text):
    found = [(m.start(), n, m.end(), kind) for n, (kind, (rule, good)) in enumerate(BASE.items()) for m in rule.finditer(text or "") if good(m)]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def test_secrets_equal_the_expressions(spark, rows, edges):
    rng = np.random.default_rng(2)
    parts = ["token", "secret", "=", ":", " ", '"', "AKIA", "a", "0", "ab12", "Z", "passwd", "é", "API_KEY", "apikey", "\n", "AKIA0000AAAA1111ZZ"]
    texts = [r["text"] for r in rows] + ["".join(rng.choice(parts, rng.integers(0, 60))) for _ in range(3000)] + [None, "", "0" * 100_000]
    tool = secrets.Scanner()
    for t in texts:
        assert [s for s in tool.scan((t or "").encode()) if s[2] in BASE] == secrets_by_hand(t)
    got = {r["doc_id"]: r for r in queries.op4_secrets(spark, SF).collect()}
    for r in rows:
        want = secrets_by_hand(r["text"])
        assert got[r["doc_id"]]["base_sha256"] == secrets.digest(want) and got[r["doc_id"]]["n_hex"] == sum(k == "hex" for *_, k in want)
    assert secrets.scan_secrets(edges).count() == len(EDGES) and secrets.scan_secrets(edges.limit(0)).count() == 0
    assert secrets.Scanner().scan(b"x ghp_" + b"a1" * 20)[0][2] == "hub"


# 5 ------------------------------------------------------------------------------------------------------
def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) >= 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_kernel_equals_sets_of_hashed_grams():
    a, b = "Das ist ein Text", "ein anderer Text"
    rows = np.zeros((2, langid.PLACES), dtype=np.float32)
    for row, t in zip(rows, (a, b)):
        langid.presence(t, row)
    grams = [{t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in (a, b)]
    assert [int(r.sum()) for r in rows] == [len(g) for g in grams] and int(rows[0] @ rows[1]) == len(grams[0] & grams[1])


def test_language_edges(edges, docs):
    model = langid.train(docs, F.lit(True))
    got = {r["doc_id"]: r for r in langid.identify(edges, model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and len(got) == len({r[0] for r in EDGES})
    assert langid.train(edges.limit(0), F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.identify(edges, None).collect()} == {"und"}


# 6 and 8 ------------------------------------------------------------------------------------------------
def ids_by_hand(text):
    return tokens.encoder().tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_ids_equal_the_tokenizer():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    parts = [*"abzAZ019 ''.,!?-\n\t<|>éÉñß×÷œΣσİ́  中\x1c\x7f", "<|endoftext|>", "'s", "'ll", "  ", "don't"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)] + [None, "", "x" * 50_000]
    ids, counts = tokens.encoder().encode(pa.array(texts))
    ends = np.cumsum(counts)
    for t, end, n in zip(texts, ends, counts):
        assert ids[end - n : end].tolist() == ids_by_hand(t)


def test_stream_round_trip(spark, rows, edges, tmp_path):
    got = queries.op6_token_stream(spark, SF).orderBy("doc_id").collect()
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = [*ids_by_hand(r["text"]), 1]
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r["doc_id"], start, len(ids), crc(ids))
        start += len(ids)
    manifest = arrow_stream.write_stream(edges, str(tmp_path / "edges"), 1, 64)
    out = arrow_stream.read_documents(manifest).collect()
    assert len(out) == len(EDGES) and sorted(r["n_tokens"] for r in out)[:3] == [1, 1, 1]
    part = manifest.where("n_tokens > 1").first()
    file = arrow_stream.StreamFile(part["tokens_path"])
    flat = np.concatenate([file.sequence(k)[file.mask(k)] for k in range(len(file))])
    assert len(flat) == part["n_tokens"] and np.array_equal(flat, file.tokens(0, part["n_tokens"]))
    assert np.shares_memory(file.sequence(0), file.batches[0].column("ids").values.to_numpy())
    assert arrow_stream.read_documents(arrow_stream.write_stream(edges.limit(0), str(tmp_path / "none"))).count() == 0


def check_packing(out, capacity=2048):
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_is_whole_and_tight(spark, rows, edges):
    out = queries.op8_packing(spark, "/root/testdata/sf0.01").collect()
    used = check_packing(out)
    assert used <= np.ceil(sum(r["length"] for r in out) / 2048) * 1.01 + 1
    small = {(r["doc_id"], r["piece"]): r for r in queries.op8_packing(spark, SF).collect()}
    want = 0
    for r in rows:
        ids = [*ids_by_hand(r["text"]), 0]
        for n, begin in enumerate(range(0, len(ids), 2048)):
            g, part = small[r["doc_id"], n], ids[begin : begin + 2048]
            assert (g["start"], g["length"], g["ids_crc32"]) == (begin, len(part), crc(part))
            want += 1
    assert len(small) == want
    odd = packing.pack_documents(edges).collect()
    check_packing(odd)
    assert len({r["doc_id"] for r in odd}) == len({r[0] for r in EDGES}) and packing.pack_documents(edges.limit(0)).count() == 0


def test_tiny_pieces_are_dealt_by_their_number(spark):
    tiny = spark.range(50).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "1L AS length", "0L AS ids_crc32")
    out = packing.pack(tiny, capacity=8, pieces_per_task=10).collect()
    check_packing(out, 8)
    assert len(out) == 50 and len({r["sequence_id"] >> 40 for r in out}) == 5


def test_sum_of_squares_takes_the_smallest_sum():
    lengths, capacity = np.random.default_rng(4).integers(1, 11, 200), 10
    bins, offsets = packing.sum_of_squares(lengths, capacity)
    fill = {}
    for size, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        assert o == fill.get(b, 0) and o + size <= capacity

        def cost(change):
            gaps = np.bincount([capacity - v for v in {**fill, **change}.values()], minlength=capacity + 1)
            return int((gaps[1:capacity] ** 2).sum())

        options = [cost({b2: v + size}) for b2, v in fill.items() if v + size <= capacity] + [cost({-1: size})]
        assert cost({b: fill.get(b, 0) + size}) == min(options)
        fill[b] = fill.get(b, 0) + size


# 9 ------------------------------------------------------------------------------------------------------
def targets_by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {s: 0.0 for s in names}, 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total, full = sum(weight[s] for s in open_), set()
        share, left = left, 0.0
        for s in open_:
            target[s] += share * weight[s] / total
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                full.add(s)
        open_ -= full
    return target


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixing_reaches_the_targets(spark, sf):
    got = queries.op9_mixing(spark, f"/root/testdata/{sf}").join(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    sizes, taken, most = {}, {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = targets_by_hand(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in queries.op9_mixing(spark, f"/root/testdata/{sf}").collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_rounding_through_a_deep_tree(spark):
    rng = np.random.default_rng(6)
    items = spark.createDataFrame([("a" if k % 3 else None, k, int(s), 0.3) for k, s in enumerate(rng.integers(0, 500, 3000))], "source string, doc_id bigint, size bigint, p double")
    out = mixing.round_copies(items, rows_per_task=20, fan_in=3).toPandas()
    assert len(out) == 3000 and set(out["p"]) <= {0.0, 1.0}
    for _, g in out.groupby("source", dropna=False):
        assert abs((g["size"] * g["p"]).sum() - 0.3 * g["size"].sum()) <= 500


def test_mixing_edges(spark, edges):
    got = mixing.mix(edges).collect()
    assert len(got) == len(EDGES) and all(r["copies"] <= 2 for r in got)
    out = mixing.mixed_documents(edges)
    assert out.columns == edges.columns
    assert out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(edges.limit(0)).count() == 0 and mixing.mixed_documents(edges.limit(0)).count() == 0


# 10 -----------------------------------------------------------------------------------------------------
def test_licenses_and_inheritance(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    files = spark.createDataFrame([
        (1, "p/LICENSE", apache), (2, "p/src/a.c", "code"), (3, "p/src/deep/b.c", None), (4, "p/src/deep/LICENSE.txt", f"{mit}"),
        (5, "q/c.c", "code"), (6, "q/d.c", f"text\n{mit}\nmore of it and a good deal more than that"), (7, None, mit), (8, "p/src/deep/er/e.c", ""), (9, "top.c", "x"), (5, "q/c.c", "code"),
    ], "id bigint, path string, text string")
    got = {r["id"]: (r["license"], r["origin"], r["inherited_from"]) for r in licenses.scan_licenses(files).collect()}
    assert got == {
        1: ("Apache-2.0", "own", None), 2: ("Apache-2.0", "inherited", "p"), 3: ("MIT", "inherited", "p/src/deep"), 4: ("MIT", "own", None), 5: (None, "none", None),
        6: ("MIT", "own", None), 7: ("MIT", "own", None), 8: ("MIT", "inherited", "p/src/deep"), 9: (None, "none", None),
    }
    assert licenses.scan_licenses(files).count() == 10 and licenses.scan_licenses(files.limit(0)).count() == 0


def test_schemas_have_no_void(spark):
    for name, query in queries.QUERIES.items():
        assert not any(isinstance(f.dataType, T.NullType) for f in query(spark, SF).schema), name


def test_top_k_of_huge_components_and_sql(spark):
    """Nothing is left out for its size: sums beyond a machine word's half are exact, too."""
    import duckdb

    rng = np.random.default_rng(9)
    values = {i: rng.standard_normal(4) * 10.0 ** (i % 7) for i in range(60)}
    values[50] = np.array([3e5, -3e5, 1.0, 2.0])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in values.items()], "vec_id bigint, embedding array<double>")
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in values.items()}
    want = []
    for q in (0, 50):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert sorted(tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    rows = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.ORACLE_SQL})").fetchall()
    assert sorted(rows) == sorted(tuple(r) for r in queries.op7_top_k(spark, SF).collect())
