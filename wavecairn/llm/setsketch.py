"""Near-duplicates by exact Jaccard similarity: set sketches, banded registers, joint likelihood, verification.

A sketch has registers of exponentially spaced, truncated minima: register i of a set is
floor(1 - log_b(smallest h_i)), with h_i exponential over the elements. Registers of a union are the maxima
of the registers, and equal registers grow with the similarity, so bands of registers are bucket keys.
Members of a bucket are compared with the bucket's pivot first; only rows that still lie in another
component than a member of their bucket meet in tiles, by registers and then by their full sets. No pair
list of a bucket is ever written: pivots give a row for each member, tiles give spanning forests.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecairn.llm.common import column, map_rows, raw_texts, small
from wavecairn.llm.components import connected_components
from wavecairn.session import cut_lineage


#: Rows of a bucket that meet each other directly; of a larger one, those meet that share a short band.
DIRECT_ROWS = 4096
#: Registers of a short band: at a similarity of 0.8 all 64 bands differ with a probability of 3e-16.
SHORT_BAND = 4


@dataclass(frozen=True)
class SketchConfig:
    """``bands * rows`` registers with base ``base``, values 0 to ``top``; ``slack`` is kept below the threshold.

    A pair at similarity 0.85 has equal registers with probability 0.86, so all of 32 bands of 8 miss it with
    probability 8e-6. The deviation of the estimate is 0.022 with 256 registers: 0.13 is about six of them.
    """

    bands: int = 32
    rows: int = 8
    base: float = 1.1
    top: int = 400
    slack: float = 0.13
    seed: int = 11

    @property
    def registers(self) -> int:
        return self.bands * self.rows


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(data: bytes, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words are one shingle, no words none."""
    import xxhash

    parts = data.lower().split()  # bytes: A-Z only, and white space is U+0020 and U+0009 to U+000D
    if not parts:
        return np.empty(0, dtype=np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), len(parts))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts), dtype=np.uint64, count=len(parts))
    n = len(parts) - words + 1
    x = np.zeros(n, dtype=np.uint64)
    for j in range(words):
        x = _mixed(x + h[j : j + n] * _MULTIPLIERS[j % 5])
    return np.unique(x)


def registers(shingles: np.ndarray, config: SketchConfig) -> np.ndarray:
    """The sketch of a non-empty set, as 16-bit registers."""
    rng = np.random.default_rng(config.seed)
    odd = rng.integers(0, 1 << 63, config.registers, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.integers(0, 1 << 63, config.registers, dtype=np.uint64)
    least = np.full(config.registers, np.iinfo(np.uint64).max)
    step = max(1, (1 << 16) // config.registers)
    for at in range(0, len(shingles), step):
        part = shingles[at : at + step]
        np.minimum(least, ((part[:, None] ^ salt) * odd).min(axis=0), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    exponential = -np.log1p(-uniform)  # rate 1; the smallest of n has rate n
    level = np.floor(1.0 - np.log(exponential) / np.log(config.base))
    return np.clip(level, 0, config.top + 1).astype(np.uint16)


def joint_similarity(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, base: float) -> np.ndarray:
    """Similarities of greatest likelihood, given how many registers of a are greater, less or equal, and both sizes.

    The log-likelihood is concave in the similarity: bisection on its derivative.
    """
    n_a, n_b = np.asarray(n_a, dtype=np.float64), np.asarray(n_b, dtype=np.float64)
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    c = (base - 1) / base
    p = lambda x: -np.log1p(-c * x) / np.log(base)
    slope = lambda x: c / (1 - c * x) / np.log(base)
    low, high = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(30):
        j = (low + high) / 2
        x, y = u - v * j, v - u * j
        px, py = np.maximum(p(x), 1e-300), np.maximum(p(y), 1e-300)
        rest = np.maximum(1 - px - py, 1e-300)
        rising = -greater * v * slope(x) / px - less * u * slope(y) / py + equal * (v * slope(x) + u * slope(y)) / rest > 0
        low, high = np.where(rising, j, low), np.where(rising, high, j)
    return (low + high) / 2


def similarities(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, config: SketchConfig) -> np.ndarray:
    """Row by row, of two matrices of registers."""
    greater, equal = (a > b).sum(axis=1), (a == b).sum(axis=1)
    return joint_similarity(greater, config.registers - greater - equal, equal, n_a, n_b, config.base)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _forest(n: int) -> tuple[list[int], callable]:
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    return parent, root


def _near_in_registers(regs_a, n_a, comp_a, regs_b, n_b, comp_b, same: bool, percent: int, config: SketchConfig):
    """Index pairs of different components whose estimate comes up to the threshold less the slack."""
    least = percent / 100 - config.slack
    order = np.argsort(n_b, kind="stable")
    sizes = n_b[order]
    for i in range(len(regs_a)):
        lo, hi = np.searchsorted(sizes, [n_a[i] * percent / 100 - 1e-9, n_a[i] * 100 / percent + 1e-9], side="left")
        j = order[lo:hi]
        j = j[(comp_b[j] != comp_a[i]) & ((j > i) if same else True)]
        if len(j):
            near = similarities(np.broadcast_to(regs_a[i], (len(j), config.registers)), regs_b[j], np.full(len(j), n_a[i]), n_b[j], config)
            yield i, j[near >= least]


def _sketches(members: pa.Array) -> tuple:
    fields = members.flatten() if isinstance(members, pa.StructArray) else None
    ids, comp, n, regs = (fields[k] for k in range(4))
    matrix = np.frombuffer(b"".join(regs.to_pylist()), dtype="<u2").reshape(len(regs), -1)
    return ids.to_numpy(zero_copy_only=False), comp.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False), matrix


def _pairs_of_tiles(tall: DataFrame, group: list[str], n: str, tile_rows: int, member: list[str]) -> DataFrame:
    """(same, a, b): lists of at most about ``tile_rows`` members; every two members of a group meet in one row.

    A group of any size is cut by a hash into chunks, and chunks meet by their numbers: no task holds a group.
    """
    chunk = F.pmod(F.xxhash64(*member[:1]), F.ceil(F.col(n) / F.lit(tile_rows)).cast("bigint"))
    tiles = cut_lineage(tall.groupBy(*group, chunk.alias("chunk"), F.ceil(F.col(n) / F.lit(tile_rows)).cast("bigint").alias("chunks")).agg(F.collect_list(F.struct(*member)).alias("rows")))
    within = tiles.select(F.lit(True).alias("same"), F.col("rows").alias("a"), F.when(F.lit(False), F.col("rows")).alias("b"))
    several = tiles.where("chunks > 1")
    left = several.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))).where("other > chunk").withColumnRenamed("rows", "a")
    right = several.select(*group, F.col("chunk").alias("other"), F.col("rows").alias("b"))
    # Both sides are sorted: Spark sizes what comes out of an explode like what went in, and would broadcast all copies.
    return within.unionByName(left.hint("merge").join(right.hint("merge"), [*group, "other"]).select(F.lit(False).alias("same"), "a", "b"))


def sketch_rows(docs: DataFrame, config: SketchConfig, words: int = 5) -> DataFrame:
    """Row by row: doc_id, t1, t2 (of the text), n_shingles, s1, s2 (of the set), regs; null for an empty set."""
    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))

    def run(batch) -> dict:
        sets = [shingle_set(x, words) for x in raw_texts(batch)]
        digest = np.frombuffer(b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets), dtype="<i8").reshape(-1, 2)
        empty = np.array([not len(s) for s in sets], dtype=bool)
        return {
            "doc_id": column(batch, "doc_id"), "t1": column(batch, "t1"), "t2": column(batch, "t2"), "n_shingles": [len(s) for s in sets],
            "s1": pa.array(digest[:, 0], mask=empty), "s2": pa.array(digest[:, 1], mask=empty), "regs": [registers(s, config).astype("<u2").tobytes() if len(s) else None for s in sets],
        }

    return map_rows(slim, run, "doc_id bigint, t1 bigint, t2 bigint, n_shingles bigint, s1 bigint, s2 bigint, regs binary", 128)


def _estimated(pairs: DataFrame, percent: int, config: SketchConfig) -> DataFrame:
    """Pairs (a, b) out of (a, b, na, nb, ra, rb) whose likely similarity comes up to the threshold less the slack."""
    least = percent / 100 - config.slack

    def run(batches):
        for batch in batches:
            ra, rb = (np.frombuffer(b"".join(column(batch, c).to_pylist()), dtype="<u2").reshape(batch.num_rows, -1) for c in ("ra", "rb"))
            na, nb = (column(batch, c).to_numpy() for c in ("na", "nb"))
            if batch.num_rows:
                keep = similarities(ra, rb, na, nb, config) >= least
                yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], names=["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, percent: int, words: int) -> DataFrame:
    """Pairs (a, b) out of (a, b, x, y) whose full sets are linked. Rows sorted by a compute its set once."""

    def run(batches):
        last, kept = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(column(batch, "a").to_pylist(), raw_texts(batch, "x"), raw_texts(batch, "y")):
                if a != last:
                    last, kept = a, shingle_set(x, words)
                keep.append(linked(kept, shingle_set(y, words), percent))
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _register_forest(tiles: DataFrame, percent: int, config: SketchConfig) -> DataFrame:
    """Of each pair of tiles, a spanning forest (a, b) of the rows that could link two components."""

    def run(batch) -> dict:
        out_a, out_b = [], []
        for k in range(batch.num_rows):
            same = batch.column(0)[k].as_py()
            ids_a, comp_a, n_a, regs_a = _sketches(batch.column(1)[k].values)
            ids_b, comp_b, n_b, regs_b = (ids_a, comp_a, n_a, regs_a) if same else _sketches(batch.column(2)[k].values)
            shift = 0 if same else len(ids_a)
            parent, root = _forest(shift + len(ids_b))
            for i, found in _near_in_registers(regs_a, n_a, comp_a, regs_b, n_b, comp_b, same, percent, config):
                for j in found.tolist():
                    x, y = root(i), root(j + shift)
                    if x != y:
                        parent[y] = x
                        out_a.append(int(ids_a[i]))
                        out_b.append(int(ids_b[j]))
        return {"a": out_a, "b": out_b}

    return map_rows(tiles, run, "a bigint, b bigint", 1)


def _set_forest(tiles: DataFrame, percent: int, words: int, config: SketchConfig) -> DataFrame:
    """Of each pair of tiles, a spanning forest (a, b) of the links that join two components, by full sets."""

    def run(batch) -> dict:
        out_a, out_b = [], []

        def read(members):
            ids, comp, n, regs = _sketches(members)
            texts = members.flatten()[4].cast(pa.large_binary()).to_pylist()
            return ids, comp, n, regs, [shingle_set(t or b"", words) for t in texts]

        for k in range(batch.num_rows):
            same = batch.column(0)[k].as_py()
            ids_a, comp_a, n_a, regs_a, sets_a = read(batch.column(1)[k].values)
            ids_b, comp_b, n_b, regs_b, sets_b = (ids_a, comp_a, n_a, regs_a, sets_a) if same else read(batch.column(2)[k].values)
            shift = 0 if same else len(ids_a)
            parent, root = _forest(shift + len(ids_b))
            known: dict[int, int] = {}
            for i, comp in [*enumerate(comp_a.tolist()), *((j + shift, c) for j, c in enumerate(comp_b.tolist()) if not same)]:
                parent[i] = root(known.setdefault(comp, i))  # rows of a component are joined already
            for i, found in _near_in_registers(regs_a, n_a, comp_a, regs_b, n_b, comp_b, same, percent, config):
                for j in found.tolist():
                    x, y = root(i), root(j + shift)
                    if x != y and linked(sets_a[i], sets_b[j], percent):
                        parent[y] = x
                        out_a.append(int(ids_a[i]))
                        out_b.append(int(ids_b[j]))
        return {"a": out_a, "b": out_b}

    return map_rows(tiles, run, "a bigint, b bigint", 1)


def _with_texts(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of one document of every wanted set; texts are found by their hashes, whatever the doc_ids."""
    named = sets.join(wanted, "id", "left_semi").select("id", "t1", "t2")
    texts = docs.select("text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    return cut_lineage(texts.join(small(named), ["t1", "t2"]).groupBy("id").agg(F.first("text").alias("text")))


def _band_buckets(sets: DataFrame, config: SketchConfig) -> DataFrame:
    """id, key, m of every row that shares the registers of a band with another one."""
    band = lambda k: F.xxhash64(F.lit(k), F.substring("regs", 1 + 2 * config.rows * k, 2 * config.rows))
    keyed = sets.select("id", F.explode(F.array(*[band(k) for k in range(config.bands)])).alias("key"))
    common = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("key", "m")
    return cut_lineage(keyed.join(small(common, 1_000_000), "key"))


def _short_bands(rows: DataFrame, sets: DataFrame, config: SketchConfig) -> DataFrame:
    """Rows (id, key, m, comp) of large buckets in smaller ones: rows of a bucket with the same ``SHORT_BAND`` registers.

    A large bucket, as of texts that chance has linked by their fingerprints, is not compared pair by pair. Buckets
    of one component are left out.
    """
    part = lambda k: F.xxhash64("key", F.lit(k), F.substring("regs", 1 + 2 * SHORT_BAND * k, 2 * SHORT_BAND))
    parts = F.array(*[part(k) for k in range(config.registers // SHORT_BAND)])
    tall = rows.join(sets.select("id", "regs"), "id").select("id", "comp", F.explode(parts).alias("key"))
    mixed = tall.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key", "m")
    return cut_lineage(tall.join(small(cut_lineage(mixed), 1_000_000), "key").select("id", "key", "m", "comp"))


def set_links(docs: DataFrame, sets: DataFrame, percent: int, words: int, config: SketchConfig, rounds: int = 2, tile_rows: int = 1024, bucket: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all links between different sets.

    ``sets`` has id, n, regs and the hashes t1, t2 of one text each. In ``rounds`` rounds each bucket that still
    has several components compares its members with a pivot, which differs between rounds. What is still in
    several components after that meets in tiles, in buckets of more than ``DIRECT_ROWS`` rows only where a short band is equal. Buckets are those of the bands, or given: id, key and the
    number m of ids that have the key.
    """
    bucket = _band_buckets(sets, config) if bucket is None else bucket
    comp = sets.select("id", F.col("id").alias("comp"))
    edges = None
    for number in range(rounds):
        order = F.struct(F.xxhash64(F.lit(number), "id").alias("o"), F.col("id").alias("pivot"))
        placed = bucket.join(comp, "id")
        pivots = placed.groupBy("key").agg(F.min(order).alias("p"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key", F.col("p.pivot").alias("a"))
        heads = pivots.join(comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a")
        pairs = placed.join(heads, "key").where("comp <> ca").select("a", F.col("id").alias("b")).distinct()
        side = lambda s: sets.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("regs").alias(f"r{s}"))
        sized = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
        near = cut_lineage(_estimated(pairs.join(side("a"), "a").join(side("b"), "b").where(sized), percent, config))
        text = _with_texts(docs, sets, near.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        both = near.join(text.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").join(text.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
        true = cut_lineage(_verified(both.sortWithinPartitions("a"), percent, words))
        edges = true if edges is None else edges.unionByName(true)
        found = connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("comp_"))
        comp = cut_lineage(sets.select("id").join(found, "id", "left").select("id", F.coalesce("comp_", "id").alias("comp")))
    # A bucket of two has met its pivot; in larger ones, rows of different components may not have met.
    placed = bucket.where("m > 2").join(comp, "id")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
    met = cut_lineage(placed.join(mixed, "key").select("id", "key", "m", "comp"))
    large = met.where(F.col("m") > DIRECT_ROWS)
    if not large.isEmpty():
        met = met.where(F.col("m") <= DIRECT_ROWS).unionByName(_short_bands(large, sets, config))
    left = met.join(sets.select("id", "n", "regs"), "id")
    forest = cut_lineage(_register_forest(_pairs_of_tiles(left, ["key"], "m", tile_rows, ["id", "comp", "n", "regs"]), percent, config).distinct())
    group = connected_components(forest).select(F.col("node").alias("id"), F.col("component").alias("g"))
    group = cut_lineage(group.join(comp, "id"))
    sized = group.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("g", "m")
    open_ = cut_lineage(group.join(sized, "g"))
    text = _with_texts(docs, sets, open_.select("id"))
    rows = open_.join(text, "id").join(sets.select("id", "n", "regs"), "id")
    last = _set_forest(_pairs_of_tiles(rows, ["g"], "m", max(1, tile_rows // 4), ["id", "comp", "n", "regs", "text"]), percent, words, config)
    return edges.unionByName(last)


def distinct_sets(rows: DataFrame) -> DataFrame:
    """id (64 bits of the digest), s1, s2, first (least doc_id), t1, t2 (of one text), n, regs of every non-empty set of ``sketch_rows``."""
    whole = rows.where("s1 IS NOT NULL").groupBy("s1", "s2").agg(
        F.min("doc_id").alias("first"), F.min(F.struct("t1", "t2")).alias("t"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"))
    return cut_lineage(whole.select(F.xxhash64("s1", "s2").alias("id"), "s1", "s2", "first", F.col("t.t1").alias("t1"), F.col("t.t2").alias("t2"), "n", "regs"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85, config: SketchConfig = SketchConfig()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; links have 100 * intersection >= percent * union.

    Sets are the distinct shingles of ``words`` words of the whole text, A-Z lower-cased; fewer words are one
    shingle. Null, empty and blank texts have an empty set and are linked with nothing: their component_id is
    their own doc_id. component_id is the smallest doc_id of the component; null doc_ids do not count for it,
    and a component of null doc_ids only has none and keeps its rows. Repeated rows and equal sets are in one
    component. Every link is confirmed on the full sets; a link can be missed only if no band and no chain of
    other links joins its documents (see ``SketchConfig``). Other columns are not read; an empty table gives
    no rows.
    """
    rows = cut_lineage(sketch_rows(docs, config, words))
    sets = distinct_sets(rows)
    found = connected_components(set_links(docs, sets.select("id", "n", "regs", "t1", "t2"), percent, words, config))
    named = cut_lineage(sets.join(found.withColumnRenamed("node", "id"), "id", "left").select("s1", "s2", "first", F.coalesce("component", "id").alias("c")))
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    labels = named.join(least, "c").select("s1", "s2", "component_id")
    own = rows.where("s1 IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = rows.where("s1 IS NOT NULL").join(labels, ["s1", "s2"]).select("doc_id", "n_shingles", "component_id").unionByName(own)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
