"""SimHash near-duplicates: fingerprints of word shingles, compared exactly by parts of 16 bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecairn.llm import setsketch
from wavecairn.llm.common import column, inputs, map_rows, raw_texts
from wavecairn.llm.components import connected_components, settle
from wavecairn.session import cut_lineage


def fingerprint(data: bytes, words: int = 4, seed: int = 42) -> int:
    """64 bits by majority over the XXH64 of all word shingles, repeats included; a text without words is 0."""
    import xxhash

    parts = data.lower().split()  # bytes: A-Z only, and white space is U+0020 and U+0009 to U+000D
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    digest = xxhash.xxh64_intdigest
    ends = [e + k for k, e in enumerate(accumulate(map(len, parts)))]
    starts = [0, *[e + 1 for e in ends[: len(parts) - words]]]
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :])], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text, row by row."""

    def run(batch) -> dict:
        values = np.array([fingerprint(x, words, seed) for x in raw_texts(batch)], dtype=np.uint64)
        return {"doc_id": column(batch, "doc_id"), "fp": values.view(np.int64)}

    return map_rows(inputs(docs, doc_id="doc_id", text="text"), run, "doc_id bigint, fp bigint")


#: Fingerprints that a unit of comparison takes in as its rows at most, and those that they meet.
CHUNK_ROWS, BLOCK_ROWS = 65_536, 262_144
#: Tasks of a comparison at most; beyond that a task takes several units, one after the other.
MOST_TASKS = 10_000
#: Candidate pairs that are held at once.
HELD_PAIRS = 1 << 17


def reaches(radius: int) -> list[int]:
    """How many bits each of the four 16-bit parts may differ by, so that two values within ``radius`` bits meet in one part.

    If every part differed by more than its reach, at least radius + 1 bits would differ; a part of reach -1 is not asked.
    """
    return [(radius + 1) // 4 - 1 + (part < (radius + 1) % 4) for part in range(4)]


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of all pairs at most ``radius`` bits apart, some more than once, a bounded number at a time.

    ``b`` is listed by its parts of 16 bits; a value of ``a`` looks up the parts within its reach and is compared with
    what is listed there: 1.7 % of all pairs at 12 bits if the values are evenly spread.
    """
    for part, reach in enumerate(reaches(radius)):
        keys = [((v >> np.uint64(16 * part)) & np.uint64(0xFFFF)).astype(np.uint16) for v in (a, b)]
        of_a, of_b = (np.argsort(k, kind="stable") for k in keys)
        sorted_a, sorted_b, key = a[of_a], b[of_b], keys[0][of_a].astype(np.int64)
        counts = np.bincount(keys[1], minlength=1 << 16)
        begins = np.cumsum(counts) - counts
        for flips in (sum(1 << k for k in bits) for n in range(reach + 1) for bits in combinations(range(16), n)):
            there = counts[key ^ flips]
            asking = np.flatnonzero(there)
            if not len(asking):
                continue
            n, begin = there[asking], begins[key[asking] ^ flips]
            ends = np.cumsum(n)
            borders = np.searchsorted(ends, np.arange(HELD_PAIRS, ends[-1] + HELD_PAIRS, HELD_PAIRS)) + 1
            low = 0
            for high in np.unique(np.minimum(borders, len(asking))).tolist():
                first = ends[low:high] - n[low:high]
                which = np.repeat(np.arange(high - low), n[low:high])
                right = np.arange(len(which)) + (begin[low:high] - first + first[0])[which]
                left = asking[low:high][which]
                near = np.flatnonzero(np.bitwise_count(sorted_a[left] ^ sorted_b[right]) <= radius)
                if len(near):
                    yield of_a[left[near]], of_b[right[near]]
                low = high


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles (or within one, if they are equal) at most ``radius`` bits apart, as a spanning forest.

    The forest has fewer links than values, however many pairs are close.
    """
    values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(values))
    near_i, near_j, held = [], [], 0
    for i, j in close_pairs(a, b, radius):
        near_i.append(place[i])
        near_j.append(place[j + len(a)])
        held += len(i)
        if held > 1 << 20:
            settle(parent, np.concatenate(near_i), np.concatenate(near_j))
            near_i, near_j, held = [], [], 0
    if held:
        settle(parent, np.concatenate(near_i), np.concatenate(near_j))
    child = np.flatnonzero(parent != np.arange(len(parent)))
    return values[child], values[parent[child]]


def links(fps: DataFrame, radius: int = 4, chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) whose components are those of "at most ``radius`` bits apart" over distinct ``fp``.

    Fingerprints are dealt into chunks by a hash, some 48 at least once there are enough, and chunks into blocks. A
    unit is one chunk and the chunks of one block that it meets; every two chunks meet in one unit, each with itself too. So
    the work is quadratic in the distinct fingerprints, divided by what ``close_pairs`` leaves out. Arrays are copied
    to the units by one exchange with as many partitions as units: nothing is broadcast, whatever sizes Spark would
    expect of copied arrays.
    """
    n = fps.count()
    size = min(chunk_rows, max(2_048, -(-n // 48)))
    chunks, per = max(1, -(-n // size)), max(1, block_rows // size)
    blocks = -(-chunks // per)
    chunk = F.pmod(F.xxhash64("fp"), F.lit(chunks)).cast("bigint")
    tiles = cut_lineage(fps.groupBy(chunk.alias("c")).agg(F.collect_list("fp").alias("fps")))
    block = lambda c: F.floor(c / F.lit(per)).cast("bigint")
    whole = lambda x: F.lit(x).cast("bigint")
    own = tiles.select("c", "fps", F.explode(F.sequence(block(F.col("c")), whole(blocks - 1))).alias("j"))
    own = own.select((F.col("c") * blocks + F.col("j")).alias("unit"), F.lit(0).alias("role"), "fps")
    last = F.least(whole(chunks - 1), (block(F.col("c")) + 1) * per - 1)
    met = tiles.select("c", "fps", F.explode(F.sequence(whole(0), last)).alias("x"))
    # Of two chunks of one block, the one that takes the other in alternates, which keeps the units even.
    turn = (F.col("x") == F.col("c")) | ((F.col("x") < F.col("c")) == ((F.col("x") + F.col("c")) % 2 == 1))
    met = met.where((block(F.col("x")) < block(F.col("c"))) | turn)
    met = met.select((F.col("x") * blocks + block(F.col("c"))).alias("unit"), F.lit(1).alias("role"), "fps")
    units = sum(blocks - c // per for c in range(chunks))
    dealt = own.unionByName(met).repartition(min(units, MOST_TASKS), "unit").sortWithinPartitions("unit", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, others = None, None, []

        def compared() -> pa.RecordBatch:
            found = tile_links(rows, np.concatenate(others), radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], names=["a", "b"])

        for batch in batches:
            lists = column(batch, "fps")
            for k, (number, role) in enumerate(zip(column(batch, "unit").to_pylist(), column(batch, "role").to_pylist())):
                values = lists[k].values.to_numpy().view(np.uint64)
                if number != unit:
                    if others:
                        yield compared()
                    unit, rows, others = number, None, []
                if role:
                    others.append(values)
                else:
                    rows = values
        if others:
            yield compared()

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) of every row.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows stay. Null doc_ids
    do not count for the smallest one. An empty table gives no rows.
    """
    marked = cut_lineage(fingerprints(docs, words, seed))
    single = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = connected_components(links(single.select("fp"), radius))
    member = cut_lineage(found.join(single.withColumnRenamed("fp", "node"), "node"))
    groups = member.groupBy("component").agg(F.min("first").alias("smallest"))
    linked = member.join(groups, "component").select(F.col("node").alias("fp"), "smallest")
    labels = single.join(linked, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id"))
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def verified_duplicates(docs: DataFrame, words: int = 5, radius: int = 12, percent: int = 80, seed: int = 42) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text), group of every row: near copies by fingerprint, confirmed on full sets.

    Texts whose fingerprints are joined by steps of at most ``radius`` bits are candidates; those with a
    Jaccard similarity of ``percent`` / 100 or more over their sets of ``words`` words are linked, and a group is
    what links join. Texts without words are one group. Rows are told apart by doc_id and text, so unlike
    texts under one doc_id stay apart. An empty table gives no rows.
    """
    config = setsketch.SketchConfig()
    rows = cut_lineage(setsketch.sketch_rows(docs, config, words))
    sets = setsketch.distinct_sets(rows)
    slim = docs.select("text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))

    def run(batch) -> dict:
        values = np.array([fingerprint(x, words, seed) for x in raw_texts(batch)], dtype=np.uint64)
        return {"t1": column(batch, "t1"), "t2": column(batch, "t2"), "fp": values.view(np.int64)}

    prints = map_rows(slim, run, "t1 bigint, t2 bigint, fp bigint").distinct()
    marked = cut_lineage(sets.select("id", "t1", "t2").join(prints, ["t1", "t2"]).select("id", "fp"))
    near = connected_components(links(marked.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    placed = marked.join(near, "fp", "left").select("id", F.coalesce("component", "fp").alias("key"))
    several = placed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    bucket = cut_lineage(placed.join(several, "key"))
    found = connected_components(setsketch.set_links(docs, sets.select("id", "n", "regs", "t1", "t2"), percent, words, config, bucket=bucket))
    named = sets.join(found.withColumnRenamed("node", "id"), "id", "left").select("s1", "s2", F.coalesce("component", "id").alias("group"))
    full = rows.where("s1 IS NOT NULL").join(named, ["s1", "s2"]).select("doc_id", "t1", "t2", "group")
    return full.unionByName(rows.where("s1 IS NULL").select("doc_id", "t1", "t2", F.lit(None).cast("bigint").alias("group")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of ``verified_duplicates``: the smallest doc_id (null last), then text hash."""
    found = cut_lineage(verified_duplicates(docs, **options))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    head = cut_lineage(found.groupBy("group").agg(F.min(order).alias("h")).select("h.doc_id", "h.t1", "h.t2"))
    counted = found.groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("_copies"))
    kept = cut_lineage(head.join(counted.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "t1", "t2")], "_copies"), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))).select("_doc_id", "_t1", "_t2", "_copies"))
    names = docs.columns
    named = docs.withColumns({"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(1), "text")})
    joined = named.join(kept, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_h1") == F.col("_t1")) & (F.col("_h2") == F.col("_t2")))
    # Equal rows are told apart by nothing: one of them is taken. They are rare, so only they are grouped.
    repeated = joined.where("_copies > 1").dropDuplicates(["_doc_id", "_t1", "_t2"])
    return joined.where("_copies = 1").unionByName(repeated).select(*[F.col(f"`{c}`") for c in names])
