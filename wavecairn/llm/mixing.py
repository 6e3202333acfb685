"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecairn.llm.common import inputs, n_words, unit_hash
from wavecairn.session import cut_lineage

_EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target of every source from (source, source_size): weights by code point order, null last.

    All targets share ``share`` times the total. A target stops at ``most`` times its source; the excess is
    shared again by weight until none is above. That ends at min(most * size, level * weight) with one
    common level, found by one running sum over the sources in the order in which they stop. The table has
    one row per source, not per document. Sources without words get 0.
    """
    if most < share:
        raise ValueError("the sources cannot hold that share")
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    left = total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = left / F.sum("_weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # The first source that stays below its cap sets the level for all that follow.
    stops = F.col("_cap") <= F.col("_level") * F.col("_weight")
    common = F.min(F.when(~stops, F.struct("_place", "_level"))).over(everything)["_level"]
    return (
        ranked.withColumn("_level", level).withColumn("_place", F.row_number().over(order)).withColumn("_common", common)
        .select("source", "source_size", F.when(stops | F.col("_common").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_common") * F.col("_weight"))).alias("target"))
    )


def pivot(p: list[float], size: list[int], draw: list[float]) -> list[float]:
    """Fractional copies made integral pair by pair, at most one stays; the sum of size * p does not change.

    The pair moves words from one to the other until one is 0 or 1, in either direction with the
    probability that keeps each expected value. Documents without words are drawn on their own.
    """
    out, held = list(p), -1
    for k in range(len(out)):
        if not _EPS < out[k] < 1 - _EPS:
            out[k] = float(round(out[k]))
            continue
        if size[k] == 0:
            out[k] = float(draw[k] < out[k])
            continue
        if held < 0:
            held = k
            continue
        a, b = size[held], size[k]
        up = min(a * (1 - out[held]), b * out[k])  # words that can go to the held document
        down = min(a * out[held], b * (1 - out[k]))
        moved = up if draw[k] * (up + down) < down else -down
        out[held] += moved / a
        out[k] -= moved / b
        open_ = []
        for j in (held, k):
            if _EPS < out[j] < 1 - _EPS:
                open_.append(j)
            else:
                out[j] = float(round(out[j]))
        held = open_[0] if open_ else -1
    return out


def round_copies(items: DataFrame, rows_per_task: int = 4096, fan_in: int = 64) -> DataFrame:
    """``p`` of (source, doc_id, size, p) made 0 or 1, with the words of each source kept to within one document.

    A source is dealt to groups of about ``rows_per_task`` rows by doc_id and size, so a source with a third of all
    rows is many tasks. Each group leaves one open document at most; those meet in groups of ``fan_in`` on
    the next level of the tree, until each source has one, which is drawn. Draws are hashes of doc_id and
    level, so reruns agree. Repeated rows are separate documents.
    """
    counts = items.groupBy(F.col("source").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    groups = F.ceil(F.col("_n") / F.lit(rows_per_task)).cast("bigint")
    rows = items.join(counts, F.col("source").eqNullSafe(F.col("_of"))).select(
        "source", "doc_id", "size", "p", F.pmod(F.xxhash64("doc_id", "size", F.lit(7)), groups).alias("_group"),
    )
    most = counts.agg(F.max("_n")).first()[0] or 0
    width, level, decided = max(1, -(-most // rows_per_task)), 0, []

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "doc_id"], ascending=[False, True])
        return frame.assign(p=pivot(frame["p"].tolist(), frame["size"].tolist(), frame["_draw"].tolist()))

    schema = "source string, doc_id bigint, size bigint, p double, _group bigint, _draw double"
    while True:
        drawn = rows.withColumn("_draw", unit_hash("doc_id", F.lit(f"level {level}")))
        settled = cut_lineage(drawn.groupBy("source", "_group").applyInPandas(settle, schema))
        open_ = F.col("p").between(_EPS, 1 - _EPS)
        decided.append(settled.where(~open_))
        rest = settled.where(open_).drop("_draw")
        if width == 1:
            last = rest.withColumn("p", (unit_hash("doc_id", F.lit("last")) < F.col("p")).cast("double"))
            break
        width, level = -(-width // fan_in), level + 1
        rows = rest.withColumn("_group", F.floor(F.col("_group") / fan_in) if width > 1 else F.lit(0).cast("bigint"))
    out = last.select("source", "doc_id", "size", "p")
    for part in decided:
        out = out.unionByName(part.select("source", "doc_id", "size", "p"))
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, size: Column | None = None) -> DataFrame:
    """Copies of every document: doc_id, source, size, source_size, target, copies, taken.

    Each document is expected target / source_size times: the whole part for certain, the fraction by
    dependent rounding, so a source's words differ from its target by less than one document. Null texts
    have no words; an empty table gives no rows; repeated rows are counted and mixed as separate rows.
    """
    plain = inputs(docs, doc_id="doc_id", source="source", text="text")
    rows = cut_lineage(plain.select("doc_id", "source", (n_words(F.col("text")) if size is None else size).alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut_lineage(source_targets(sizes, weights, share, most)).withColumnRenamed("source", "_source")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    known = targets.withColumn("_ratio", ratio).withColumn("_whole", F.floor(F.col("_ratio") + _EPS))
    fraction = F.greatest(F.col("_ratio") - F.col("_whole"), F.lit(0.0))
    items = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).select("source", "doc_id", "size", fraction.alias("p"))
    rounded = round_copies(items)
    copies = (F.col("_whole") + F.col("p")).cast("bigint")
    return rounded.join(known, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns.

    Rows of one doc_id that are repeated in the input share their copies evenly, the first ones getting
    what remains, so nothing is multiplied by the repetition.
    """
    copies = mix(docs, **options).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_of"), F.col("size").alias("_size")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    key = [F.col("doc_id"), F.col("source"), n_words(F.col("text"))]
    single = docs.withColumns({"_d": key[0], "_s": key[1], "_w": key[2]})
    joined = single.join(copies, F.expr("_d <=> _id AND _s <=> _of AND _w = _size"))
    once = joined.where("_rows = 1")
    several = joined.where("_rows > 1").withColumn("_n", F.row_number().over(Window.partitionBy("_d", "_s", "_w").orderBy("text")))
    times = {"once": F.col("_copies"), "several": F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_n") <= F.col("_copies") % F.col("_rows")).cast("bigint")}
    names = docs.columns
    parts = [d.withColumn("_t", F.explode(F.array_repeat(F.lit(1), t.cast("int")))).select(*[F.col(f"`{n}`") for n in names]) for d, t in ((once, times["once"]), (several, times["several"]))]
    return parts[0].unionByName(parts[1])
