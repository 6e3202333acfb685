"""Adjacent-contact pairs and re-referencing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecairn.functions.names import contact, shaft

REC = ["recording_id"]


def contact_pairs(channels: DataFrame) -> DataFrame:
    """Per shaft, every contact with the next present one (gaps are spanned).

    A window partition is one shaft of one recording.
    """
    named = channels.withColumn("shaft", shaft(F.col("channel"))).withColumn("contact", contact(F.col("channel")))
    spec = Window.partitionBy(*REC, "shaft").orderBy("contact", "ch_index")
    shaft_order = F.min("ch_index").over(Window.partitionBy(*REC, "shaft"))
    return (
        named.where(F.col("shaft").isNotNull())
        .select(
            *REC, "shaft", shaft_order.alias("shaft_order"), F.row_number().over(spec).alias("pos"),
            F.col("channel").alias("channel_a"), F.lead("channel").over(spec).alias("channel_b"),
            F.col("contact").alias("contact_a"), F.lead("contact").over(spec).alias("contact_b"),
        )
        .where(F.col("channel_b").isNotNull())
        .withColumn("label", F.concat("shaft", F.col("contact_a").cast("string"), F.lit("-"), F.col("contact_b").cast("string")))
    )


def apply_montage(values: DataFrame, pairs: DataFrame, key: str = "i", difference=None) -> DataFrame:
    """First contact minus second, labelled by the pair; pairs with a missing member drop out.

    Every contact is a member of at most two pairs, so samples are tagged with their pair and sign
    and the two sides meet in one grouped aggregate: one shuffle instead of a self join.
    ``values`` may hold single samples (key ``i``) or packed arrays (key ``block``).
    """
    spec = Window.partitionBy(*REC).orderBy("shaft_order", "pos")
    numbered = pairs.withColumn("pair_index", F.row_number().over(spec) - 1)
    members = numbered.select(
        *REC, "label", "pair_index",
        F.explode(F.array(F.struct(F.col("channel_a").alias("channel"), F.lit(True).alias("first")),
                          F.struct(F.col("channel_b").alias("channel"), F.lit(False).alias("first")))).alias("m"),
    ).select(*REC, "label", "pair_index", "m.channel", "m.first")
    difference = difference or (lambda a, b: a - b)
    if difference is aligned_difference:
        values = values.select(*REC, "channel", key, F.struct("i0", "v").alias("v"))
    carried = [c for c in ("i0", "own0") if c in values.columns]
    found = (
        values.join(members, [*REC, "channel"])
        .groupBy(*REC, "label", "pair_index", key)
        .agg(
            F.max(F.when(F.col("first"), F.col("v"))).alias("_a"), F.max(F.when(~F.col("first"), F.col("v"))).alias("_b"),
            F.count_if("first").alias("_na"), F.count_if(~F.col("first")).alias("_nb"),
            *[F.first(c).alias(c) for c in carried],
        )
        .where((F.col("_na") > 0) & (F.col("_nb") > 0))
        .select(
            *REC, F.col("label").alias("channel"), F.col("pair_index").cast("int").alias("ch_index"), key, *carried,
            difference(F.col("_a"), F.col("_b")).alias("v"),
        )
    )
    if difference is not aligned_difference:
        return found
    opened = found.select(*[c for c in found.columns if c != "v"], "v.i0", "v.v")
    return opened.where(F.size("v") > 0)


def array_difference(a, b):
    return F.zip_with(a, b, lambda x, y: x - y)


def aligned_difference(a, b):
    """Difference of arrays with their first places, where both have samples: struct (i0, v)."""
    begin = F.greatest(a["i0"], b["i0"])
    end = F.least(a["i0"] + F.size(a["v"]), b["i0"] + F.size(b["v"]))
    cut = lambda x: F.slice(x["v"], (begin - x["i0"] + 1).cast("int"), F.greatest(F.lit(0), end - begin).cast("int"))
    return F.struct(begin.alias("i0"), array_difference(cut(a), cut(b)).alias("v"))


def format_montage(pairs: DataFrame) -> DataFrame:
    """One text per recording: shaft headers with indented contact pairs."""
    line = F.concat(F.lit("  "), F.col("contact_a").cast("string"), F.lit("-"), F.col("contact_b").cast("string"))
    shafts = pairs.groupBy(*REC, "shaft", "shaft_order").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("pos", line.alias("line"))))["line"], "\n").alias("lines")
    )
    block = F.concat("shaft", F.lit(":\n"), F.col("lines"))
    return shafts.groupBy(*REC).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("shaft_order", block.alias("block"))))["block"], "\n").alias("montage")
    )


def pairs_touching(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pair labels with a known channel at either end: two equi joins instead of an OR join."""
    sides = [
        pairs.join(known.select(*REC, F.col("channel").alias(side)), [*REC, side], "left_semi").select(*REC, "label")
        for side in ("channel_a", "channel_b")
    ]
    return sides[0].unionByName(sides[1]).distinct()
