"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Two lines within an edit distance of t share, unchanged up to a shift, at least one of t+1 segments. Lines
are indexed by their segments and probe those of lines as long as they are or up to t shorter, at the few
positions that a match can have. Keys are hashes; texts move only for lines that share a key with another
line. The lines of a key are linked with pivots first; only lines that then still lie in different components
are compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecairn.llm.common import small
from wavecairn.llm.components import connected_components
from wavecairn.session import cut_lineage

#: (shorter line's code points from, edits): about one edit for every 50 code points, so that short lines stay apart.
PRODUCTION = ((20, 1), (60, 2), (120, 3), (200, 4))


def segment(goal: Column, i: Column, t: Column) -> tuple[Column, Column]:
    """First place (from 0) and length of segment i of the t+1 even segments of a line of length ``goal``."""
    begin, end = (F.floor(goal * k / (t + 1)).cast("int") for k in (i, i + 1))
    return begin, end - begin


def probes(t: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift): where the segment of a line that is shorter by the difference can be.

    Edits left of segment i are at most i, those right of it at most t - i. The first t+1 are the line's own
    segments, which are its index entries as well.
    """
    found = [(d, i, o) for d in range(t + 1) for i in range(t + 1) for o in range(-i, i + 1) if d - (t - i) <= o <= d + t - i]
    return sorted(found, key=lambda p: (p[0] != 0 or p[2] != 0, p))


def ranges(classes: tuple[tuple[int, int], ...], below: int | None = None) -> list[tuple[int, int, int]]:
    """(least, most, t) of every class: the code points that a pair's shorter line has, and its edits."""
    ends = [*[least for least, _ in classes[1:]], below or 1 << 31]
    return [(least, end - 1, t) for (least, t), end in zip(classes, ends)]


def _table(size: Column, classes: list[tuple[int, int, int]]) -> Column:
    """What a line of ``size`` probes for, as an array of structs (t, least, most, d, i, o): one small expression a row for any t.

    A line longer than a class by up to t probes for its lines too, so near a border there are the probes of two classes.
    """
    found = F.when(F.lit(False), F.array(_probe(classes[0], (0, 0, 0))))
    for border in sorted({least for least, _, _ in classes} | {most + t + 1 for _, most, t in classes}, reverse=True):
        here = [c for c in classes if c[0] <= border <= c[1] + c[2]]
        if here:
            found = found.when(size >= border, F.array(*[_probe(c, p) for c in here for p in probes(c[2])]))
        else:
            found = found.when(size >= border, F.lit(None))
    return found


def _probe(kind: tuple[int, int, int], p: tuple[int, int, int]) -> Column:
    least, most, t = kind
    return F.struct(*[F.lit(v).alias(c) for c, v in zip(("t", "least", "most", "d", "i", "o"), (t, least, most, *p))])


def _hash(group: Column, text: Column, goal: Column, i: Column, shift: Column, t: Column) -> Column:
    """Hash of the segment at its shifted place."""
    begin, length = segment(goal, i, t)
    return F.xxhash64(group, i, goal, F.substr(text, begin + shift + 1, length))


def _inside(size: Column, goal: Column, i: Column, shift: Column, t: Column) -> Column:
    """Whether the segment at its shifted place lies inside the line; told before any text is cut or hashed."""
    begin, length = segment(goal, i, t)
    return (begin + shift >= 0) & (begin + shift + length <= size)


def segment_keys(lines: DataFrame, classes: list[tuple[int, int, int]]) -> DataFrame:
    """All keys of (line, text) for the ``ranges`` of classes: line, t, own (a segment of the line itself), key.

    The class follows from the length in the key, so one pass makes the keys of all classes, and none of two
    classes are equal. The row-wise work is kept small.
    """
    tall = lines.withColumn("size", F.length("text")).select("line", "text", "size", F.explode(_table(F.col("size"), classes)).alias("p"))
    goal, place = F.col("size") - F.col("p.d"), (F.col("p.i"), F.col("p.o"), F.col("p.t"))
    tall = tall.where(goal.between(F.col("p.least"), F.col("p.most")) & _inside(F.col("size"), goal, *place))
    key = _hash(F.lit(0), F.col("text"), goal, *place)
    return tall.select("line", F.col("p.t").alias("t"), ((F.col("p.d") == 0) & (F.col("p.o") == 0)).alias("own"), key.alias("key"))


def _near() -> Column:
    """Within ``t`` edits, with the same digits in order: what is cheap is asked first."""
    return (F.abs(F.length("x") - F.length("y")) <= F.col("t")) & (F.col("dx") == F.col("dy")) & (F.expr("levenshtein(x, y, t)") >= 0)


def _side(texts: DataFrame, line: str, text: str, digits: str) -> DataFrame:
    return texts.select(F.col("line").alias(line), F.col("text").alias(text), F.col("digits").alias(digits))


def _labels(texts: DataFrame, links: DataFrame) -> DataFrame:
    """(line, comp) of every line of ``texts``."""
    found = connected_components(links, native=True).select(F.col("node").alias("line"), F.col("component").alias("c"))
    return cut_lineage(texts.select("line").join(found, "line", "left").select("line", F.coalesce("c", "line").alias("comp")))


def edit_links(lines: DataFrame, t: int = 1, least: int = 20, below: int | None = None, rounds: int = 2, pair_rows: int = 256) -> DataFrame:
    """``class_links`` of one class: lines of ``least`` code points or more, the shorter of a pair under ``below``."""
    return _links(lines, ranges(((least, t),), below), rounds, pair_rows)


#: The weight of an own key in the sum that counts a key's lines.
OWN = 1 << 32


def _links(lines: DataFrame, classes: list[tuple[int, int, int]], rounds: int, pair_rows: int = 256) -> DataFrame:
    """All classes at once; see ``class_links``.

    Keys of one line that comes twice are let through here: they link nothing. So the key and a count are all that is shuffled.
    """
    keyed = segment_keys(lines, classes)
    weight = F.when(F.col("own"), F.lit(OWN + 1)).otherwise(F.lit(1).cast("bigint"))
    shared = cut_lineage(keyed.groupBy("key").agg(F.sum(weight).alias("n")).where((F.col("n") >= OWN) & (F.col("n") % OWN > 1)).select("key"))
    hits = cut_lineage(keyed.join(small(shared, 1_000_000), "key").groupBy("key", "line").agg(F.max("own").alias("own"), F.max("t").alias("t")))
    wanted = hits.select("line").distinct()
    digits = F.regexp_replace("text", r"[^0-9]+", "")
    texts = cut_lineage(lines.join(small(wanted, 1_000_000), "line", "left_semi").groupBy("line").agg(F.first("text").alias("text")).withColumn("digits", digits))
    comp = texts.select("line", F.col("line").alias("comp"))
    found = None
    for number in range(rounds):
        placed = hits.join(comp, "line")
        order = F.struct(F.xxhash64(F.lit(number), "line").alias("o"), F.col("line").alias("a"), F.col("comp").alias("ca"))
        pivots = placed.groupBy("key").agg(F.min(order).alias("p"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key", "p.a", "p.ca")
        pairs = placed.join(pivots, "key").where("comp <> ca").groupBy("a", F.col("line").alias("b")).agg(F.max("t").alias("t"))
        true = pairs.join(_side(texts, "b", "y", "dy"), "b").join(_side(texts, "a", "x", "dx"), "a").where(_near()).select("a", "b")
        true = cut_lineage(true)
        found = true if found is None else found.unionByName(true)
        comp = _labels(texts, found)
    rest = _rest_links(hits, texts, comp, pair_rows, 2 if rounds else 1)
    return (rest if found is None else found.unionByName(rest)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rest_links(hits: DataFrame, texts: DataFrame, comp: DataFrame, pair_rows: int, met: int) -> DataFrame:
    """Links between lines of different components that share a key, index side against probe side.

    Of keys with the same lines only one is kept. Keys of at most ``met`` lines
    have been compared. A key's lines are cut into chunks of about ``pair_rows`` by a
    hash, and chunks meet by their numbers; the edit distance is part of that join, which leaves near pairs only.
    """
    placed = hits.join(comp, "line")
    mixed = placed.groupBy("key").agg(
        F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("line", "own").cast("decimal(38,0)")).alias("set"), F.bit_xor(F.xxhash64(F.lit(1), "line", "own")).alias("set2"),
    ).where(f"c0 <> c1 AND m > {met}")
    single = cut_lineage(mixed.groupBy("set", "set2", "m").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("m") / F.lit(pair_rows)).cast("bigint").alias("chunks")))
    rows = cut_lineage(placed.join(small(single, 1_000_000), "key").withColumn("chunk", F.pmod(F.xxhash64("line"), F.col("chunks"))))
    full = rows.join(texts, "line")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
    a = full.where("own").withColumn("other", every).select("key", F.col("chunk").alias("ka"), F.col("other").alias("kb"), F.col("line").alias("a"), "t", F.col("comp").alias("ca"), F.col("text").alias("x"), F.col("digits").alias("dx"))
    b = full.withColumn("other", every).select(F.col("key").alias("k"), F.col("other").alias("la"), F.col("chunk").alias("lb"), F.col("line").alias("b"), F.col("comp").alias("cb"), F.col("text").alias("y"), F.col("digits").alias("dy"))
    together = (F.col("key") == F.col("k")) & (F.col("ka") == F.col("la")) & (F.col("kb") == F.col("lb")) & (F.col("ca") != F.col("cb"))
    return cut_lineage(a.join(b, together & _near()).select("a", "b"))


def class_links(lines: DataFrame, classes: tuple[tuple[int, int], ...], rounds: int = 0) -> DataFrame:
    """Links (a, b) of lines near each other and with the same digits in order; the shorter line of a pair decides how near.

    ``classes`` are (least code points, edits), ascending; shorter lines take no part. ``lines`` has line (a hash of
    the text) and text, occurrences included. All links are found unless ``rounds`` of pivots are asked for: then
    links with the same components. In each round the lines of each key are compared with one of them, a pivot that
    changes from round to round. So a ball of near lines gives a link for each line, and no pair of it is formed.
    Lines that lie in different components after that meet once for each pair of lines, however many keys they share.
    """
    return _links(lines, ranges(classes), rounds)


def occurrences(docs: DataFrame) -> DataFrame:
    """Every line that is not blank: doc, version (hash of the text), place, line, line2 (hashes), text of the line."""
    tall = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("place", "text"))
    return tall.where(F.trim("text") != "").select("doc", "version", "place", F.xxhash64("text").alias("line"), F.xxhash64(F.lit(1), "text").alias("line2"), "text")


def firsts(docs: DataFrame, listed: DataFrame, single: DataFrame) -> DataFrame:
    """(line, text) of every line that is not blank, read at its first place only: the keys of repeats are never made.

    ``listed`` are all places, ``single`` the first of each line. Rows with equal doc_id and text are both read.
    """
    here = F.struct("doc", "version", "place")
    again = listed.join(single.where("n > 1").select("line", "line2", "first"), ["line", "line2"]).where(here != F.col("first"))
    repeats = cut_lineage(again.groupBy("doc", "version").agg(F.collect_set("place").alias("places")))
    base = docs.select("doc_id", F.xxhash64("text").alias("_version"), F.split("text", "\n").alias("_lines")).where("_lines IS NOT NULL")
    joined = base.join(small(repeats, 8_000_000, F.size("places") + 16), F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("_version") == F.col("version")), "left")
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    kept = F.when(F.col("places").isNull(), F.col("_lines")).otherwise(F.transform(F.array_except(every, F.col("places")), lambda k: F.get("_lines", k)))
    return joined.select(F.explode(kept).alias("text")).where(F.trim("text") != "").select(F.xxhash64("text").alias("line"), "text")


def line_drops(docs: DataFrame, t: int = 1, least: int = 20, classes: tuple[tuple[int, int], ...] | None = None) -> DataFrame:
    """Places to drop per document: doc, version, places, n_exact, n_near."""
    spread = occurrences(docs)
    listed = cut_lineage(spread.drop("text"))
    here = F.struct("doc", "version", "place")
    single = cut_lineage(listed.groupBy("line", "line2").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")))
    classes = connected_components(class_links(firsts(docs, listed, single), classes or ((least, t),), rounds=2), native=True).withColumnRenamed("node", "line")
    named = single.join(classes, "line", "left").withColumns({
        "c1": F.coalesce("component", "line"), "c2": F.when(F.col("component").isNull(), F.col("line2")).otherwise(F.lit(0))})
    kept = named.where("component IS NOT NULL OR n > 1")
    heads = kept.groupBy("c1", "c2").agg(F.min(F.struct("first", "line", "line2")).alias("head"))
    several = cut_lineage(kept.join(heads, ["c1", "c2"]).select("line", "line2", F.col("head.first").alias("keep"), ((F.col("head.line") != F.col("line")) | (F.col("head.line2") != F.col("line2"))).alias("near")))
    dropped = listed.join(several, ["line", "line2"]).where(here != F.col("keep"))
    return cut_lineage(
        dropped.groupBy("doc", "version").agg(F.collect_set("place").alias("places"), F.sum((~F.col("near")).cast("int")).alias("n_exact"), F.sum(F.col("near").cast("int")).alias("n_near"))
    )


def dedup_lines(docs: DataFrame, t: int = 1, least: int = 20, classes: tuple[tuple[int, int], ...] | None = None) -> DataFrame:
    """``docs`` with the text's repeated lines taken out, and n_lines, n_exact, n_near added.

    Lines end at a line feed. Of equal lines, and of lines joined by links of at most ``t`` edits with the
    same digits (both of ``least`` code points or more), the first one stays. ``classes``, as ``PRODUCTION``,
    stands instead of ``t`` and ``least``: edits by the length of the shorter line. First is: smallest doc_id (null first),
    then text hash, then place. Blank lines stay. A text may become empty; null texts stay null with
    0 lines. Rows with equal doc_id and text are one document and keep the same lines. An empty table gives
    no rows. n_lines counts all lines of the text, n_exact those that equal the kept line, n_near the others.
    """
    drops = line_drops(docs, t, least, classes)
    names = docs.columns
    base = docs.withColumns({"_version": F.xxhash64("text"), "_lines": F.split("text", "\n")})
    # Measured in places of 4 bytes, a row counting as 16: at most 32 MB are broadcast.
    joined = base.join(small(drops, 8_000_000, F.size("places") + 16), F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("_version") == F.col("version")), "left")
    size = F.size("_lines")
    rest = F.array_except(F.sequence(F.lit(0), size - 1), F.col("places"))
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(F.transform(rest, lambda k: F.get("_lines", k)), "\n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return joined.select(
        *[text.alias("text") if n == "text" else F.col(f"`{n}`") for n in names],
        zero(F.when(F.col("text").isNotNull(), size)).alias("n_lines"), zero(F.col("n_exact")).alias("n_exact"), zero(F.col("n_near")).alias("n_near"),
    )
