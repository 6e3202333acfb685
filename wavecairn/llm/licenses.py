"""License scans: TF-IDF cosine of headers and licence files to templates, inherited down the directories."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecairn.llm.license_texts import TEMPLATES
from wavecairn.session import cut_lineage

#: Fixed value: names of licence files.
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Ends of a piece: line breaks and ends of sentences.
PIECE_END = r"[.;:][ \t\r\n]+|[\r\n]+"


def terms(text: Column) -> Column:
    """Lower-case words and numbers with inner dots and hyphens (``2.0``, ``by-nc``); null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def name_of(text: Column) -> Column:
    """MD5 of a text as 16 bytes: the key that travels with its terms, half as long as in digits."""
    return F.unhex(F.md5(text))


def folder(path: Column) -> Column:
    """The path without its last part; empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """How often every text has every term; only the key travels with the terms."""
    return rows.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def weighted_templates(counted: DataFrame, total: int, least: float, templates: list[tuple[str, str]]) -> DataFrame:
    """The templates' vectors: t, licence, term, v (of length 1), others (templates with the term), anchor.

    The anchors of a template are its heaviest terms, as many as leave a rest shorter than ``least``: a text
    without any of them has a smaller cosine. Its size is that of the templates.
    """
    spark = counted.sparkSession
    kinds = spark.createDataFrame([(t, text) for t, (_, text) in enumerate(templates)], "t int, text string")
    own = _counts(kinds, "t", "text")
    rows = own.join(counted, "term", "left").select("t", "term", "tf", F.coalesce("n", F.lit(0)).alias("n")).collect()
    others, vectors = defaultdict(int), defaultdict(list)
    for r in rows:
        others[r["term"]] += 1
    for r in rows:
        vectors[r["t"]].append((r["tf"] * math.log1p(total / (r["n"] + others[r["term"]])), r["term"]))
    out = []
    for t, vector in vectors.items():
        squares = sum(w * w for w, _ in vector)
        rest = squares
        for w, term in sorted(vector, key=lambda p: (-p[0], p[1])):
            out.append((t, templates[t][0], term, w / math.sqrt(squares), others[term], rest >= (least - 1e-6) ** 2 * squares))
            rest -= w * w
    return spark.createDataFrame(out, "t int, licence string, term string, v double, others int, anchor boolean")


def _vectors(rows: DataFrame, key: str, text: str, weights: DataFrame) -> DataFrame:
    """key, term, w = count * ln(1 + N / files with the term)."""
    return _counts(rows, key, text).join(weights, "term").select(key, "term", (F.col("tf") * F.col("weight")).alias("w"))


def headers(pieces: DataFrame, weights: DataFrame, kinds: DataFrame, cover: float) -> DataFrame:
    """Passages that look like a template: h, passage.

    A passage is a longest run of pieces (consecutive lines and sentences; those without a term do not count)
    of which each has at least ``cover`` of its squared weight in terms of the template, one of them an anchor.
    Equal pieces are weighed once.
    """
    held = pieces.withColumn("u", name_of(F.col("piece")))
    vectors = cut_lineage(_vectors(held.groupBy("u").agg(F.first("piece").alias("piece")), "u", "piece", weights))
    length = vectors.groupBy("u").agg(F.sum(F.col("w") * F.col("w")).alias("all"))
    shared = vectors.join(F.broadcast(kinds), "term").groupBy("u", "t").agg(F.sum(F.col("w") * F.col("w")).alias("part"), F.max("anchor").alias("anchor"))
    near = cut_lineage(shared.join(length, "u").where(F.round(F.col("part") / F.col("all"), 9) >= cover).select("u", "t", "anchor"))
    placed = held.join(near, "u").withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("h", "t").orderBy("pos")))
    runs = placed.groupBy("h", "t", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"), F.max("anchor").alias("anchor"))
    return runs.where("anchor").select("h", F.array_join("p.piece", " ").alias("passage"))


def best_cosines(passages: DataFrame, weights: DataFrame, kinds: DataFrame) -> DataFrame:
    """Best licence of every distinct passage: pid, licence, cosine, shared (cosine times the passage's length), 6 digits. Ties take the first name."""
    vectors = cut_lineage(_vectors(passages.groupBy("pid").agg(F.first("passage").alias("passage")), "pid", "passage", weights))
    length = vectors.groupBy("pid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = vectors.join(F.broadcast(kinds), "term").groupBy("pid", "t", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(length, "pid").select("pid", "licence", F.round(F.col("dot") / F.col("length"), 6).alias("cosine"), F.round("dot", 6).alias("shared"))
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "licence", "shared")).alias("b")
    return scored.groupBy("pid").agg(best).select("pid", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"), "b.shared")


def text_licenses(files: DataFrame, least: float = 0.75, cover: float = 0.5, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Licences of the texts that come near a template: h (MD5 of the text), own_license, cosine, whole (cosine of the whole text).

    Terms weigh by the files that have them, over all files and the templates. Texts with an anchor of a template
    are the candidates; no other can reach ``least``. Their headers and their whole texts are vectors. Of those
    with a cosine of at least ``least`` the one that shares most weight with its template is taken, so that a text
    is not named after a shorter one that it contains; then the higher cosine, then the first name.
    """
    counted = cut_lineage(files.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    total = files.count() + len(templates)
    kinds = weighted_templates(counted, total, least, templates)
    anchors = [r["term"] for r in kinds.where("anchor").select("term").distinct().orderBy("term").collect()]
    own = files.where(F.arrays_overlap(terms(F.col("text")), F.array(*map(F.lit, anchors)))).select(F.md5("text").alias("h"), "text")
    found = cut_lineage(own.groupBy("h").agg(F.first("text").alias("text")))
    cut = F.filter(F.split(F.lower("text"), PIECE_END), lambda p: p.rlike("[a-z0-9]"))
    pieces = cut_lineage(found.select("h", F.posexplode(cut).alias("pos", "piece")))
    used = pieces.select(F.explode(terms(F.col("piece"))).alias("term")).distinct()
    shares = kinds.select("term", "others").distinct()
    weights = cut_lineage(
        counted.join(used, "term", "left_semi").join(F.broadcast(shares), "term", "left")
        .select("term", F.log1p(F.lit(float(total)) / (F.col("n") + F.coalesce("others", F.lit(0)))).alias("weight"))
    )
    parts = headers(pieces, weights, kinds, cover).withColumn("entire", F.lit(False)).unionByName(
        found.select("h", F.lower("text").alias("passage"), F.lit(True).alias("entire")))
    held = cut_lineage(parts.withColumn("pid", name_of(F.col("passage"))))
    scored = held.select("h", "pid", "entire").distinct().join(best_cosines(held, weights, kinds), "pid")
    good = F.col("cosine") >= least
    return scored.groupBy("h").agg(
        F.min(F.when(good, F.struct((-F.col("shared")).alias("s"), (-F.col("cosine")).alias("c"), "licence"))).alias("b"), F.max(F.when(F.col("entire"), F.col("cosine"))).alias("whole"),
    ).where("b IS NOT NULL").select("h", F.col("b.licence").alias("own_license"), (-F.col("b.c")).alias("cosine"), "whole")


def scan_licenses(files: DataFrame, least: float = 0.75, whole: float = 0.6, cover: float = 0.5, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per file: id, path, own_license, cosine, license, origin (own, inherited or none), inherited_from.

    ``files`` has id, path and text. A file's own licence is that of its headers or its whole text with a cosine
    of at least ``least`` (``text_licenses``). A licence file is one with a licence file's name, or whose whole text has
    a cosine of at least ``whole``. It stands for its directory; files without an own licence take that of the
    nearest directory above them. Two licence files of one directory: the higher cosine, then name, then path.
    Null paths have no directory and neither give nor inherit; null and empty texts have no header. Repeated rows
    stay. Equal texts have equal licences and are looked at once. Other columns are not read. An empty table has no rows.
    """
    plain = files.select("id", "path", "text")
    own = cut_lineage(text_licenses(plain, least, cover, templates))
    listed = cut_lineage(
        plain.select("id", "path", F.md5("text").alias("h")).join(own, "h", "left")
        .select("id", "path", "own_license", "cosine", (F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)) | F.coalesce(F.col("whole") >= whole, F.lit(False))).alias("_file"))
    )
    grants = listed.where("own_license IS NOT NULL AND _file AND path IS NOT NULL").groupBy(folder(F.col("path")).alias("above")).agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), F.col("own_license").alias("l"), F.col("path").alias("p"))).alias("g"))
    # Inheritance is worked out once per directory, not per file.
    places = listed.where("path IS NOT NULL").select(folder(F.col("path")).alias("place")).distinct()
    steps = F.split("place", "/")
    climb = places.select("place", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.when(k == 0, F.lit("")).otherwise(F.array_join(F.slice(steps, 1, k), "/")))).alias("above")).distinct()
    nearest = cut_lineage(climb.join(grants, "above").groupBy("place").agg(F.max(F.struct(F.length("above").alias("d"), "above", F.col("g.l").alias("l"))).alias("n")).select("place", F.col("n.above").alias("above"), F.col("n.l").alias("given")))
    out = listed.withColumn("_place", folder(F.col("path"))).join(nearest, F.col("_place") == F.col("place"), "left")
    mine = F.col("own_license").isNotNull()
    return out.select(
        "id", "path", "own_license", "cosine", F.coalesce("own_license", "given").alias("license"),
        F.when(mine, "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("above")).alias("inherited_from"),
    )


def oracle_sql(files: str, least: float = 0.75, whole: float = 0.6, cover: float = 0.5, templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """DuckDB SQL for ``scan_licenses`` of the rows of ``files`` (id, path, text): every piece and every text meets its terms, without anchors."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({t}, {quoted(name)}, {quoted(text)})" for t, (name, text) in enumerate(templates))
    found = f"regexp_extract_all(lower(text), '{TERM}')"
    return f"""
WITH f AS (SELECT row_number() OVER () AS r, id, path, text FROM ({files})),
k(t, licence, text) AS (VALUES {values}),
total AS (SELECT (SELECT count(*) FROM f) + (SELECT count(*) FROM k) AS n),
seen AS (SELECT term, count(*) AS n FROM (
  SELECT DISTINCT 'f' || r AS who, unnest({found}) AS term FROM f UNION ALL SELECT DISTINCT 'k' || t, unnest({found}) FROM k) GROUP BY term),
weight AS (SELECT term, ln(1 + total.n::DOUBLE / seen.n) AS g FROM seen, total),
kind AS (SELECT t, term, count(*) * any_value(g) AS v FROM (SELECT t, unnest({found}) AS term FROM k) JOIN weight USING (term) GROUP BY t, term),
kind_length AS (SELECT t, sqrt(sum(v * v)) AS long FROM kind GROUP BY t),
texts AS (SELECT DISTINCT text FROM f WHERE text IS NOT NULL),
cut AS (SELECT text, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT text, regexp_split_to_array(lower(text), '{PIECE_END}') AS p FROM texts)),
piece AS (SELECT text AS whole_text, piece AS text, row_number() OVER (PARTITION BY text ORDER BY i) AS pos FROM cut WHERE regexp_matches(piece, '[a-z0-9]')),
piece_term AS (SELECT text, term, count(*) * any_value(g) AS w FROM (SELECT text, unnest({found}) AS term FROM (SELECT DISTINCT text FROM piece)) JOIN weight USING (term) GROUP BY text, term),
piece_all AS (SELECT text, sum(w * w) AS s FROM piece_term GROUP BY text),
near AS (SELECT a.text, a.t FROM (SELECT text, t, sum(w * w) AS s FROM piece_term JOIN kind USING (term) GROUP BY text, t) a JOIN piece_all b USING (text) WHERE round(a.s / b.s, 9) >= {cover}),
run AS (SELECT whole_text, t, pos, text, pos - row_number() OVER (PARTITION BY whole_text, t ORDER BY pos) AS run FROM piece JOIN near USING (text)),
part AS (SELECT whole_text, string_agg(text, ' ' ORDER BY pos) AS text, false AS entire FROM run GROUP BY whole_text, t, run UNION ALL SELECT text, lower(text), true FROM texts),
part_term AS (SELECT text, term, count(*) * any_value(g) AS w FROM (SELECT text, unnest({found}) AS term FROM (SELECT DISTINCT text FROM part)) JOIN weight USING (term) GROUP BY text, term),
part_length AS (SELECT text, sqrt(sum(w * w)) AS long FROM part_term GROUP BY text),
score AS (SELECT p.text, p.t, round(any_value(d) / (any_value(l.long) * any_value(q.long)), 6) AS cosine, round(any_value(d) / any_value(q.long), 6) AS shared
  FROM (SELECT text, t, sum(w * v) AS d FROM part_term JOIN kind USING (term) GROUP BY text, t) p JOIN part_length l USING (text) JOIN kind_length q USING (t) GROUP BY p.text, p.t),
best AS (SELECT whole_text, entire, cosine, licence, shared FROM part JOIN (SELECT score.text, min({{'c': -cosine, 'l': licence, 's': shared}}) AS m FROM score JOIN k USING (t) GROUP BY score.text) USING (text),
  LATERAL (SELECT -m.c AS cosine, m.l AS licence, m.s AS shared)),
own AS (SELECT whole_text AS text, min({{'s': -shared, 'c': -cosine, 'l': licence}}) FILTER (cosine >= {least}) AS b, max(cosine) FILTER (entire) AS whole FROM best GROUP BY whole_text),
listed AS (SELECT r, id, path, b.l AS own_license, -b.c AS cosine, b IS NOT NULL AND (coalesce(regexp_matches(path, '{FILE_NAME}'), false) OR coalesce(whole >= {whole}, false)) AS is_file, regexp_replace(path, '/?[^/]*$', '') AS place
  FROM f LEFT JOIN own ON f.text = own.text),
given AS (SELECT place AS above, min({{'c': -cosine, 'l': own_license, 'p': path}}) AS g FROM listed WHERE is_file AND path IS NOT NULL GROUP BY place),
climb AS (SELECT l.r, max({{'d': length(above), 'a': above, 'l': g.l}}) AS n FROM listed l JOIN given ON above = '' OR l.place = above OR starts_with(l.place, above || '/') WHERE l.path IS NOT NULL GROUP BY l.r)
SELECT id AS doc_id, path, own_license, cosine, coalesce(own_license, n.l) AS license,
  CASE WHEN own_license IS NOT NULL THEN 'own' WHEN n.l IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own_license IS NULL THEN n.a END AS inherited_from
FROM listed LEFT JOIN climb USING (r)
"""
