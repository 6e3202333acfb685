"""Checks of sources, names, cleaning, joins and window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.fixtures import (
    HOURS, embedding_waves, hourly, nation_contacts, recording_event, supplier_waves, table, user_annotations,
)
from checks.registry import check, final, shape
from wavecairn.functions import arrays, names, wavelets
from wavecairn.operators import cleaning, features, framing, montage, panes
from wavecairn.operators.framing import CHANNEL
from wavecairn.operators.sequences import nearest
from wavecairn.plans.analyse import with_montage
from wavecairn.session import cut_lineage

K = "recording_id channel ch_index#"

# A. Scans ----------------------------------------------------------------------------------------
_CROP = f"{K} i# v:"


@check("a5_crop", S.query(S.hourly(), select=final(_CROP, "s WHERE i >= 101 AND i <= 300")))
def a5(spark, sf):
    return shape(framing.crop(hourly(spark, sf), 1.0, 100.5, 300.2), _CROP)


# B. Names, time, text -----------------------------------------------------------------------------
_NAME = "recording_id channel shaft contact#"
_CONTACT_SQL = r"'^(?:EEG\s+)?([A-Za-zА-Яа-я]+''?)\s*(\d+)$'"


@check("b1_parse_contact_name", S.query(S.contacts(), select=f"""
SELECT recording_id, channel, nullif(regexp_extract(trim(channel), {_CONTACT_SQL}, 1), '') AS shaft,
  CAST(nullif(regexp_extract(trim(channel), {_CONTACT_SQL}, 2), '') AS BIGINT) AS contact FROM ch"""))
def b1(spark, sf):
    ch = nation_contacts(spark, sf)
    return shape(ch.select("*", names.shaft(F.col("channel")).alias("shaft"), names.contact(F.col("channel")).alias("contact")), _NAME)


_ROI = [("PM", 3, 400), ("CC", 8, 1000)]


@check("b2_in_region", S.query(
    S.contacts(), """
parsed AS (SELECT *, regexp_extract(trim(channel), '([A-Za-z]+)\\s*(\\d+)(?:-(\\d+))?', 1) AS sh,
    TRY_CAST(regexp_extract(trim(channel), '([A-Za-z]+)\\s*(\\d+)(?:-(\\d+))?', 2) AS INTEGER) AS num FROM ch)""",
    "roi AS (SELECT * FROM (VALUES ('PM', 3, 400), ('CC', 8, 1000)) t(shaft, lo, hi))",
    select="""SELECT recording_id, channel, EXISTS (SELECT 1 FROM roi WHERE roi.shaft = sh AND num BETWEEN lo AND hi) AS inside
FROM parsed"""))
def b2(spark, sf):
    ch = nation_contacts(spark, sf)
    return ch.select("recording_id", "channel", names.in_region(F.col("channel"), _ROI).alias("inside"))


@check("b3_clock_to_offset", """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST((o_orderkey * 104729) % 86400 AS INTEGER)) AS start,
    (o_orderkey * 7919) % 86400 AS sec FROM orders),
c AS (SELECT *, date_trunc('day', start) + to_seconds(CAST(sec AS INTEGER)) + INTERVAL 500 MILLISECOND AS m FROM o),
d AS (SELECT o_orderkey, (epoch_us(CASE WHEN m < start THEN m + INTERVAL 1 DAY ELSE m END) - epoch_us(start)) / 1e6 AS off FROM c)
SELECT o_orderkey, CASE WHEN off <= 40000.0 THEN off END AS offset_s FROM d""")
def b3(spark, sf):
    o = table(spark, sf, "orders")
    start = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") * 104729) % 86400)
    second = (F.col("o_orderkey") * 7919) % 86400
    part = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    clock = F.concat(part(F.floor(second / 3600)), F.lit(":"), part(F.floor(second / 60) % 60), F.lit(":"), part(second % 60), F.lit(".500"))
    return o.select("o_orderkey", names.clock_offset(clock, start, F.lit(40000.0)).alias("offset_s"))


_UNITS = "event_id# uv: second: sample# w#"


@check("b4_units", f"""
WITH u AS (SELECT event_id, value * 1e6 AS uv, event_id / 256.0::DOUBLE AS second,
  CAST(round_even(value * 7.0::DOUBLE, 0) AS BIGINT) AS sample, CAST(floor(value / 2.0::DOUBLE) AS BIGINT) AS w FROM events)
{final(_UNITS, 'u')}""")
def b4(spark, sf):
    e = table(spark, sf, "events")
    v = F.col("value")
    return shape(e.select(
        "event_id", names.to_microvolts(v).alias("uv"), names.sample_to_seconds(F.col("event_id"), F.lit(256.0)).alias("second"),
        names.seconds_to_sample(v, 7.0).alias("sample"), names.window_of(v, 2.0).alias("w")), _UNITS)


_WORDS = ("приступ", "ictal", "tcs", "leaux", "thou", "ção", "über")


@check("b5_keywords", "SELECT doc_id, (" + " OR ".join(f"contains(lower(text), '{w}')" for w in _WORDS) + ") AS hit FROM documents")
def b5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", names.mentions(F.col("text"), _WORDS).alias("hit"))


_BAND = "l_orderkey# l_linenumber# low: high:"


@check("b6_dwt_band_hz", f"""
WITH b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 0.0 ELSE l_quantity / pow(2, l_linenumber + 1) END AS low,
  CASE WHEN l_returnflag = 'A' THEN l_quantity / pow(2, l_linenumber + 1) ELSE l_quantity / pow(2, l_linenumber) END AS high FROM lineitem)
{final(_BAND, 'b')}""")
def b6(spark, sf):
    li = table(spark, sf, "lineitem")
    label = F.concat(F.when(F.col("l_returnflag") == "A", "A").otherwise("D"), F.col("l_linenumber").cast("string"))
    q = F.col("l_quantity")
    return shape(li.select("l_orderkey", "l_linenumber", wavelets.band_low_hz(label, q).alias("low"), wavelets.band_high_hz(label, q).alias("high")), _BAND)


@check("b7_max_dwt_level", """SELECT o_orderkey, CAST(least(5, greatest(0, floor(log2(floor(o_totalprice) / 7.0)))) AS BIGINT) AS level FROM orders""")
def b7(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", wavelets.max_level(F.floor("o_totalprice"), 8, 5).cast("bigint").alias("level"))


_PAIRS_SQL = f"""
named AS (SELECT *, regexp_extract(trim(channel), {_CONTACT_SQL}, 1) AS shaft,
    TRY_CAST(regexp_extract(trim(channel), {_CONTACT_SQL}, 2) AS INTEGER) AS contact FROM ch),
led AS (SELECT recording_id, shaft, channel AS channel_a, contact AS contact_a,
    lead(channel) OVER p AS channel_b, lead(contact) OVER p AS contact_b, row_number() OVER p AS pos,
    min(ch_index) OVER (PARTITION BY recording_id, shaft) AS shaft_order
  FROM named WHERE shaft <> '' WINDOW p AS (PARTITION BY recording_id, shaft ORDER BY contact, ch_index)),
pairs AS (SELECT *, shaft || contact_a || '-' || contact_b AS label FROM led WHERE channel_b IS NOT NULL)"""


@check("b10_format_montage", S.query(S.contacts(), _PAIRS_SQL, """
blocks AS (SELECT recording_id, shaft, any_value(shaft_order) AS so,
    any_value(shaft) || ':' || chr(10) || string_agg('  ' || contact_a || '-' || contact_b, chr(10) ORDER BY pos) AS block FROM pairs GROUP BY recording_id, shaft)""",
    select="SELECT recording_id, string_agg(block, chr(10) ORDER BY so) AS montage FROM blocks GROUP BY recording_id"))
def b10(spark, sf):
    return montage.format_montage(montage.contact_pairs(nation_contacts(spark, sf)))


# C. Cleaning ----------------------------------------------------------------------------------------
@check("c1_quality", S.query(S.hourly(gaps=True), select="""
SELECT recording_id, round(avg((v IS NOT NULL)::INT::DOUBLE), 6) AS quality, avg((v IS NOT NULL)::INT::DOUBLE) >= 0.8 AS ok
FROM s GROUP BY recording_id"""))
def c1(spark, sf):
    rated = cleaning.accept_quality(hourly(spark, sf, gaps=True), 0.8)
    return rated.select("recording_id", F.round("quality", 6).alias("quality"), "ok")


@check("c2_fill_recording", S.query(S.hourly(gaps=True), select=f"""
SELECT recording_id, channel, CAST(ch_index AS BIGINT) AS ch_index, CAST(i AS BIGINT) AS i,
  round(coalesce(v, median(v) OVER (PARTITION BY channel), 0.0), 6) + 0.0::DOUBLE AS v FROM s"""))
def c2(spark, sf):
    return shape(cleaning.fill_recording(hourly(spark, sf, gaps=True), HOURS), _CROP)


_FILLED = f"{K} w# i# v: bad_fraction:"


@check("c3_fill_window", S.query(S.hourly(gaps=True), S.windows("s", 24, 4, HOURS), """
st AS (SELECT channel, w, median(v) AS m, avg((v IS NULL)::INT::DOUBLE) AS bad_fraction FROM win GROUP BY ALL),
f AS (SELECT recording_id, channel, ch_index, w, i, coalesce(v, m, 0.0) AS v, bad_fraction FROM win JOIN st USING (channel, w))""",
    select=final(_FILLED, "f")))
def c3(spark, sf):
    win = framing.assign_windows(hourly(spark, sf, gaps=True), 24, 4, F.lit(HOURS))
    return shape(cleaning.fill_window(win), _FILLED)


_RES = f"{K} w# i# r:"


@check("c4_detrend", S.query(S.hourly(), S.windows("s", 24, 4, HOURS), S.detector_features(), select=final(_RES, "feat_res")))
def c4(spark, sf):
    return shape(cleaning.detrend_windows(framing.assign_windows(hourly(spark, sf), 24, 4, F.lit(HOURS))), _RES)


_WAVE = f"{K} w# pos# x:"
_LONG = """
x AS (SELECT recording_id, channel, ch_index, w, pos, wave[pos + 1] AS x FROM wv, LATERAL (SELECT unnest(range(len(wave))) AS pos))"""


@check("c5_robust_normalise", S.query(S.waves(), _LONG, """
m AS (SELECT w, median(x) AS m, stddev_pop(x) AS sd FROM x GROUP BY w),
d AS (SELECT w, any_value(m) AS m, any_value(sd) AS sd, 1.4826::DOUBLE * median(abs(x - m)) AS mad FROM x JOIN m USING (w) GROUP BY w),
n AS (SELECT x.* EXCLUDE (x), (x - m) / CASE WHEN mad > 1e-12 THEN mad WHEN sd > 1e-12 THEN sd ELSE 1.0 END AS x FROM x JOIN d USING (w))""",
    select=final(_WAVE, "n")))
def c5(spark, sf):
    wv = embedding_waves(spark, sf)
    return shape(wv.select(*CHANNEL, "w", F.posexplode(arrays.robust_normalise(F.col("wave"))).alias("pos", "x")), _WAVE)


@check("c6_resample_linear", S.query(S.waves(), """
p AS (SELECT recording_id, channel, ch_index, w, wave, pos, pos * 63 / 47.0::DOUBLE AS q FROM wv, range(48) t(pos)),
x AS (SELECT * EXCLUDE (wave), wave[least(CAST(floor(q) AS INT), 63) + 1] * (1 - (q - floor(q)))
  + wave[least(CAST(floor(q) AS INT) + 1, 63) + 1] * (q - floor(q)) AS x FROM p)""", select=final(_WAVE, "x")))
def c6(spark, sf):
    wv = embedding_waves(spark, sf)
    return shape(wv.select(*CHANNEL, "w", F.posexplode(arrays.resample_linear(F.col("wave"), 48)).alias("pos", "x")), _WAVE)


_SHOWN = f"{K} i# y:"


@check("c9_overview_series", S.query(S.hourly(), "sh AS (SELECT * FROM s WHERE i % 4 = 0)", S.z(
    "sh", "zz", "channel", ["v"], clip=(-3.5, 3.5), eps=0), """
o AS (SELECT *, v_z + (4 - ch_index) * 8.0 AS y FROM zz)""", select=final(_SHOWN, "o")))
def c9(spark, sf):
    return shape(cleaning.overview_series(hourly(spark, sf), HOURS, 200), _SHOWN)


@check("c9_centred_overview", S.query(S.hourly(), S.windows("s", 24, 4, HOURS), S.detector_features(), """
l AS (SELECT channel, median(rms) AS lev FROM feat GROUP BY channel),
c AS (SELECT channel, median(v) AS med FROM s GROUP BY channel),
o AS (SELECT s.*, (v - med) / CASE WHEN lev > 1e-12 THEN lev ELSE 1.0 END AS y FROM s JOIN l USING (channel) JOIN c USING (channel))""",
    select=final(_SHOWN, "o")))
def c9b(spark, sf):
    s = hourly(spark, sf)
    feats = features.detector_features(features.window_blocks(s, 24, 4), 24, 4)
    return shape(cleaning.centred_overview(s, feats.select(*CHANNEL, "rms"), HOURS), _SHOWN)


# D. Joins ----------------------------------------------------------------------------------------------
_PAIR = "recording_id shaft pos# channel_a channel_b label"


@check("d1_contact_pairs", S.query(S.contacts(), _PAIRS_SQL, select=final(_PAIR, "pairs")))
def d1(spark, sf):
    return shape(montage.contact_pairs(nation_contacts(spark, sf)), _PAIR)


_CH_OF_S = "ch AS (SELECT DISTINCT recording_id, channel, ch_index FROM s)"
_DERIVED = "recording_id channel i# v:"
_APPLY = """
der AS (SELECT a.recording_id, p.label AS channel, a.i, a.v - b.v AS v FROM pairs p
  JOIN s a ON a.recording_id = p.recording_id AND a.channel = p.channel_a
  JOIN s b ON b.recording_id = p.recording_id AND b.channel = p.channel_b AND b.i = a.i)"""


@check("d2_apply_montage", S.query(S.hourly(), _CH_OF_S, _PAIRS_SQL, _APPLY, select=final(_DERIVED, "der")))
def d2(spark, sf):
    s = hourly(spark, sf)
    pairs = montage.contact_pairs(s.select(*CHANNEL).distinct())
    return shape(montage.apply_montage(s, pairs), _DERIVED)


@check("d2_montage_of_slices", S.query(S.hourly(), "g AS (SELECT * FROM s WHERE NOT (ch_index = 1 AND i BETWEEN 150 AND 430))", "ch AS (SELECT DISTINCT recording_id, channel, ch_index FROM s)", _PAIRS_SQL, _APPLY.replace("JOIN s ", "JOIN g "), select=final(_DERIVED, "der")))
def d2c(spark, sf):
    """Arrays of several lengths, one channel with a gap: cut to common blocks, subtracted as arrays."""
    s = hourly(spark, sf).where(~((F.col("ch_index") == 1) & F.col("i").between(150, 430)))
    arrays = cut_lineage(framing.pack_blocks(s, 70).select(*CHANNEL, "i0", "v"))
    both = with_montage(arrays, ("bipolar",), 100)
    rows = framing.unpack_blocks(both).withColumn("recording_id", F.regexp_replace("recording_id", "#bipolar$", ""))
    return shape(rows.where("v IS NOT NULL"), _DERIVED)


@check("d2_apply_montage_packed", S.query(S.hourly(), _CH_OF_S, _PAIRS_SQL, _APPLY, select=final(_DERIVED, "der")))
def d2b(spark, sf):
    s = hourly(spark, sf)
    pairs = montage.contact_pairs(s.select(*CHANNEL).distinct())
    packed = montage.apply_montage(framing.pack_blocks(s, 100), pairs, "block", montage.array_difference)
    return shape(framing.unpack_blocks(packed), _DERIVED)


_NEAR = "recording_id event_id# onset: nearest_time:"


@check("d3_nearest_in_time", S.query(S.annotations(), """
k AS (SELECT * FROM an WHERE description = 'error'), p AS (SELECT * FROM an WHERE description = 'view'),
j AS (SELECT k.recording_id, k.event_id, k.onset, arg_min(p.onset, (abs(p.onset - k.onset), p.onset)) AS nearest_time
  FROM k JOIN p USING (recording_id) GROUP BY ALL)""", select=final(_NEAR, "j")))
def d3(spark, sf):
    an = user_annotations(spark, sf)
    keys, points = an.where("description = 'error'"), an.where("description = 'view'").withColumnRenamed("onset", "t")
    found = nearest(keys, points, ["recording_id"], "onset", "t", 86_400.0, "event_id")
    return shape(found.where("nearest_time is not null"), _NEAR)


_PHASE = "recording_id channel phase n# total:"


@check("d4_interval_membership", S.query(S.hourly(), """
iv AS (SELECT * FROM (VALUES ('baseline', 200, 400), ('analysis', 400, 481), ('known', 430, 440)) t(phase, lo, hi)),
m AS (SELECT recording_id, channel, phase, count(*) AS n, sum(v) AS total FROM s JOIN iv ON i >= lo AND i < hi GROUP BY ALL)""",
    select=final(_PHASE, "m")))
def d4(spark, sf):
    intervals = [("baseline", 200, 400), ("analysis", 400, 481), ("known", 430, 440)]
    return shape(framing.in_intervals(hourly(spark, sf), F.col("i"), intervals).groupBy("recording_id", "channel", "phase").agg(
        F.count("*").alias("n"), F.sum("v").alias("total")), _PHASE)


_TEMPLATE = """
tp AS (SELECT channel, pos, median(x) AS tx FROM x GROUP BY ALL)"""
_DIST = f"{K} w# distance:"


@check("d5_template_join", S.query(S.waves(), _LONG, _TEMPLATE, """
d AS (SELECT recording_id, channel, ch_index, w, sqrt(sum((x - tx) * (x - tx))) AS distance FROM x JOIN tp USING (channel, pos) GROUP BY ALL)""",
    select=final(_DIST, "d")))
def d5(spark, sf):
    wv = embedding_waves(spark, sf)
    joined = wv.join(features.wave_template(wv), ["recording_id", "channel"])
    diff = F.zip_with("wave", "template", lambda a, b: (a - b) * (a - b))
    return shape(joined.withColumn("distance", F.sqrt(arrays.array_sum(diff))), _DIST)


@check("d7_semi_anti", S.query(S.contacts(), select="""
SELECT recording_id, channel FROM ch a WHERE NOT regexp_matches(trim(channel), '^EEG (CC|CR)''\\d+$')
  AND EXISTS (SELECT 1 FROM ch b WHERE b.recording_id = a.recording_id AND b.channel = a.channel AND b.c_acctbal > 0)"""))
def d7(spark, sf):
    ch = nation_contacts(spark, sf)
    involved = ch.where("c_acctbal > 0").select("recording_id", "channel")
    excluded = ch.where(F.trim("channel").rlike(r"(?i)^EEG (CC|CR)'\d+$")).select("recording_id", "channel")
    kept = ch.join(involved, ["recording_id", "channel"], "left_semi").join(excluded, ["recording_id", "channel"], "left_anti")
    return kept.select("recording_id", "channel")


@check("d8_pairs_touching", S.query(S.contacts(), _PAIRS_SQL, "kn AS (SELECT recording_id, channel FROM ch WHERE c_acctbal < 0)", select="""
SELECT DISTINCT p.recording_id, p.label FROM pairs p JOIN kn ON kn.recording_id = p.recording_id
  AND (kn.channel = p.channel_a OR kn.channel = p.channel_b)"""))
def d8(spark, sf):
    ch = nation_contacts(spark, sf)
    return montage.pairs_touching(montage.contact_pairs(ch), ch.where("c_acctbal < 0"))


# E. Windows ------------------------------------------------------------------------------------------------
_COUNT = f"{K} w# n# total: first_i#"


_UNEVEN = f"{K} w# n# mean: std: low: high: first: last: slope: residual:"


@check("e1_assign_windows", S.query(S.supplier_days(), S.windows("s", 28, 7, 2500), """
g AS (SELECT recording_id, channel, ch_index, w, count(*) AS n, sum(v) AS total, min(i) AS first_i FROM win GROUP BY ALL)""", select=final(_COUNT, "g")))
def e1(spark, sf):
    win = panes.window_sums(supplier_waves(spark, sf), 28, 7, F.lit(2500), only=("n", "total", "first_i"))
    return shape(win.select(*CHANNEL, "w", "n", "total", "first_i"), _COUNT)


@check("e1_uneven_windows", S.query(S.supplier_days(), "g AS (SELECT * EXCLUDE (v), CASE WHEN i % 11 = 3 THEN NULL ELSE v + i / 100.0 END AS v FROM s)", S.windows("g", 30, 7, 2500), """
o AS (SELECT recording_id, channel, ch_index, w, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS low, max(v) AS high,
  arg_min(v, i) AS first, arg_max(v, i) AS last, regr_slope(v, i) AS slope, greatest(0.0, regr_syy(v, i) / count(v) - regr_sxy(v, i) * regr_sxy(v, i) / (regr_sxx(v, i) * count(v))) AS residual
  FROM win GROUP BY ALL)""", select=final(_UNEVEN, "o")))
def e1b(spark, sf):
    """A step that does not divide the window: two panes a step; missing samples, line fit from the merged sums."""
    at = lambda k: F.col("i0") + k
    v = F.transform("v", lambda x, k: F.when(at(k) % 11 != 3, x + at(k) / 100.0))
    only = ("n", "total", "squares", "places", "place_squares", "moment", "low", "high", "first", "last")
    win = panes.window_sums(supplier_waves(spark, sf).withColumn("v", v), 30, 7, F.lit(2500), only=only)
    return shape(win.select(*CHANNEL, "w", "n", panes.mean().alias("mean"), F.sqrt(panes.variance()).alias("std"), "low", "high", "first", "last",
                            panes.slope().alias("slope"), (panes.residual_rms() * panes.residual_rms()).alias("residual")), _UNEVEN)


_FEAT = f"{K} w# rms: peak_to_peak: line_length: diff_rms:"


@check("e2_detector_features", S.query(S.supplier_days(), S.windows("s", 28, 7, 2500), S.detector_features(), select=final(_FEAT, "feat")))
def e2(spark, sf):
    return shape(features.detector_features(features.window_blocks(supplier_waves(spark, sf), 28, 7), 28, 7), _FEAT)


CUT = 31
_AFTER = f"cut AS (SELECT * FROM s WHERE i >= {CUT})"


@check("e2_after_crop", S.query(S.supplier_days(), _AFTER, S.windows("cut", 28, 7, 2500), S.detector_features(), select=final(_FEAT, f"(SELECT * FROM feat WHERE w * 7 >= {CUT})")))
def e2_crop(spark, sf):
    cut = framing.crop(supplier_waves(spark, sf), 1.0, tmin=CUT)
    return shape(features.detector_features(features.window_blocks(cut, 28, 7, 1000), 28, 7), _FEAT)


_TOUCHED = "w * 7 <= 449 AND w * 7 + 27 >= 400"


def _without(arrays, begin, end):
    """Two arrays a channel: the places before and behind a gap of absent samples."""
    return framing.without_places(arrays, begin, end)


_GAP = "w * 25 <= 1299 AND w * 25 + 99 >= 500"


@check("e2_with_absent_blocks", S.query(S.supplier_days(), S.windows("s", 100, 25, 2500), S.detector_features(), f"""
o AS (SELECT recording_id, channel, ch_index, w, CASE WHEN {_GAP} THEN NULL ELSE rms END AS rms, CASE WHEN {_GAP} THEN NULL ELSE peak_to_peak END AS peak_to_peak,
  CASE WHEN {_GAP} THEN NULL ELSE line_length END AS line_length, CASE WHEN {_GAP} THEN NULL ELSE diff_rms END AS diff_rms FROM feat)""", select=final(_FEAT, "o")))
def e2_blocks(spark, sf):
    """A gap of two whole blocks and more: the directory names them, so no window is lost."""
    rows = _without(supplier_waves(spark, sf), 500, 1300)
    got = features.detector_features(features.window_blocks(rows, 100, 25, 300), 100, 25)
    return shape(got.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in features.DETECTOR_FEATURES}), _FEAT)


@check("e2_from_slices", S.query(S.supplier_days(), S.windows("s", 28, 7, 2500), S.detector_features(), select=final(_FEAT, "feat")))
def e2_slices(spark, sf):
    """The same features out of arrays that are cut at other borders: slices are shuffled, not samples."""
    arrays = cut_lineage(framing.pack_blocks(supplier_waves(spark, sf), 333).select(*CHANNEL, "i0", "v"))
    return shape(features.detector_features(features.window_blocks(arrays, 28, 7, 1000), 28, 7), _FEAT)


@check("e2_with_absent_rows", S.query(S.supplier_days(), "cut AS (SELECT * FROM s WHERE i NOT BETWEEN 400 AND 449)", S.windows("cut", 28, 7, 2500), S.detector_features(), f"""
o AS (SELECT recording_id, channel, ch_index, w, CASE WHEN {_TOUCHED} THEN NULL ELSE rms END AS rms, CASE WHEN {_TOUCHED} THEN NULL ELSE peak_to_peak END AS peak_to_peak,
  CASE WHEN {_TOUCHED} THEN NULL ELSE line_length END AS line_length, CASE WHEN {_TOUCHED} THEN NULL ELSE diff_rms END AS diff_rms FROM feat
  UNION ALL SELECT k.*, w.range, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT recording_id, channel, ch_index FROM s) k, range(354) w
  WHERE NOT EXISTS (SELECT 1 FROM win x WHERE x.w = w.range) AND w.range * 7 + 28 <= 2500)""", select=final(_FEAT, "o")))
def e2_absent(spark, sf):
    rows = _without(supplier_waves(spark, sf), 400, 450)
    got = features.detector_features(features.window_blocks(rows, 28, 7), 28, 7)
    # Windows that touch absent rows have no value unless a fill is given.
    return shape(got.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in features.DETECTOR_FEATURES}), _FEAT)


_PROFILE = f"{K} w# rms: peak_to_peak: line_length: diff_rms: bad_fraction:"


@check("e3_ensemble_features", S.query(S.hourly(gaps=True), S.windows("s", 24, 4, HOURS), """
st AS (SELECT channel, w, median(v) AS m, avg((v IS NULL)::INT::DOUBLE) AS bad_fraction FROM win GROUP BY ALL),
f AS (SELECT recording_id, channel, ch_index, w, i, coalesce(v, m, 0.0) AS v, bad_fraction FROM win JOIN st USING (channel, w)),
c AS (SELECT channel, w, median(v) AS c FROM f GROUP BY ALL),
d AS (SELECT f.*, v - c AS cv, v - lag(v) OVER (PARTITION BY channel, w ORDER BY i) AS d FROM f JOIN c USING (channel, w)),
o AS (SELECT recording_id, channel, ch_index, w, sqrt(avg(cv * cv)) AS rms, max(v) - min(v) AS peak_to_peak, avg(abs(d)) AS line_length,
  sqrt(avg(d * d)) AS diff_rms, any_value(bad_fraction) AS bad_fraction FROM d GROUP BY ALL)""", select=final(_PROFILE, "o")))
def e3(spark, sf):
    return shape(features.window_profiles(features.window_blocks(hourly(spark, sf, gaps=True), 24, 4), 24, 4, 32), _PROFILE)


_ENERGY = f"{K} w# energy:"


@check("e4_band_energy", S.query(S.supplier_days(), S.windows("s", 28, 7, 2500), """
g AS (SELECT recording_id, channel, ch_index, w, avg(v * v) AS energy FROM win GROUP BY ALL)""", select=final(_ENERGY, "g")))
def e4(spark, sf):
    return shape(features.band_energy(supplier_waves(spark, sf), 28, 7, F.lit(2500)), _ENERGY)


_STATS = f"{K} w# mean: std: rms: line_length:"


@check("e5_stat_features", S.query(S.supplier_days(), """
t AS (SELECT *, i // 50 AS w, v - lag(v) OVER (PARTITION BY recording_id, channel, i // 50 ORDER BY i) AS d FROM s),
g AS (SELECT recording_id, channel, ch_index, w, avg(v) AS mean, stddev_pop(v) AS std, sqrt(avg(v * v)) AS rms, avg(abs(d)) AS line_length
  FROM t GROUP BY ALL)""", select=final(_STATS, "g")))
def e5(spark, sf):
    return shape(features.stat_features(supplier_waves(spark, sf), 50, F.lit(2500)), _STATS)


@check("e6_template", S.query(S.waves(), _LONG, _TEMPLATE, select="SELECT channel, CAST(pos AS BIGINT) AS pos, round(tx, 6) + 0.0::DOUBLE AS x FROM tp"))
def e6(spark, sf):
    tpl = features.wave_template(embedding_waves(spark, sf))
    return shape(tpl.select("channel", F.posexplode("template").alias("pos", "x")), "channel pos# x:")


_VAR = f"{K} variance: rank#"


@check("e7_variance_rank", S.query(S.supplier_days(), """
v AS (SELECT recording_id, channel, ch_index, var_pop(v) AS variance FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY variance DESC, ch_index) AS rank FROM v)""", select=final(_VAR, "r WHERE rank <= 3")))
def e7(spark, sf):
    return shape(features.variance_rank(supplier_waves(spark, sf), 3), _VAR)


_SMOOTH = f"{K} i# smooth:"


@check("e8_moving_average", S.query(S.hourly(), """
m AS (SELECT *, avg(v) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS smooth FROM s)""", select=final(_SMOOTH, "m")))
def e8(spark, sf):
    return shape(features.moving_average(hourly(spark, sf), CHANNEL, "v", 6, "smooth"), _SMOOTH)


_LAGS = f"{K} i# l1: l2: l3:"


@check("e9_lag_embedding", S.query(S.hourly(), "m AS (SELECT *, " + ", ".join(
    f"coalesce(lag(v, {k}) OVER p, first_value(v) OVER p) AS l{k}" for k in (1, 2, 3)) + " FROM s WINDOW p AS (PARTITION BY channel ORDER BY i))",
    select=final(_LAGS, "m")))
def e9(spark, sf):
    lagged = features.lag_embedding(hourly(spark, sf), 3)
    return shape(lagged.select(*CHANNEL, "i", *[F.get("taps", k).alias(f"l{k + 1}") for k in range(3)]), _LAGS)
