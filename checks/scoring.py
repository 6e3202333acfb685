"""Checks of robust scores, event formation, the blind detector and event resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.fixtures import HOURS, embedding_waves, hourly, nation_contacts, recording_event, supplier_days, supplier_waves, table, user_annotations
from checks.registry import check, final, shape
from wavecairn.config import DetectorConfig
from wavecairn.functions.arrays import top_mean
from wavecairn.operators import cleaning, events, features, robust
from wavecairn.operators.framing import CHANNEL
from wavecairn.plans.detect import channel_z, detect, recordings_of, rows_of, summarise
from wavecairn.plans.tiers import resolve_lazily

K = "recording_id channel ch_index#"
REC = ["recording_id"]
CONFIG = DetectorConfig(window_seconds=24, step_seconds=4, threshold_mad=2.5, merge_gap_seconds=4, min_involved_channels=1)
CORPUS = DetectorConfig(window_seconds=28, step_seconds=7, channel_fraction=0.3, threshold_mad=4.0, merge_gap_seconds=7, min_involved_channels=2)


def planted(spark, sf):
    return detect(hourly(spark, sf, planted=True), 1.0, CONFIG)


P = [S.hourly(planted=True), S.windows("s", 24, 4, HOURS), S.detector_features(), S.channel_scores(), S.consensus(),
     S.threshold(), S.relax(3), "nc AS (SELECT recording_id, count(DISTINCT channel) AS n_channels FROM s GROUP BY ALL)"]
C = [S.supplier_days(), S.windows("s", 28, 7, 2500), S.detector_features(), S.channel_scores(), S.consensus(fraction=0.3),
     S.threshold(mad=4.0), S.relax(3), "nc AS (SELECT recording_id, count(DISTINCT channel) AS n_channels FROM s GROUP BY ALL)"]

# F. Scores --------------------------------------------------------------------------------------------
_Z = f"{K} w# rms_z: peak_to_peak_z: line_length_z: diff_rms_z:"
CF = [S.supplier_days(), S.windows("s", 28, 7, 2500), S.detector_features()]


Z_COLUMNS = [f"{c}_z" for c in features.DETECTOR_FEATURES]


def _corpus_z(spark, sf):
    """z scores of the window features, with a channel's windows as one group."""
    return rows_of(channel_z(supplier_waves(spark, sf), 28, 7), Z_COLUMNS)


@check("f1_robust_z", S.query(*CF, S.z("feat", "zz", S.K, S.FEATURES), select=final(_Z, "zz")))
def f1(spark, sf):
    return shape(_corpus_z(spark, sf), _Z)


_V = f"{K} i# v_z:"


@check("f1_robust_z_baseline_floor", S.query(S.hourly(), S.z("s", "zz", S.K, ["v"], where="i >= 200 AND i < 400", clip=(0, 50), eps=1e-20, fallback="floor"), select=final(_V, "zz")))
def f1b(spark, sf):
    return shape(robust.robust_z(hourly(spark, sf), CHANNEL, ["v"], baseline=F.col("i").between(200, 399), clip=(0.0, 50.0), eps=1e-20, fallback="floor", max_group_rows=HOURS), _V)


@check("f1_robust_z_two_sided", S.query(S.hourly(gaps=True), S.z("s", "zz", S.K, ["v"], two_sided=True, missing=0.0), select=final(_V, "zz")))
def f1c(spark, sf):
    return shape(robust.robust_z(hourly(spark, sf, gaps=True), CHANNEL, ["v"], two_sided=True, missing=0.0, max_group_rows=HOURS), _V)


@check("f1_robust_z_signed_plus", S.query(S.hourly(), S.z("s", "zz", S.K, ["v"], clip=None, eps=1e-15, fallback="plus"), select=final(_V, "zz")))
def f1d(spark, sf):
    return shape(robust.robust_z(hourly(spark, sf), CHANNEL, ["v"], clip=None, eps=1e-15, fallback="plus", max_group_rows=HOURS), _V)


@check("f1_robust_z_selected_medians", S.query(S.supplier_days(), S.z("s", "zz", "channel", ["v"], clip=None, eps=1e-15, fallback="plus"), """
g AS (SELECT channel, i, sum(v_z) AS total, count(*) AS n FROM zz GROUP BY ALL)""", select=final("channel i# total: n#", "g")))
def f1e(spark, sf):
    """Medians of groups too large for one task: rank selection instead of one aggregate."""
    rows = supplier_days(spark, sf)
    z = robust.robust_z(rows, ["channel"], ["v"], clip=None, eps=1e-15, fallback="plus", max_group_rows=1 << 40, small_rows=60)
    return shape(z.groupBy("channel", "i").agg(F.sum("v_z").alias("total"), F.count("*").alias("n")), "channel i# total: n#")


_SCORE = f"{K} w# score:"


@check("f2_top_mean", S.query(*C[:4], select=final(_SCORE, "cs")))
def f2(spark, sf):
    best = top_mean(F.array(*Z_COLUMNS), 2)
    return shape(_corpus_z(spark, sf).withColumn("score", best), _SCORE)


@check("f2_channel_consensus", S.query(*P[:5], select=final("recording_id w# score:", "sc")))
def f2b(spark, sf):
    return shape(planted(spark, sf).scores, "recording_id w# score:")


_MAX = f"{K} w# best:"


@check("f3_max_over", S.query(*CF, S.z("feat", "zz", S.K, S.FEATURES), """
m AS (SELECT *, greatest(rms_z, peak_to_peak_z, line_length_z, diff_rms_z) AS best FROM zz)""", select=final(_MAX, "m")))
def f3(spark, sf):
    return shape(_corpus_z(spark, sf).withColumn("best", F.greatest(*Z_COLUMNS)), _MAX)


_TH = "recording_id score_center: score_scale: threshold:"


@check("f4_global_threshold", S.query(*C[:6], select=final(_TH, "th")))
def f4(spark, sf):
    d = detect(supplier_waves(spark, sf), 1.0, CORPUS)
    return shape(robust.global_threshold(d.scores, 4.0, max_group_rows=354), _TH)


@check("f4_global_threshold_ensemble", S.query(*P[:5], S.threshold(mad=6.0, fallback="largest"), select=final(_TH, "th")))
def f4b(spark, sf):
    return shape(robust.global_threshold(planted(spark, sf).scores, 6.0, fallback="largest", max_group_rows=175), _TH)


_LIM = "recording_id used_threshold: iteration# candidate_windows#"


@check("f5_reflect", S.query(*P[:5], S.threshold(mad=9.0), S.relax(6), """
r AS (SELECT recording_id, unnest([0,1,2,3,4,5]) AS k, * EXCLUDE (recording_id) FROM lim),
o AS (SELECT recording_id, [t0,t1,t2,t3,t4,t5][k + 1] AS used_threshold, k + 1 AS iteration, [n0,n1,n2,n3,n4,n5][k + 1] AS candidate_windows
  FROM r WHERE k <= used)""", select=final(_LIM, "o")))
def f5(spark, sf):
    scores = planted(spark, sf).scores
    lim = robust.relax_threshold(scores, robust.global_threshold(scores, 9.0, max_group_rows=175), 6)
    tries = lim.select(*REC, F.explode("attempts").alias("a")).select(*REC, F.col("a.threshold").alias("used_threshold"), "a.iteration", "a.candidate_windows")
    return shape(tries, _LIM)


_REVIEW = f"{K} w# review:"


@check("f6_channel_review_score", S.query(*CF, S.z("feat", "zz", S.K, S.FEATURES), """
m AS (SELECT *, (rms_z + peak_to_peak_z + line_length_z + diff_rms_z) / 4 AS review FROM zz)""", select=final(_REVIEW, "m")))
def f6(spark, sf):
    return shape(_corpus_z(spark, sf).withColumn("review", robust.review_of(Z_COLUMNS)), _REVIEW)


_AT = "recording_id method known_w# known_score: percentile: rank# windows# above"


@check("f7_score_at_known", S.query(*C[:6], """
kn AS (SELECT recording_id, 100 AS w FROM th),
h AS (SELECT sc.recording_id, sc.score AS known_score FROM sc JOIN kn USING (recording_id, w)),
o AS (SELECT sc.recording_id, 'detector' AS method, 100 AS known_w, any_value(known_score) AS known_score,
  100.0 * avg((score <= known_score)::INT::DOUBLE) AS percentile, 1 + count(*) FILTER (score > known_score) AS rank, count(*) AS windows,
  any_value(known_score >= threshold) AS above FROM sc JOIN h USING (recording_id) JOIN th USING (recording_id) GROUP BY ALL)""", select=final(_AT, "o")))
def f7(spark, sf):
    d = detect(supplier_waves(spark, sf), 1.0, CORPUS)
    known = d.recordings.select(*REC, F.lit(100).cast("bigint").alias("w"))
    return shape(events.score_at(d.scores.withColumn("method", F.lit("detector")), known, d.limits), _AT)


_COMP = "recording_id comparable# share_percent: span_s: first_s: last_s: concentrated"


@check("f8_comparable_windows", S.query(*C[:5], """
l AS (SELECT recording_id, 0.8::DOUBLE * max(score) AS lim0, count(*) AS windows FROM sc GROUP BY ALL),
o AS (SELECT recording_id, count(*) AS comparable, 100.0 * count(*) / any_value(windows) AS share_percent, max(w * 7.0) - min(w * 7.0) AS span_s,
  min(w * 7.0) AS first_s, max(w * 7.0) AS last_s, bool_and(abs(w * 7.0 - 1200) <= 600) AND max(w * 7.0) - min(w * 7.0) <= 600 AS concentrated
  FROM sc JOIN l USING (recording_id) WHERE score >= lim0 GROUP BY recording_id)""", select=final(_COMP, "o")))
def f8(spark, sf):
    d = detect(supplier_waves(spark, sf), 1.0, CORPUS)
    context = d.recordings.select(*REC, F.lit(1200.0).alias("time_s"))
    return shape(events.comparable_windows(d.scores, context, 7, 1.0, reach=600.0), _COMP)


# G. Events ------------------------------------------------------------------------------------------------
_GROUP = "recording_id first_w# last_w# n#"


def _runs(grouped):
    return grouped.groupBy(*REC, "island").agg(F.min("w").alias("first_w"), F.max("w").alias("last_w"), F.count("*").alias("n"))


_FLAG = "fl AS (SELECT recording_id, w, score FROM sc JOIN th USING (recording_id) WHERE score >= threshold)"
_RUNS = "o AS (SELECT recording_id, min(w) AS first_w, max(w) AS last_w, count(*) AS n FROM g GROUP BY recording_id, island)"


def _flagged(spark, sf):
    d = detect(supplier_waves(spark, sf), 1.0, CORPUS)
    th = robust.global_threshold(d.scores, 1.0, max_group_rows=354)
    return d.scores.join(th, REC).where("score >= threshold").select(*REC, "w", "score")


@check("g1_merge_by_gap", S.query(*C[:5], S.threshold(mad=1.0), _FLAG, S.islands("fl", "w", "(cur - prev) * 7 > 35", "g"), _RUNS, select=final(_GROUP, "o")))
def g1(spark, sf):
    return shape(_runs(events.merge_by_gap(_flagged(spark, sf), 7, 1.0, 35.0)), _GROUP)


@check("g2_merge_by_index", S.query(*C[:5], S.threshold(mad=1.0), _FLAG, S.islands("fl", "w", "cur - prev > 3", "g"), _RUNS, select=final(_GROUP, "o")))
def g2(spark, sf):
    return shape(_runs(events.merge_by_index(_flagged(spark, sf), 2)), _GROUP)


_EVENT = "recording_id start_s: end_s: peak_s: score: confidence: involved candidate_windows# involved_count# rank#"
_RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY score DESC, start_s) AS rank FROM ev)"


def _events(d):
    return shape(d.events.withColumn("involved", F.array_join("involved_channels", ",")), _EVENT)


@check("g3_verify_events", S.query(*C, S.verified(7, 28, 35, 2, "nc"), _RANKED, select=final(_EVENT, "rk")))
def g3(spark, sf):
    return _events(detect(supplier_waves(spark, sf), 1.0, CORPUS))


@check("p1_detect", S.query(*P, S.verified(4, 24, 28, 1, "nc"), _RANKED, select=final(_EVENT, "rk")))
def p1(spark, sf):
    return _events(planted(spark, sf))


@check("p1_audit_log", S.query(*P, S.verified(4, 24, 28, 1, "nc"), """
o AS (SELECT recording_id, 0 AS step, 'observe' AS phase, 'validate' AS tool FROM nc
 UNION ALL SELECT recording_id, 1, 'act', 'feature_ensemble' FROM nc
 UNION ALL SELECT recording_id, 2 + unnest(range(used + 1)), 'reflect', 'threshold' FROM lim
 UNION ALL SELECT recording_id, 1000, 'finalize', 'verify' FROM nc)""", select=final("recording_id step# phase tool", "o")))
def p1b(spark, sf):
    return shape(planted(spark, sf).audit, "recording_id step# phase tool")


_CL = "recording_id time_s: label duration_s: member_count#"
_CLUSTER = S.islands("an", "onset", "cur - prev > 21600", "g") + """,
cl AS (SELECT recording_id, island, min(onset) AS f, max(onset) AS l, count(*) AS n, min(onset) FILTER (description = 'error') AS t FROM g GROUP BY ALL),
fi AS (SELECT recording_id, min(island) AS island FROM cl WHERE t IS NOT NULL GROUP BY ALL),
ann AS (SELECT recording_id, t AS time_s, 'error' AS label, greatest(l - f, 0.1) AS duration_s, n AS member_count FROM cl JOIN fi USING (recording_id, island))"""


@check("g5_cluster_annotations", S.query(S.annotations(), _CLUSTER, select=final(_CL, "ann")))
def g5(spark, sf):
    return shape(events.cluster_annotations(user_annotations(spark, sf), ("error",), 21_600.0), _CL)


_SEL = "recording_id time_s: duration_s: involved_count# score: confidence:"


@check("g6_select_event", S.query(*C, S.verified(7, 28, 35, 2, "nc"), """
o AS (SELECT recording_id, peak_s AS time_s, greatest(end_s - start_s, 0.1) AS duration_s, involved_count, score, confidence FROM ev
  QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY involved_count DESC, end_s - start_s DESC, score DESC, peak_s) = 1)""", select=final(_SEL, "o")))
def g6(spark, sf):
    return shape(events.select_event(detect(supplier_waves(spark, sf), 1.0, CORPUS).events), _SEL)


_RESOLVED = "recording_id tier time_s: duration_s:"
_TIERS = """
expl AS (SELECT CAST(c_nationkey AS VARCHAR) AS recording_id, min(c_acctbal) AS time_s, 2.0 AS duration_s FROM customer GROUP BY ALL),
bl AS (SELECT recording_id, peak_s AS time_s, greatest(end_s - start_s, 0.1) AS duration_s FROM ev
  QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY involved_count DESC, end_s - start_s DESC, score DESC, peak_s) = 1),
u AS (SELECT *, 0 AS o, 'explicit' AS tier FROM expl UNION ALL SELECT recording_id, time_s, duration_s, 1, 'annotation' FROM ann
  UNION ALL SELECT *, 2, 'blind' FROM bl),
res AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY o) = 1)"""


def _tiers(spark, sf):
    explicit = nation_contacts(spark, sf).groupBy(*REC).agg(F.min("c_acctbal").alias("time_s")).select(
        *REC, "time_s", F.lit("given").alias("label"), F.lit(2.0).alias("duration_s"))
    annotated = events.cluster_annotations(user_annotations(spark, sf), ("error",), 21_600.0)
    blind = events.select_event(detect(supplier_waves(spark, sf), 1.0, CORPUS).events)
    return explicit, annotated, blind


@check("g7_resolve_event", S.query(*C, S.verified(7, 28, 35, 2, "nc"), S.annotations(), _CLUSTER, _TIERS, select=final(_RESOLVED, "res")))
def g7(spark, sf):
    return shape(events.resolve_event(*_tiers(spark, sf)), _RESOLVED)


@check("g7_needs_blind", S.query(S.annotations(), _CLUSTER, "expl AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS recording_id FROM customer)",
    select="SELECT DISTINCT recording_id FROM (SELECT CAST(o_custkey AS VARCHAR) AS recording_id FROM orders) WHERE recording_id NOT IN (SELECT recording_id FROM expl) AND recording_id NOT IN (SELECT recording_id FROM ann)"))
def g7b(spark, sf):
    recordings = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("recording_id")).distinct()
    explicit = nation_contacts(spark, sf).select(*REC).distinct()
    annotated = events.cluster_annotations(user_annotations(spark, sf), ("error",), 21_600.0)
    return events.needs_blind(recordings, explicit, annotated)


_LAZY = """
expl AS (SELECT CAST(c_nationkey * 5 AS VARCHAR) AS recording_id, min(c_acctbal) AS time_s, 2.0 AS duration_s FROM customer GROUP BY ALL),
an AS (SELECT CAST(user_id * 3 AS VARCHAR) AS recording_id, (epoch_us(ts) - 1704067200000000) / 1e6 AS onset, event_type AS description, event_id FROM events)"""


@check("p2_resolved_tiers", S.query(*C, S.verified(7, 28, 35, 2, "nc"), _LAZY, _CLUSTER, _TIERS[_TIERS.index("bl AS"):], """
o AS (SELECT * FROM res WHERE recording_id IN (SELECT recording_id FROM nc))""", select=final(_RESOLVED, "o")))
def p2_tiers(spark, sf):
    """The blind scan reads the recordings of suppliers that neither a nation nor a user names."""
    s = supplier_waves(spark, sf)
    given = table(spark, sf, "customer").groupBy((F.col("c_nationkey") * 5).cast("string").alias("recording_id")).agg(F.min("c_acctbal").alias("time_s"))
    notes = user_annotations(spark, sf).withColumn("recording_id", (F.col("recording_id").cast("bigint") * 3).cast("string"))
    recordings = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("recording_id")).distinct()
    found = resolve_lazily(
        s, 1.0, recordings, notes, given.select(*REC, "time_s", F.lit("given").alias("label"), F.lit(2.0).alias("duration_s")), CORPUS, keywords=("error",), gap=21_600.0)
    return shape(found.context, _RESOLVED)


_DISTANCE = "recording_id blind_time_s: blind_score: time_s: distance_s: candidates#"


@check("g8_distance_report", S.query(*C, S.verified(7, 28, 35, 2, "nc"), """
t AS (SELECT recording_id, arg_min(w, (-score, w)) * 7.0 AS blind_time_s, max(score) AS blind_score FROM sc GROUP BY ALL),
n AS (SELECT recording_id, count(*) AS n FROM ev GROUP BY ALL),
o AS (SELECT recording_id, blind_time_s, blind_score, 1200.0 AS time_s, abs(blind_time_s - 1200.0) AS distance_s, coalesce(n, 0) AS candidates FROM t LEFT JOIN n USING (recording_id))""",
    select=final(_DISTANCE, "o")))
def g8(spark, sf):
    d = detect(supplier_waves(spark, sf), 1.0, CORPUS)
    return shape(events.distance_report(d.scores, d.events, d.recordings.select(*REC, F.lit(1200.0).alias("time_s")), 7, 1.0), _DISTANCE)


# B. Guards and notes that need detector output -----------------------------------------------------------
@check("b11_guards", S.query(S.hourly(gaps=True), """
c AS (SELECT recording_id, channel, count(v) AS p, count(*) - count(v) AS m, max(i) + 1 AS n FROM s GROUP BY ALL),
o AS (SELECT recording_id, sum(p) / (sum(p) + sum(m)) AS quality, count(*) AS n_channels, max(n) AS n_samples FROM c GROUP BY ALL)""",
    select="SELECT recording_id, round(quality, 6) AS quality, n_samples >= 24 AS long_enough, quality >= 0.8 AS good_enough, true AS unique_names FROM o"))
def b11(spark, sf):
    r = recordings_of(summarise(hourly(spark, sf, gaps=True)))
    return cleaning.guard_report(r, 24, 0.8).withColumn("quality", F.round("quality", 6))


@check("b12_run_note", S.query(*C, S.verified(7, 28, 35, 2, "nc"), """
n AS (SELECT recording_id, count(*) AS n FROM ev GROUP BY ALL),
b AS (SELECT recording_id, peak_s, involved_count, score FROM ev
  QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY involved_count DESC, end_s - start_s DESC, score DESC, peak_s) = 1)""", select="""
SELECT nc.recording_id, nc.recording_id || ' [none]: ' || coalesce(n, 0) || ' candidate(s); ' || CASE WHEN b.peak_s IS NULL THEN 'no event context'
  ELSE format('auto-detected event at {:.3f}s ({:d} channels, score={:.2f})', peak_s, involved_count, score) END AS note
FROM nc LEFT JOIN n USING (recording_id) LEFT JOIN b USING (recording_id)"""))
def b12(spark, sf):
    d = detect(supplier_waves(spark, sf), 1.0, CORPUS)
    blind = events.select_event(d.events)
    context = blind.withColumn("tier", F.lit("blind"))
    return events.run_notes(d.recordings, d.events, context, "none")
