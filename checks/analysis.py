"""Checks of recruitment, graphs, diffusion, wavelets, ensemble and residual operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from checks import sql as S
from checks.fixtures import DAYS, HOURS, embedding_waves, hourly, recording_event, supplier_days, supplier_waves, table
from checks.registry import check, final, shape
from checks.scoring import C, CORPUS, P, planted
from wavecairn.config import DetectorConfig, EnsembleConfig, RecruitmentConfig, ReservoirConfig
from wavecairn.functions import arrays
from wavecairn.functions.wavelets import band_names, taps, with_dwt
from wavecairn.operators import ensemble, events, features, graph, recruit, residual, robust, spectral
from wavecairn.operators.framing import CHANNEL, crop, spans
from wavecairn.plans import analyse as A
from wavecairn.plans import ensemble as PE
from wavecairn.plans import temporal as PT
from wavecairn.plans.detect import detect
from wavecairn.plans.residual import residual_detect
from wavecairn.sources import tables
from wavecairn.session import cut_lineage, shared_folder

K = "recording_id channel ch_index#"
REC = ["recording_id"]
REGION = (("L", 2, 4),)
AT, BASE, AFTER = 1200.0, 600.0, 200.0


# H. Recruitment ----------------------------------------------------------------------------------------------
def energy_z(spark, sf):
    return cut_lineage(recruit.whole_energy_z(supplier_waves(spark, sf), 28, 7, DAYS, lambda w: w * 7 + 14.0, AT, BASE))


def roles_of(spark, sf, z=None):
    found = recruit.recruitment(z if z is not None else energy_z(spark, sf), AFTER)
    return cut_lineage(recruit.assign_roles(found, RecruitmentConfig(roi_slack_seconds=50, first_slack_seconds=10), REGION))


ZC = [S.supplier_days(), S.windows("s", 28, 7, DAYS), """
en AS (SELECT recording_id, channel, ch_index, w, w * 7 + 14.0::DOUBLE AS t, avg(v * v) AS energy FROM win GROUP BY ALL)""",
      S.z("en", "ez", S.K, ["energy"], where=f"t >= {AT - BASE} AND t < {AT}", clip=(0, 50), eps=1e-20, fallback="floor"),
      "zz AS (SELECT recording_id, channel, ch_index, w, t, energy_z AS z FROM ez)"]
RC = [*ZC, f"""
rec AS (SELECT recording_id, channel, ch_index, max(z) AS peak_z, min(t) FILTER (z >= 6.0) - {AT} AS latency FROM zz
  WHERE t BETWEEN {AT} AND {AT + AFTER} GROUP BY ALL)""", """
r1 AS (SELECT *, min(latency) OVER p AS f, coalesce(ch_index BETWEEN 1 AND 3 AND latency <= min(latency) OVER p + 50, false) AS reg FROM rec
  WINDOW p AS (PARTITION BY recording_id)),
r2 AS (SELECT *, bool_or(reg) OVER (PARTITION BY recording_id) AS anyr, coalesce(latency <= f + 10, false) AS early FROM r1),
r3 AS (SELECT *, CASE WHEN anyr THEN reg ELSE early END AS init FROM r2),
roles AS (SELECT recording_id, channel, ch_index, peak_z, latency, CASE WHEN init THEN 'initiator' WHEN latency IS NOT NULL AND NOT early THEN 'later' END AS role,
  CASE WHEN latency IS NOT NULL THEN row_number() OVER (PARTITION BY recording_id ORDER BY latency NULLS LAST, ch_index) END AS recruit_order FROM r3)"""]

_BZ = f"{K} w# t: z:"


@check("h1_energy_z", S.query(*ZC, select=final(_BZ, "zz")))
def h1(spark, sf):
    return shape(energy_z(spark, sf), _BZ)


FAST = RecruitmentConfig(baseline_seconds=1.5, analysis_seconds=0.5, window_seconds=0.1, step_seconds=0.02)
DET = DetectorConfig(window_seconds=0.12, step_seconds=0.02, threshold_mad=2.5, merge_gap_seconds=0.02, min_involved_channels=1)


@check("h1_band_z")
def h1b(spark, sf):
    """End to end with the band-pass filter; the hourly grid is read as 200 samples per second."""
    s = hourly(spark, sf, planted=True)
    return shape(A.band_z(s, recording_event(s, 2.0), 200.0, FAST), _BZ)


_RECR = f"{K} peak_z: latency:"


@check("h2_recruitment", S.query(*RC[:-1], select=final(_RECR, "rec")))
def h2(spark, sf):
    return shape(recruit.recruitment(energy_z(spark, sf), AFTER), _RECR)


_ROLE = f"{K} peak_z: latency: role recruit_order#"


@check("h3_roles", S.query(*RC, select=final(_ROLE, "roles")))
def h3(spark, sf):
    return shape(roles_of(spark, sf), _ROLE)


_EVO = f"{K} row# w# t_rel: z: colour_cap:"


@check("h4_evolution_matrix", S.query(*RC, f"""
c AS (SELECT zz.recording_id, zz.channel, zz.ch_index, recruit_order AS row, w, t - {AT} AS t_rel, z FROM zz JOIN roles USING (recording_id, channel) WHERE latency IS NOT NULL),
cap AS (SELECT recording_id, greatest(6.0, quantile_cont(z, 0.99)) AS colour_cap FROM c GROUP BY ALL),
o AS (SELECT c.*, colour_cap FROM c JOIN cap USING (recording_id))""", select=final(_EVO, "o")))
def h4(spark, sf):
    z = energy_z(spark, sf)
    return shape(recruit.evolution_matrix(z, roles_of(spark, sf, z)), _EVO)


_OUT = f"{K} position# method"


@check("h5_select_outputs", S.query(*RC, """
inv AS (SELECT *, count(*) FILTER (role = 'initiator') OVER r AS ni, count(*) FILTER (role = 'later') OVER r AS nl,
  row_number() OVER (PARTITION BY recording_id, role ORDER BY recruit_order) AS k, row_number() OVER (PARTITION BY recording_id, role ORDER BY ch_index) AS c,
  row_number() OVER (PARTITION BY recording_id ORDER BY recruit_order) AS allk FROM roles WHERE latency IS NOT NULL WINDOW r AS (PARTITION BY recording_id)),
st AS (SELECT *, 3 - ni AS budget, greatest(1, nl // greatest(3 - ni, 1)) AS stride FROM inv),
pos AS (SELECT *, CASE WHEN role = 'initiator' THEN c WHEN role = 'later' AND budget > 0 AND (k - 1) % stride = 0 AND (k - 1) // stride < budget THEN ni + (k - 1) // stride + 1
  WHEN ni = 0 AND (nl = 0 OR budget <= 0) THEN allk END AS position FROM st),
vp AS (SELECT recording_id, channel, ch_index, var_pop(v) AS variance FROM s GROUP BY ALL),
var AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY variance DESC, ch_index) AS rank FROM vp),
o AS (SELECT recording_id, channel, ch_index, position, 'brain_process_initiators_plus_spread' AS method FROM pos WHERE position <= 3
  UNION ALL SELECT recording_id, channel, ch_index, row_number() OVER (PARTITION BY recording_id ORDER BY ch_index), 'highest_variance_fallback'
  FROM var WHERE rank <= 3 AND recording_id NOT IN (SELECT recording_id FROM inv))""", select=final(_OUT, "o")))
def h5(spark, sf):
    return shape(recruit.select_outputs(roles_of(spark, sf), features.variance_rank(supplier_waves(spark, sf), 3), 3), _OUT)


_SHARE = "recording_id involved# channels# percent:"


@check("h6_involved_share", S.query(*RC, """
o AS (SELECT recording_id, count(latency) AS involved, count(*) AS channels, 100.0 * count(latency) / count(*) AS percent FROM roles GROUP BY ALL)""", select=final(_SHARE, "o")))
def h6(spark, sf):
    return shape(recruit.involved_share(roles_of(spark, sf)), _SHARE)


_SUMMARY_SQL = """
nm AS (SELECT recording_id, list(channel ORDER BY recruit_order) AS names, coalesce(list(channel ORDER BY ch_index) FILTER (role = 'initiator'), []) AS ini,
  coalesce(list(channel ORDER BY recruit_order) FILTER (role = 'later'), []) AS lat, min(latency) AS a, max(latency) AS b, count(*) AS n
  FROM roles WHERE latency IS NOT NULL GROUP BY ALL),
al AS (SELECT DISTINCT recording_id FROM roles)"""


@check("b8_describe_source", S.query(*RC, _SUMMARY_SQL, select=f"""
SELECT al.recording_id, CASE WHEN n IS NULL THEN 'No channel crossed the recruitment threshold around {AT:.3f} s: no source could be located.' ELSE
 'Reference (peak) time: {AT:.3f} s from EDF start; all latencies below are measured relative to it.' || chr(10) ||
 'Likely source: ' || array_to_string(CASE WHEN len(ini) > 0 THEN ini ELSE names[1:1] END, ', ') || ' — first channel(s) to cross the 6-MAD recruitment threshold, at '
 || format('{{:.3f}}', {AT} + a) || ' s (' || format('{{:+.3f}}', a) || ' s relative to the reference time).' || chr(10) ||
 'Involved channels: ' || n || ' total, recruited between ' || format('{{:+.3f}}', a) || ' s and ' || format('{{:+.3f}}', b) || ' s relative to the reference time (' || names[-1] || ' last).'
 || CASE WHEN len(lat) > 0 THEN chr(10) || 'Later-recruited (spread beyond the source): ' || array_to_string(lat[1:15], ', ') || CASE WHEN len(lat) > 15 THEN ', ...' ELSE '' END ELSE '' END
 END AS summary FROM al LEFT JOIN nm USING (recording_id)"""))
def b8(spark, sf):
    roles = roles_of(spark, sf)
    return recruit.describe_source(roles, roles.select(*REC, "time_s").distinct())


# I. Graphs -----------------------------------------------------------------------------------------------------
_PEARSON = "coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 0)"
_CORR = f"""
iz AS (SELECT zz.* FROM zz JOIN roles USING (recording_id, channel) WHERE latency IS NOT NULL),
lk AS (SELECT a.recording_id, a.channel, a.ch_index, b.channel AS other, b.ch_index AS other_index, {_PEARSON.format(a='a.z', b='b.z')} AS r
  FROM iz a JOIN iz b ON a.recording_id = b.recording_id AND a.w = b.w AND a.ch_index <> b.ch_index GROUP BY ALL)"""
_LINK = "recording_id channel other r:"


def _prune(k: int, threshold: float, by: str = "recording_id", links: str = "lk", name: str = "ed") -> str:
    return f"""
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY {by}, ch_index ORDER BY round(abs(r), 9) DESC, other_index) AS rk FROM {links} WHERE abs(r) >= {threshold}),
{name} AS (SELECT {by}, CASE WHEN ch_index < other_index THEN channel ELSE other END AS src, CASE WHEN ch_index < other_index THEN other ELSE channel END AS dst,
  any_value(r) AS weight FROM {name}_n WHERE rk <= {k} GROUP BY ALL)"""


def links_of(spark, sf, threshold, strongest=None, z=None, roles=None):
    z = z if z is not None else energy_z(spark, sf)
    roles = roles if roles is not None else roles_of(spark, sf, z)
    z = z.join(roles.where("latency is not null").select(*REC, "channel"), [*REC, "channel"], "left_semi")
    return graph.correlation_links(graph.series_vectors(z), REC, threshold, 7, strongest)


@check("i1_pairwise_corr", S.query(*RC, _CORR, select=final(_LINK, "lk WHERE abs(r) >= 0.25")))
def i1(spark, sf):
    return shape(links_of(spark, sf, 0.25), _LINK)


@check("d6_strongest_partner", S.query(*RC, _CORR, select=final(_LINK, "(SELECT * FROM lk WHERE abs(r) >= 0.01 QUALIFY row_number() OVER (PARTITION BY recording_id, ch_index ORDER BY round(abs(r), 9) DESC, other_index) = 1)")))
def d6(spark, sf):
    """Every pair of channels is compared inside the tiles; only the best partner leaves the task."""
    return shape(links_of(spark, sf, 0.01, 1), _LINK)


_EDGE = "recording_id src dst weight:"


def edges_of(spark, sf, z=None, roles=None):
    return graph.prune_edges(links_of(spark, sf, 0.15, 2, z, roles), REC, 2)


def parts_of(spark, sf):
    """z, roles and edges of the corpus, each computed once."""
    z = energy_z(spark, sf)
    roles = roles_of(spark, sf, z)
    return z, roles, cut_lineage(edges_of(spark, sf, z, roles))


@check("i2_prune_edges", S.query(*RC, _CORR, _prune(2, 0.15), select=final(_EDGE, "ed")))
def i2(spark, sf):
    return shape(edges_of(spark, sf), _EDGE)


@check("i3_recruitment_edges", S.query(*RC, select=final(_EDGE, "(SELECT recording_id, 'PEAK' AS src, channel AS dst, 1.0 / (1.0 + latency) AS weight FROM roles WHERE latency IS NOT NULL)")))
def i3(spark, sf):
    return shape(graph.recruitment_edges(roles_of(spark, sf)), _EDGE)


_NODE = "recording_id channel latency: peak_z: is_initiator"


@check("i4_graph_nodes", S.query(*RC, select=final(_NODE, "(SELECT *, coalesce(role, '') = 'initiator' AS is_initiator FROM roles WHERE latency IS NOT NULL)")))
def i4(spark, sf):
    return shape(graph.graph_nodes(roles_of(spark, sf)), _NODE)


_CNT = "recording_id nodes# edges#"


@check("i8_graph_counts", S.query(*RC, _CORR, _prune(2, 0.15), """
n AS (SELECT recording_id, count(*) AS nodes FROM roles WHERE latency IS NOT NULL GROUP BY ALL), e AS (SELECT recording_id, count(*) AS edges FROM ed GROUP BY ALL),
o AS (SELECT recording_id, nodes, coalesce(edges, 0) AS edges FROM n LEFT JOIN e USING (recording_id))""", select=final(_CNT, "o")))
def i8(spark, sf):
    _, roles, edges = parts_of(spark, sf)
    return shape(graph.graph_counts(graph.graph_nodes(roles), edges), _CNT)


# L. Wavelets ------------------------------------------------------------------------------------------------
def dwt_sql(source: str, column: str, level: int, wavelet: str = "db4", name: str = "dw") -> str:
    low, high = taps(wavelet)
    width = len(low)
    parts = [f"{name}_0 AS (SELECT *, {column} AS ap FROM {source})"]
    for k in range(1, level + 1):
        coeff = lambda t: " + ".join(f"({v}::DOUBLE) * pad[2 * k + {width - j + 1}]" for j, v in enumerate(t))
        parts.append(f"""
{name}_p{k} AS (SELECT *, len(ap) AS n, list_concat(list_concat(list_reverse(ap[1:{width - 1}]), ap), list_reverse(ap[len(ap) - {width - 2}:len(ap)])) AS pad FROM {name}_{k - 1}),
{name}_{k} AS (SELECT * EXCLUDE (pad, n, ap), list_transform(range(0, (n + {width - 1}) // 2), lambda k: {coeff(low)}) AS ap,
  list_transform(range(0, (n + {width - 1}) // 2), lambda k: {coeff(high)}) AS band_d{k} FROM {name}_p{k})""")
    parts.append(f"{name} AS (SELECT * EXCLUDE (ap), ap AS band_a{level} FROM {name}_{level})")
    return ",".join(parts)


def _energy_sql(band: str) -> str:
    return f"ln(1 + list_avg(list_transform({band}, lambda x: x * x)))"


def _standard_sql(band: str) -> str:
    return f"list_transform({band}, lambda x: (x - list_avg({band})) / (list_aggregate({band}, 'stddev_pop') + 1e-12))"


_BANDS = f"{K} w# band pos# x:"


@check("l1_dwt", S.query(S.waves(), dwt_sql("wv", "wave", 3), """
o AS (""" + " UNION ALL ".join(f"SELECT recording_id, channel, ch_index, w, '{b}' AS band, unnest(range(len({b}))) AS pos, unnest({b}) AS x FROM dw" for b in band_names(3)) + ")", select=final(_BANDS, "o")))
def l1(spark, sf):
    bands = with_dwt(embedding_waves(spark, sf), "wave", "db4", 3)
    tall = bands.select(*CHANNEL, "w", F.explode(F.create_map(*[p for b in band_names(3) for p in (F.lit(b), F.col(b))])).alias("band", "v"))
    return shape(tall.select(*CHANNEL, "w", "band", F.posexplode("v").alias("pos", "x")), _BANDS)


_REP = f"{K} w# kind pos# x:"


@check("l2_wavelet_representation", S.query(S.waves(), dwt_sql("wv", "wave", 3), f"""
rp AS (SELECT recording_id, channel, ch_index, w, [{', '.join(_energy_sql(b) for b in band_names(3))}] AS energies,
  [list_avg(wave), list_aggregate(wave, 'stddev_pop'), sqrt(list_avg(list_transform(wave, lambda x: x * x))),
   list_avg(list_transform(range(1, 64), lambda k: abs(wave[k + 1] - wave[k])))] AS stats,
  flatten([{', '.join(_standard_sql(b) for b in band_names(3))}]) AS x FROM dw),
o AS (""" + " UNION ALL ".join(f"SELECT recording_id, channel, ch_index, w, '{c}' AS kind, unnest(range(len({c}))) AS pos, unnest({c}) AS x FROM rp" for c in ("energies", "stats", "x")) + ")", select=final(_REP, "o")))
def l2(spark, sf):
    rep = ensemble.wavelet_representation(embedding_waves(spark, sf), "db4", 3)
    kinds = ("energies", "stats", "x")
    tall = rep.select(*CHANNEL, "w", F.explode(F.create_map(*[p for c in kinds for p in (F.lit(c), F.col(c))])).alias("kind", "v"))
    return shape(tall.select(*CHANNEL, "w", "kind", F.posexplode("v").alias("pos", "x")), _REP)


_K3 = f"{K} w# pos# x:"


@check("k3_dwt_detail_energy", S.query(S.waves(), dwt_sql("wv", "wave", 3), f"""
e AS (SELECT recording_id, channel, ch_index, w, [{', '.join(_energy_sql(b) for b in band_names(3)[1:])}] AS d FROM dw),
o AS (SELECT recording_id, channel, ch_index, w, unnest(range(3)) AS pos, unnest(d) AS x FROM e)""", select=final(_K3, "o")))
def k3(spark, sf):
    return shape(ensemble.dwt_energies(embedding_waves(spark, sf), "db4", 3).select(*CHANNEL, "w", F.posexplode("detail_energies").alias("pos", "x")), _K3)


# Temporal graph on 64-day windows of the supplier recordings.
WW = [S.supplier_days(), """
wv AS (SELECT recording_id, channel, ch_index, i // 64 AS w, list(v ORDER BY i) AS wave FROM s GROUP BY ALL HAVING count(*) = 64)""",
      dwt_sql("wv", "wave", 3), f"""
rp AS (SELECT recording_id, channel, ch_index, w, [{', '.join(_energy_sql(b) for b in band_names(3))}] AS energies,
  flatten([{', '.join(_standard_sql(b) for b in band_names(3))}]) AS x FROM dw)"""]
_WLINK = """
xl AS (SELECT recording_id, channel, ch_index, w, unnest(range(len(x))) AS p, unnest(x) AS v FROM rp),
lk AS (SELECT a.recording_id, a.w, a.channel, a.ch_index, b.channel AS other, b.ch_index AS other_index, """ + _PEARSON.format(a="a.v", b="b.v") + """ AS r
  FROM xl a JOIN xl b ON a.recording_id = b.recording_id AND a.w = b.w AND a.p = b.p AND a.ch_index <> b.ch_index GROUP BY ALL)"""
_TEDGE = "recording_id w# src dst weight: known_event"


def temporal(spark, sf):
    s = supplier_waves(spark, sf)
    return PT.temporal_graph(s, 64, 7, F.col("channel").isin("L2", "L3"), recording_event(s, AT), 1.0, exclude=r"^L2$")


@check("i5_temporal_graph", S.query(*WW, _WLINK, _prune(6, 0.65, "recording_id, w"), select=final(_TEDGE, "(SELECT *, w = 18 AS known_event FROM ed)")))
def i5(spark, sf):
    return shape(temporal(spark, sf).edges, _TEDGE)


_SC = """
ce AS (SELECT recording_id, channel, ch_index, w, (energies[2] + energies[3] + energies[4]) / 3 AS e FROM rp),
es AS (SELECT recording_id, w, avg(e) AS score FROM ce WHERE channel IN ('L2', 'L3') GROUP BY ALL)"""


@check("i6_event_score", S.query(*WW, _SC, select=final("recording_id w# score:", "es")))
def i6(spark, sf):
    return shape(temporal(spark, sf).score, "recording_id w# score:")


_COR = f"{K} correlation: top# bottom#"


@check("i7_channel_score_corr", S.query(*WW, _SC, """
cr AS (SELECT recording_id, channel, ch_index, covar_pop(e, score) / nullif(stddev_pop(e) * stddev_pop(score), 0) AS correlation
  FROM ce JOIN es USING (recording_id, w) WHERE channel <> 'L2' GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY correlation DESC, ch_index) AS top,
  row_number() OVER (PARTITION BY recording_id ORDER BY correlation, ch_index DESC) AS bottom FROM cr WHERE correlation IS NOT NULL)""", select=final(_COR, "o WHERE top <= 2 OR bottom <= 2")))
def i7(spark, sf):
    s = supplier_waves(spark, sf)
    feats = cut_lineage(PT.window_vectors(s, 64).select(*CHANNEL, "w", "energies"))
    score = graph.detail_energy_score(feats, F.col("channel").isin("L2", "L3"))
    return shape(graph.extremes(graph.channel_score_corr(feats, score, r"^L2$"), "correlation", 2), _COR)


@check("p6_temporal_known", S.query(*WW, _SC, """
k AS (SELECT recording_id, score AS known_score FROM es WHERE w = 18),
o AS (SELECT recording_id, any_value(known_score) AS known_score, 100.0 * avg((score <= known_score)::INT::DOUBLE) AS percentile,
  1 + count(*) FILTER (score > known_score) AS rank FROM es JOIN k USING (recording_id) GROUP BY ALL)""", select=final("recording_id known_score: percentile: rank#", "o")))
def p6(spark, sf):
    return shape(temporal(spark, sf).known, "recording_id known_score: percentile: rank#")


@check("a10_graph_reload", S.query(*WW, _WLINK, _prune(6, 0.65, "recording_id, w"), select=final("recording_id src dst weight:", "ed WHERE w = 18")))
def a10(spark, sf):
    stored = tables.write_graph(temporal(spark, sf).edges.select(*REC, "w", "src", "dst", "weight"))
    return shape(tables.read_window(stored, 18), "recording_id src dst weight:")


_TNODE = f"{K} w# a: d1: mean: line_length: known_channel known_event"


@check("a10_graph_nodes", S.query(*WW, """
st AS (SELECT recording_id, channel, w, avg(v) AS mean, avg(abs(d)) AS line_length FROM (
    SELECT *, i // 64 AS w, v - lag(v) OVER (PARTITION BY recording_id, channel, i // 64 ORDER BY i) AS d FROM s) GROUP BY ALL),
o AS (SELECT rp.recording_id, rp.channel, ch_index, rp.w, energies[1] AS a, energies[4] AS d1, mean, line_length, rp.channel IN ('L2', 'L3') AS known_channel,
    rp.w = 18 AS known_event FROM rp JOIN st USING (recording_id, channel, w))""", select=final(_TNODE, "o WHERE w BETWEEN 15 AND 20")))
def a10_nodes(spark, sf):
    """Stored nodes with their feature arrays, reloaded for a range of windows."""
    s = supplier_waves(spark, sf)
    feats = cut_lineage(PT.window_vectors(s, 64).select(*CHANNEL, "w", "energies", "stats"))
    nodes = graph.window_nodes(feats, recording_event(s, AT), 1.0, 64, F.col("channel").isin("L2", "L3"))
    back = tables.read_windows(tables.write_nodes(nodes), 15, 20)
    at = lambda k: F.get("features", F.lit(k))
    return shape(back.withColumns({"a": at(0), "d1": at(3), "mean": at(4), "line_length": at(7)}), _TNODE)


_STATUS = f"{K} time_s: baseline_windows# analysis_windows# status"


@check("b11_event_guards", S.query(S.supplier_days(), """
ev0 AS (SELECT CAST(c_nationkey AS VARCHAR) AS recording_id, arg_min(c_acctbal, c_custkey) / 4 AS time_s FROM customer GROUP BY ALL),
ch AS (SELECT recording_id, channel, ch_index, min(i) AS lo, max(i) AS hi FROM s GROUP BY ALL),
j AS (SELECT ch.*, time_s, greatest(0.0, time_s - 600) AS st, floor(greatest(0.0, time_s - 600)) AS b, ceil(time_s + 200 + 0.5) AS e FROM ch LEFT JOIN ev0 USING (recording_id)),
win0 AS (SELECT recording_id, channel, time_s, st + (w.range * 7 + 14.0) AS t FROM j, range(400) w
  WHERE b + w.range * 7 >= lo AND b + w.range * 7 + 28 <= least(hi + 1, e)),
n AS (SELECT recording_id, channel, count(*) FILTER (t < time_s) AS bw, count(*) FILTER (t BETWEEN time_s AND time_s + 200) AS aw FROM win0 GROUP BY ALL),
o AS (SELECT j.recording_id, j.channel, ch_index, time_s, coalesce(bw, 0) AS baseline_windows, coalesce(aw, 0) AS analysis_windows,
  CASE WHEN time_s IS NULL THEN 'no event' WHEN time_s < 0 OR time_s > hi THEN 'event outside the recording' WHEN coalesce(bw, 0) < 4 THEN 'insufficient baseline'
  WHEN coalesce(aw, 0) < 1 THEN 'no window after the event' ELSE '' END AS status FROM j LEFT JOIN n USING (recording_id, channel))""", select=final(_STATUS, "o")))
def b11_events(spark, sf):
    """Events outside their recording, with a short baseline or none at all have a row with the reason."""
    given = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("string").alias("recording_id")).agg((F.min_by("c_acctbal", "c_custkey") / 4).alias("time_s"))
    return shape(recruit.context_status(spans(supplier_waves(spark, sf)), given, 28, 7, 1.0, BASE, AFTER), _STATUS)


# J. Diffusion ---------------------------------------------------------------------------------------------------
_TW = """
both2 AS (SELECT recording_id, src, dst, abs(weight) AS m FROM ed UNION ALL SELECT recording_id, dst, src, abs(weight) FROM ed),
tw AS (SELECT recording_id, src, dst, m / sum(m) OVER (PARTITION BY recording_id, src) AS p FROM both2)"""


@check("j1_degree_normalise", S.query(*RC, _CORR, _prune(2, 0.15), _TW, select=final("recording_id src dst p:", "tw")))
def j1(spark, sf):
    _, roles, edges = parts_of(spark, sf)
    return shape(graph.transition_weights(edges, graph.graph_nodes(roles)), "recording_id src dst p:")


def _diffuse_sql(steps: int, alpha: float) -> str:
    parts = ["h0 AS (SELECT recording_id, channel, 0 AS step, peak_z AS h FROM roles WHERE latency IS NOT NULL)"]
    for k in range(1, steps + 1):
        parts.append(f"""
h{k} AS (SELECT h.recording_id, h.channel, {k} AS step, {alpha}::DOUBLE * any_value(h.h) + {1 - alpha}::DOUBLE * coalesce(sum(p * g.h), 0) AS h
  FROM h{k - 1} h LEFT JOIN tw ON tw.recording_id = h.recording_id AND tw.src = h.channel
  LEFT JOIN h{k - 1} g ON g.recording_id = tw.recording_id AND g.channel = tw.dst GROUP BY h.recording_id, h.channel)""")
    parts.append("hs AS (" + " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(steps + 1)) + ")")
    return ",".join(parts)


def states_of(spark, sf):
    z, roles, edges = parts_of(spark, sf)
    return z, graph.diffuse(graph.graph_nodes(roles), edges, 6, 0.5)


@check("j2_diffuse", S.query(*RC, _CORR, _prune(2, 0.15), _TW, _diffuse_sql(6, 0.5), select=final("recording_id channel step# h:", "hs")))
def j2(spark, sf):
    return shape(states_of(spark, sf)[1], "recording_id channel step# h:")


_EVAL_SQL = f"""
ks AS (SELECT k AS step, {AT} + k * {AFTER / 6}::DOUBLE AS kt, k * {AFTER / 6}::DOUBLE AS elapsed_s FROM range(7) t(k)),
nt AS (SELECT step, any_value(elapsed_s) AS elapsed_s, arg_min(t, (abs(t - kt), t)) AS t FROM ks, (SELECT DISTINCT t FROM zz) GROUP BY step),
ev6 AS (SELECT hs.recording_id, step, any_value(elapsed_s) AS elapsed_s, CASE WHEN stddev_pop(h) >= 1e-12 AND stddev_pop(z) >= 1e-12
  THEN covar_pop(h, z) / (stddev_pop(h) * stddev_pop(z)) END AS correlation
  FROM hs JOIN nt USING (step) JOIN zz ON zz.recording_id = hs.recording_id AND zz.channel = hs.channel AND zz.t = nt.t GROUP BY hs.recording_id, step)"""


@check("j3_evaluate_diffusion", S.query(*RC, _CORR, _prune(2, 0.15), _TW, _diffuse_sql(6, 0.5), _EVAL_SQL, select=final("recording_id step# elapsed_s: correlation:", "ev6")))
def j3(spark, sf):
    z, states = states_of(spark, sf)
    return shape(graph.evaluate_diffusion(states, z, 6, AFTER), "recording_id step# elapsed_s: correlation:")


_SUM = "recording_id n_channels_analysed# n_detected_candidates# n_involved_channels# initiators co_activation_edges# best_correlation: mean_correlation:"


def _both(text: str) -> str:
    """The same SQL over both references; of a pair, either end may lie in the region."""
    return text.replace("ch_index BETWEEN 1 AND 3", "(ch_index BETWEEN 1 AND 3 OR (ch_index = 0 AND recording_id LIKE '%bipolar'))")


_SUMMARY_SQL = """
a AS (SELECT recording_id, count(*) AS n_detected_candidates FROM ev GROUP BY ALL),
b AS (SELECT recording_id, count(latency) AS n_involved_channels, coalesce(string_agg(CASE WHEN role = 'initiator' THEN channel END, ',' ORDER BY ch_index), '') AS initiators FROM roles GROUP BY ALL),
c AS (SELECT recording_id, count(*) AS co_activation_edges FROM ed GROUP BY ALL),
d AS (SELECT recording_id, max(correlation) AS best_correlation, avg(correlation) AS mean_correlation FROM ev6 GROUP BY ALL),
o AS (SELECT recording_id, n_channels AS n_channels_analysed, coalesce(n_detected_candidates, 0) AS n_detected_candidates, coalesce(n_involved_channels, 0) AS n_involved_channels,
  initiators, co_activation_edges, best_correlation, mean_correlation FROM nc LEFT JOIN a USING (recording_id) LEFT JOIN b USING (recording_id) LEFT JOIN c USING (recording_id) LEFT JOIN d USING (recording_id)),
m AS (SELECT split_part(recording_id, '#', 1) AS recording_id, split_part(recording_id, '#', 2) AS montage, * EXCLUDE (recording_id) FROM o)"""
_REFERENCES = """
s0p AS (SELECT a.recording_id, a.i, a.ch_index, 'L' || (a.ch_index + 1) || '-' || (b.ch_index + 1) AS channel, a.v - b.v AS v,
    dense_rank() OVER (PARTITION BY a.recording_id ORDER BY a.ch_index) - 1 AS pair
  FROM s0 a JOIN (SELECT recording_id, ch_index, lead(ch_index) OVER (PARTITION BY recording_id ORDER BY ch_index) AS nx FROM (SELECT DISTINCT recording_id, ch_index FROM s0)) n
    ON n.recording_id = a.recording_id AND n.ch_index = a.ch_index JOIN s0 b ON b.recording_id = a.recording_id AND b.i = a.i AND b.ch_index = n.nx),
s AS (SELECT recording_id || '#none' AS recording_id, channel, ch_index, i, v FROM s0
  UNION ALL SELECT recording_id || '#bipolar', channel, pair, i, v FROM s0p)"""


@check("a9_comparison", S.query(S.supplier_days("s0"), _REFERENCES, *C[1:], S.verified(7, 28, 35, 2, "nc"), *[_both(x) for x in RC[2:]], _CORR, _prune(2, 0.15), _TW, _diffuse_sql(6, 0.5), _EVAL_SQL, _SUMMARY_SQL,
    select=final("recording_id montage " + _SUM.removeprefix("recording_id "), "m")))
def a9_comparison(spark, sf):
    """Comparison documents of both references, written as text and read back row by row."""
    s = cut_lineage(A.with_montage(supplier_waves(spark, sf)))
    d = detect(s, 1.0, CORPUS)
    energy = features.band_energy(s, 28, 7, F.lit(DAYS)).withColumn("t", F.col("w") * 7 + 14.0).withColumn("time_s", F.lit(AT))
    z = cut_lineage(recruit.standardise_energy(cut_lineage(energy), BASE, 354))
    roles = roles_of(spark, sf, z)
    edges = cut_lineage(edges_of(spark, sf, z, roles))
    states = graph.diffuse(graph.graph_nodes(roles), edges)
    rows = A.split_montage(A.summarise_runs(d.recordings, d.events, roles, edges, graph.evaluate_diffusion(states, z, 6, AFTER)))
    path = f"{shared_folder(spark)}/comparison-{uuid.uuid4().hex}"
    tables.write_reports(tables.comparison_json(rows), path)
    back = tables.read_comparison(spark, path, rows)
    return shape(back.withColumn("initiators", F.coalesce(F.array_join("likely_initiators", ","), F.lit(""))), "recording_id montage " + _SUM.removeprefix("recording_id "))


@check("p3_montage_summary", S.query(*C, S.verified(7, 28, 35, 2, "nc"), *RC[2:], _CORR, _prune(2, 0.15), _TW, _diffuse_sql(6, 0.5), _EVAL_SQL, """
a AS (SELECT recording_id, count(*) AS n_detected_candidates FROM ev GROUP BY ALL),
b AS (SELECT recording_id, count(latency) AS n_involved_channels, coalesce(string_agg(CASE WHEN role = 'initiator' THEN channel END, ',' ORDER BY ch_index), '') AS initiators FROM roles GROUP BY ALL),
c AS (SELECT recording_id, count(*) AS co_activation_edges FROM ed GROUP BY ALL),
d AS (SELECT recording_id, max(correlation) AS best_correlation, avg(correlation) AS mean_correlation FROM ev6 GROUP BY ALL),
o AS (SELECT recording_id, n_channels AS n_channels_analysed, coalesce(n_detected_candidates, 0) AS n_detected_candidates, coalesce(n_involved_channels, 0) AS n_involved_channels,
  initiators, co_activation_edges, best_correlation, mean_correlation FROM nc LEFT JOIN a USING (recording_id) LEFT JOIN b USING (recording_id) LEFT JOIN c USING (recording_id) LEFT JOIN d USING (recording_id))""",
    select=final(_SUM, "o")))
def p3(spark, sf):
    d = detect(supplier_waves(spark, sf), 1.0, CORPUS)
    z, roles, edges = parts_of(spark, sf)
    states = graph.diffuse(graph.graph_nodes(roles), edges)
    out = A.summarise_runs(d.recordings, d.events, roles, edges, graph.evaluate_diffusion(states, z, 6, AFTER))
    return shape(out.withColumn("initiators", F.array_join("likely_initiators", ",")), _SUM)
