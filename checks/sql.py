"""DuckDB side of the checks: fixture CTEs and small generators for repeated query parts."""

from __future__ import annotations

from checks.fixtures import CONTACTS, DAYS, HOURS, SHAFTS

K = "recording_id, channel, ch_index"


def _case(column: str, mapping: dict[str, object]) -> str:
    whens = " ".join(
        f"WHEN '{k}' THEN " + (str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'")
        for k, v in mapping.items()
    )
    return f"CASE {column} {whens} END"


def hourly(name: str = "s", gaps: bool = False, planted: bool = False) -> str:
    value = "c.v" if gaps else "coalesce(c.v, 0.0)"
    if planted:
        value = f"CASE WHEN g.i BETWEEN 400 AND 447 AND g.ch_index < 3 THEN {value} * 8 ELSE {value} END"
    return f"""
{name}_cells AS (SELECT event_type, i, round(sum(value), 4) AS v FROM (
    SELECT event_type, value, (epoch_us(ts) - 1704067200000000) // 3600000000 AS i FROM events)
  WHERE i BETWEEN 0 AND {HOURS - 1} GROUP BY ALL),
{name}_grid AS (SELECT event_type, {_case('event_type', CONTACTS)} AS channel,
    {_case('event_type', {k: n for n, k in enumerate(CONTACTS)})} AS ch_index, r.range AS i
  FROM (SELECT DISTINCT event_type FROM events), range({HOURS}) r),
{name} AS (SELECT 'events' AS recording_id, g.channel, g.ch_index, g.i, {value} AS v
  FROM {name}_grid g LEFT JOIN {name}_cells c USING (event_type, i))"""


def supplier_days(name: str = "s") -> str:
    return f"""
{name}_cells AS (SELECT CAST(l_suppkey AS VARCHAR) AS recording_id, 'L' || l_linenumber AS channel,
    l_linenumber - 1 AS ch_index, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS i, sum(l_quantity) AS v
  FROM lineitem GROUP BY ALL HAVING i BETWEEN 0 AND {DAYS - 1}),
{name}_grid AS (SELECT {K}, r.range AS i FROM (SELECT DISTINCT {K} FROM {name}_cells), range({DAYS}) r),
{name} AS (SELECT g.*, coalesce(c.v, 0.0) AS v FROM {name}_grid g LEFT JOIN {name}_cells c USING ({K}, i))"""


def contacts(name: str = "ch") -> str:
    return f"""
{name} AS (SELECT CAST(c_nationkey AS VARCHAR) AS recording_id,
    'EEG ' || {_case('c_mktsegment', SHAFTS)} || (c_custkey + 1) AS channel, CAST(c_custkey AS INTEGER) AS ch_index, c_acctbal
  FROM customer)"""


def annotations(name: str = "an") -> str:
    return f"""
{name} AS (SELECT CAST(user_id AS VARCHAR) AS recording_id, (epoch_us(ts) - 1704067200000000) / 1e6 AS onset,
    event_type AS description, event_id FROM events)"""


def waves(name: str = "wv") -> str:
    return f"""
{name} AS (SELECT 'embeddings' AS recording_id, 'c' || label AS channel, label AS ch_index, vec_id AS w,
    CAST(embedding AS DOUBLE[]) AS wave FROM embeddings)"""


def windows(source: str, window: int, step: int, n: int, name: str = "win") -> str:
    return f"""
{name} AS (SELECT * EXCLUDE (ws), unnest(ws) AS w FROM (SELECT *, range(
    CAST(greatest(0, floor((i - {window} + {step}) / {step}::DOUBLE)) AS BIGINT),
    CAST(least(floor(i / {step}::DOUBLE), floor(({n} - {window}) / {step}::DOUBLE)) AS BIGINT) + 1) AS ws FROM {source}))"""


def detector_features(source: str = "win", name: str = "feat") -> str:
    return f"""
{name}_line AS (SELECT {K}, w, regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM {source} GROUP BY ALL),
{name}_res AS (SELECT {K}, w, i, v - a - b * i AS r FROM {source} JOIN {name}_line USING ({K}, w)),
{name}_dif AS (SELECT *, r - lag(r) OVER (PARTITION BY recording_id, channel, w ORDER BY i) AS d FROM {name}_res),
{name} AS (SELECT {K}, w, sqrt(avg(r * r)) AS rms, max(r) - min(r) AS peak_to_peak, avg(abs(d)) AS line_length,
    sqrt(avg(d * d)) AS diff_rms FROM {name}_dif GROUP BY ALL)"""


def scale(mad: str, std: str, eps: float, fallback: str) -> str:
    if fallback == "largest":
        return f"greatest({mad}, {std}, {eps}::DOUBLE)"
    last = {"unit": f"CASE WHEN {std} > {eps} THEN {std} ELSE 1.0 END", "floor": f"greatest({std}, {eps}::DOUBLE)",
            "plus": f"{std} + {eps}::DOUBLE"}[fallback]
    return f"CASE WHEN {mad} > {eps} THEN {mad} ELSE {last} END"


def z(source: str, name: str, by: str, columns: list[str], where: str = "true", clip=(0, 25), two_sided=False,
      eps: float = 1e-12, fallback: str = "unit", missing=None) -> str:
    med = ", ".join(f"median({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in columns)
    mad = ", ".join(f"1.4826::DOUBLE * median(abs({c} - {c}_m)) AS {c}_d" for c in columns)
    outs = []
    for c in columns:
        score = f"({c} - {c}_m) / ({scale(f'{c}_d', f'{c}_s', eps, fallback)})"
        score = f"abs({score})" if two_sided else score
        score = f"coalesce({score}, {missing})" if missing is not None else score
        outs.append((f"greatest({clip[0]}::DOUBLE, least({clip[1]}::DOUBLE, {score}))" if clip else score) + f" AS {c}_z")
    return f"""
{name}_med AS (SELECT {by}, {med} FROM {source} WHERE {where} GROUP BY ALL),
{name}_mad AS (SELECT {by}, {mad} FROM {source} JOIN {name}_med USING ({by}) WHERE {where} GROUP BY ALL),
{name} AS (SELECT {source}.*, {', '.join(outs)} FROM {source} JOIN {name}_med USING ({by}) JOIN {name}_mad USING ({by}))"""


FEATURES = ["rms", "peak_to_peak", "line_length", "diff_rms"]


def channel_scores(source: str = "feat", name: str = "cs") -> str:
    best = "list_reverse_sort([rms_z, peak_to_peak_z, line_length_z, diff_rms_z])"
    return z(source, f"{name}_z", K, FEATURES) + f""",
{name} AS (SELECT {K}, w, ({best}[1] + {best}[2]) / 2 AS score FROM {name}_z)"""


def consensus(source: str = "cs", fraction: float = 0.1, name: str = "sc") -> str:
    return f"""
{name}_rank AS (SELECT recording_id, w, score, row_number() OVER (PARTITION BY recording_id, w ORDER BY score DESC) AS r,
    count(*) OVER (PARTITION BY recording_id, w) AS n FROM {source}),
{name} AS (SELECT recording_id, w, avg(score) AS score FROM {name}_rank
  WHERE r <= greatest(1.0, ceil(n * {fraction}::DOUBLE)) GROUP BY ALL)"""


def threshold(source: str = "sc", mad: float = 2.5, fallback: str = "floor", name: str = "th") -> str:
    return f"""
{name}_med AS (SELECT recording_id, median(score) AS c, stddev_pop(score) AS s FROM {source} GROUP BY ALL),
{name}_mad AS (SELECT recording_id, any_value(c) AS c, any_value(s) AS s, 1.4826::DOUBLE * median(abs(score - c)) AS d
  FROM {source} JOIN {name}_med USING (recording_id) GROUP BY ALL),
{name}_scale AS (SELECT recording_id, c AS score_center, {scale('d', 's', 1e-12, fallback)} AS score_scale FROM {name}_mad),
{name} AS (SELECT *, score_center + {mad}::DOUBLE * score_scale AS threshold FROM {name}_scale)"""


def relax(tries: int, scores: str = "sc", th: str = "th", name: str = "lim") -> str:
    cols, prev = [], "threshold"
    body = f"{name}_0 AS (SELECT *, threshold AS t0 FROM {th})"
    for k in range(1, tries):
        body += f""",
{name}_{k} AS (SELECT *, greatest(score_center + 3.0 * score_scale, t{k - 1} - score_scale) AS t{k} FROM {name}_{k - 1})"""
    counts = ", ".join(f"count(*) FILTER (score >= t{k}) AS n{k}" for k in range(tries))
    used = "CASE " + " ".join(f"WHEN n{k} > 0 THEN {k}" for k in range(tries)) + f" ELSE {tries - 1} END"
    pick = "CASE used " + " ".join(f"WHEN {k} THEN t{k}" for k in range(tries)) + " END"
    ts = ", ".join(f"any_value(t{k}) AS t{k}" for k in range(tries))
    return f"""
{body},
{name}_n AS (SELECT recording_id, any_value(score_center) AS score_center, any_value(score_scale) AS score_scale, {ts}, {counts}
  FROM {scores} JOIN {name}_{tries - 1} USING (recording_id) GROUP BY recording_id),
{name}_u AS (SELECT *, {used} AS used FROM {name}_n),
{name} AS (SELECT *, {pick} AS used_threshold FROM {name}_u)"""


def islands(source: str, order: str, broken: str, name: str, by: str = "recording_id") -> str:
    """``broken`` may use prev and cur."""
    return f"""
{name}_p AS (SELECT *, {order} AS cur, lag({order}) OVER (PARTITION BY {by} ORDER BY {order}) AS prev FROM {source}),
{name} AS (SELECT * EXCLUDE (prev, cur), sum(CASE WHEN prev IS NULL OR {broken} THEN 1 ELSE 0 END)
    OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS island FROM {name}_p)"""


def verified(step: int, window: int, gap: float, min_involved: int, n_channels: str, name: str = "ev") -> str:
    """Events of the detector from sc, cs and lim (sampling rate 1)."""
    return f"""
flagged AS (SELECT recording_id, w, score FROM sc JOIN lim USING (recording_id) WHERE score >= used_threshold),
{islands('flagged', 'w', f'(cur - prev) * {step} > {gap}', 'grp')},
runs AS (SELECT recording_id, island, min(w) AS first_w, max(w) AS last_w, max(score) AS score, count(*) AS candidate_windows,
    arg_min(w, (-score, w)) AS peak_w FROM (SELECT recording_id, island, w, score FROM grp) GROUP BY ALL),
inv AS (SELECT recording_id, first_w, list(channel ORDER BY ch_index) AS ch
  FROM (SELECT r.recording_id, first_w, c.channel, c.ch_index FROM runs r JOIN lim USING (recording_id)
        JOIN cs c ON c.recording_id = r.recording_id AND c.w = r.peak_w
        WHERE c.score >= greatest(3.0, used_threshold)) GROUP BY ALL),
{name} AS (SELECT r.recording_id, first_w * {step}::DOUBLE AS start_s, last_w * {step}::DOUBLE + {window} AS end_s,
    peak_w * {step}::DOUBLE AS peak_s, r.score,
    greatest(0.0, least(1.0, (greatest(0.0, (r.score - score_center) / score_scale) - 3.0) / 7.0)) AS confidence,
    coalesce(array_to_string(ch, ','), '') AS involved, candidate_windows, coalesce(len(ch), 0) AS involved_count
  FROM runs r JOIN lim USING (recording_id) LEFT JOIN inv USING (recording_id, first_w) JOIN {n_channels} USING (recording_id)
  WHERE coalesce(len(ch), 0) >= least({min_involved}, n_channels))"""


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select
