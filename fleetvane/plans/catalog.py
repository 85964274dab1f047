"""The registered queries, each with its SQL where SQL can express it. Numbers are rounded on both sides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvane.config import GROUP, PRESSURES, SENSORS, SPARSE, TEMPERATURES, AdaptivePolicy
from fleetvane.functions import scalar as S
from fleetvane.operators import adaptive, evidence, lifecycle, percentiles, profiles, robust, sequences, serving, windows
from fleetvane.sources.telemetry import SQL as TEL
from fleetvane.sources.telemetry import dense, table, telemetry


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


ALL: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        ALL[name] = Query(run, sql)
        return run

    return add


def _tel(s: SparkSession, d: str) -> DataFrame:
    return telemetry(table(s, d, "events"))


def _r(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Rounded; -0 becomes 0."""
    return df.withColumns({n: F.round(n, places) + F.lit(0.0) for n in names})


def _rs(*names: str, places: int = 6) -> str:
    return ", ".join(f"round({n}, {places}) + 0.0::DOUBLE AS {n}" for n in names)


# Projections


@query("P01_P02_P03_gaps_ratios",
    f"WITH {TEL} SELECT source_order, {_rs('gap1', 'gap2', 'ratio1', 'ratio2', 'span')} FROM (SELECT *, hp1 - lp1 AS gap1, hp2 - lp2 AS gap2, hp1 / greatest(abs(lp1), 1e-6::DOUBLE) AS ratio1, hp2 / greatest(abs(lp2), 0.1::DOUBLE) AS ratio2, temphi - templo AS span "
    f"FROM tel)",
)
def gaps_ratios(s, d):
    c = F.col
    return _r(_tel(s, d).select("source_order", S.gap(c("hp1"), c("lp1")).alias("gap1"), S.gap(c("hp2"), c("lp2")).alias("gap2"), S.ratio(c("hp1"), c("lp1")).alias("ratio1"), S.ratio(c("hp2"), c("lp2"), 0.1).alias("ratio2"), (c("temphi") - c("templo")).alias("span")), "gap1", "gap2", "ratio1", "ratio2", "span")


MODE_SQL = "CASE WHEN lower(trim(sv)) IN ('on', 'true', '1', '2') THEN 'SV_ON' ELSE 'SV_OFF' END || '_VALVE_B' || CASE WHEN valve < 20 THEN '0' WHEN valve < 50 THEN '1' WHEN valve < 80 THEN '2' ELSE '3' END"


@query("P04_P05_operating_mode", f"WITH {TEL} SELECT {MODE_SQL} AS operating_mode, count(*) AS n, round(avg(valve), 6) AS valve FROM tel GROUP BY 1")
def operating_modes(s, d):
    return _tel(s, d).groupBy(S.operating_mode(F.col("sv"), F.col("valve")).alias("operating_mode")).agg(F.count("*").alias("n"), F.round(F.avg("valve"), 6).alias("valve"))


@query("P06_P19_names",
    "SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z0-9_-]+', '_', 'g') || '__M' || CASE WHEN c_nationkey < 10 THEN '0' ELSE '' END || CAST(c_nationkey AS VARCHAR) AS group_name, 'MX' || CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 3 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0') ELSE CAST(c_custkey AS VARCHAR) END AS machine "
    "FROM customer",
)
def names(s, d):
    return table(s, d, "customer").select("c_custkey", S.group_name(F.col("c_name"), F.col("c_nationkey")).alias("group_name"), S.machine_name(F.concat(F.lit("mx"), F.col("c_custkey").cast("string"))).alias("machine"))


@query("P07_P08_P09_health", """
WITH x AS (SELECT l_orderkey, l_linenumber, 1 - exp(-greatest(l_discount, 0) / 0.05::DOUBLE) AS score FROM lineitem), h AS (SELECT *, 100 * (1 - least(greatest(score, 0), 1)) AS health FROM x)
SELECT l_orderkey, l_linenumber, round(score, 6) AS score, round(health, 6) AS health, CASE WHEN health >= 80 THEN 'Normal' WHEN health >= 60 THEN 'Watch' WHEN health >= 40 THEN 'Warning' ELSE 'Critical' END AS label FROM h""")
def health(s, d):
    x = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.anomaly_score(F.col("l_discount"), F.lit(0.05)).alias("score")).withColumn("health", S.raw_health(F.col("score")))
    return _r(x.withColumn("label", S.health_label(F.col("health"))), "score", "health")


@query("P10_P11_risk", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 25 AS op, l_discount * 20 AS gold FROM lineitem), r AS (SELECT *, greatest(op, 0.5::DOUBLE * gold) AS risk FROM x)
SELECT l_orderkey, l_linenumber, round(risk, 6) AS risk, round(least(greatest(100 - 40 * risk, 0), 100), 6) AS health, CASE WHEN risk < 0.5 THEN 'Normal' WHEN risk < 1 THEN 'Watch' WHEN risk < 1.5 THEN 'Warning' ELSE 'Critical' END AS status, gold >= 1 AS drift, op < 0.5 AND gold < 0.8 AS eligible FROM r""")
def risk(s, d):
    x = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 25).alias("op"), (F.col("l_discount") * 20).alias("gold"))
    x = x.withColumn("risk", S.combined_risk(F.col("op"), F.col("gold"))).withColumn("health", S.risk_health(F.col("risk"))).withColumn("status", S.risk_status(F.col("risk")))
    return _r(x.withColumn("drift", F.col("gold") >= 1).withColumn("eligible", (F.col("op") < 0.5) & (F.col("gold") < 0.8)).drop("op", "gold"), "risk", "health")


@query("P12_threshold_ratio", "SELECT o_orderkey, round(CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice / (o_custkey % 7) END, 6) AS ratio FROM orders")
def ratios(s, d):
    return _r(table(s, d, "orders").select("o_orderkey", S.threshold_ratio(F.col("o_totalprice"), (F.col("o_custkey") % 7).cast("double")).alias("ratio")), "ratio")


@query("P13_P16_finite",
    "SELECT event_id, try_cast(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(event_id % 1000 AS VARCHAR) END AS DOUBLE) AS x "
    "FROM events",
)
def finite(s, d):
    text = F.when(F.col("event_id") % 5 == 0, "n/a").when(F.col("event_id") % 5 == 9, "NaN").otherwise((F.col("event_id") % 1000).cast("string"))
    return table(s, d, "events").select("event_id", S.parsed_number(text).alias("x"))


@query("P17_standardised",
    f"WITH {TEL} SELECT source_order, "
    f"round((hp2 - avg(hp2) OVER w) / CASE WHEN stddev_pop(hp2) OVER w > 0 THEN stddev_pop(hp2) OVER w ELSE 1 END, 6) + 0.0::DOUBLE AS z "
    f"FROM tel WINDOW w AS (PARTITION BY machine_id, module_id)",
)
def standardised(s, d):
    return _r(robust.standardised(_tel(s, d), [*GROUP], "hp2").select("source_order", "z"), "z")


# Row gates and sequences

FLAGS = """
flg AS (SELECT *, module_id IN (7) AS is_excluded, module_status IN ('ChangeValve', 'AdjustValve', 'MValveHome') OR busy = 1 AS is_transition, module_status = 'MValveHome' OR valve < 0 AS is_homing, templo = -200 OR temphi = -200 AS is_sentinel,
  NOT (hp1 >= 0 AND lp1 >= 0 AND hp2 >= 0 AND lp2 >= 0 AND hp1 <= 1000 AND lp1 <= 1000 AND hp2 <= 1000 AND lp2 <= 1000) AS is_invalid_pressure, NOT (temphi > -150 AND templo > -150 AND temphi < 250 AND templo < 250) AS is_invalid_temperature FROM den),
act AS (SELECT *, module_status = 'On' AND busy = 0 AND NOT (is_excluded OR is_transition OR is_homing OR is_sentinel OR is_invalid_pressure OR is_invalid_temperature) AS is_active FROM flg)"""
RUNS = """
rn0 AS (SELECT *, lag(is_active) OVER w AS was, s - lag(s) OVER w AS since_s, count(*) OVER (PARTITION BY machine_id, module_id, s) > 1 AS is_repeated FROM act WINDOW w AS (PARTITION BY machine_id, module_id ORDER BY s, source_order)),
run AS (SELECT *, CAST(sum(CASE WHEN was IS NULL OR was <> is_active THEN 1 ELSE 0 END) OVER (PARTITION BY machine_id, module_id ORDER BY s, source_order) AS BIGINT) AS run_id FROM rn0)"""
_LEADS = ", ".join(f"lead({c}) OVER w AS n_{c}" for c in SENSORS)
_FILLED = ", ".join(f"CASE WHEN k = 0 THEN {c} ELSE {c} + (n_{c} - {c}) * (k / CAST(gap AS DOUBLE)) END AS {c}" for c in SENSORS)
FILL = f"""
ld AS (SELECT *, coalesce(lead(s) OVER w - s, 1) AS gap, {_LEADS} FROM run WHERE is_active WINDOW w AS (PARTITION BY machine_id, module_id, run_id ORDER BY s)),
ex AS (SELECT *, unnest(range(0, least(gap - 1, 5) + 1)) AS k FROM ld),
fil AS (SELECT machine_id, module_id, run_id, source_order, s + k AS s, k > 0 AS is_imputed, {_FILLED} FROM ex)"""
SEG = """
sg0 AS (SELECT *, coalesce(s - lag(s) OVER (PARTITION BY machine_id, module_id ORDER BY s) <> 1, true) AS segment_break FROM fil),
seg AS (SELECT *, CAST(sum(CAST(segment_break AS INTEGER)) OVER (PARTITION BY machine_id, module_id ORDER BY s) AS BIGINT) AS segment_id FROM sg0)"""
_ROLL = (", ".join(
    f"CASE WHEN count(*) OVER r = 60 THEN avg({c}) OVER r END AS mean_{c}, "
    f"coalesce(CASE WHEN count(*) OVER r = 60 THEN stddev_pop({c}) OVER r END, 0) AS std_{c}" for c in sequences.ROLLED)
)
_DELTA = ", ".join(f"{c} - lag({c}) OVER w AS d_{c}" for c in sequences.DELTAS)
FEAT = f"""
fea AS (SELECT *, hp1 - lp1 AS gap1, hp2 - lp2 AS gap2, hp1 / greatest(abs(lp1), 1e-6::DOUBLE) AS ratio1, hp2 / greatest(abs(lp2), 1e-6::DOUBLE) AS ratio2, {_DELTA}, {_ROLL}, row_number() OVER w AS row_in_segment FROM seg
  WINDOW w AS (PARTITION BY machine_id, module_id, segment_id ORDER BY s), r AS (PARTITION BY machine_id, module_id, segment_id ORDER BY s ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""
SLIDE = """
sl0 AS (SELECT *, count(d_hp1 + mean_hp1) OVER f AS n_, max(s) OVER f AS end_s, avg(hp2) OVER f AS mean_hp2_ FROM fea WINDOW f AS (PARTITION BY machine_id, module_id, segment_id ORDER BY s ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING)),
sli AS (SELECT machine_id, module_id, segment_id, s AS start_s, end_s, mean_hp2_ FROM sl0 WHERE n_ = 60 AND (row_in_segment - 1) % 5 = 0)"""
SEQ = f"WITH {TEL}, {FLAGS}, {RUNS}, {FILL}, {SEG}, {FEAT}, {SLIDE}"


def _flags(s, d):
    return sequences.row_flags(dense(_tel(s, d)))


def _segments(s, d):
    return sequences.segments(sequences.fill_short_gaps(sequences.active_runs(_flags(s, d))))


def _slides(s, d):
    return sequences.sliding_windows(sequences.features(_segments(s, d)))


FLAG_NAMES = ("is_excluded", "is_transition", "is_homing", "is_sentinel", "is_invalid_pressure", "is_invalid_temperature", "is_active")


@query("F01_F04_row_flags", f"{SEQ} SELECT source_order, {', '.join(FLAG_NAMES)} FROM act")
def row_flags(s, d):
    return _flags(s, d).select("source_order", *FLAG_NAMES)


@query("F05_W01_W02_runs", f"{SEQ} SELECT source_order, run_id, since_s, is_repeated FROM run")
def runs(s, d):
    return sequences.active_runs(_flags(s, d)).select("source_order", "run_id", "since_s", "is_repeated")


@query("A10_A11_quality_counts",
    f"{SEQ} SELECT machine_id, module_id, count(*) AS raw_rows, count(*) FILTER (is_active) AS accepted, "
    f"count(*) FILTER (NOT is_active) AS rejected FROM act GROUP BY 1, 2",
)
def quality_counts(s, d):
    a = F.col("is_active")
    return _flags(s, d).groupBy(*GROUP).agg(F.count("*").alias("raw_rows"), F.count(F.when(a, 1)).alias("accepted"), F.count(F.when(~a, 1)).alias("rejected"))


@query("W03_W04_W05_gap_fill", f"{SEQ} SELECT machine_id, module_id, run_id, s, is_imputed, {_rs(*SENSORS)} FROM fil")
def gap_fill(s, d):
    return _r(sequences.fill_short_gaps(sequences.active_runs(_flags(s, d))).select(*GROUP, "run_id", "s", "is_imputed", *SENSORS), *SENSORS)


@query("W06_segments", f"{SEQ} SELECT machine_id, module_id, segment_id, count(*) AS n, min(s) AS start_s, max(s) AS end_s FROM seg GROUP BY 1, 2, 3")
def segment_bounds(s, d):
    return _segments(s, d).groupBy(*GROUP, "segment_id").agg(F.count("*").alias("n"), F.min("s").alias("start_s"), F.max("s").alias("end_s"))


_STD = tuple(f"std_{c}" for c in sequences.ROLLED)
_FEATURES = tuple(c for c in sequences.MODEL_FEATURES[len(SENSORS) :] if c not in _STD)


@query("W07_W08_features", f"{SEQ} SELECT machine_id, module_id, s, {_rs(*_FEATURES, places=7)}, {_rs(*_STD, places=4)} FROM fea")
def sequence_features(s, d):
    return _r(_r(sequences.features(_segments(s, d)).select(*GROUP, "s", *_FEATURES, *_STD), *_FEATURES, places=7), *_STD, places=4)


@query("W09_T03_F13_sliding_windows", f"{SEQ} SELECT machine_id, module_id, segment_id, start_s, end_s, round(mean_hp2_, 3) AS mean_hp2 FROM sli")
def sliding(s, d):
    mean = F.aggregate("seq", F.lit(0.0), lambda a, r: a + r[2].cast("double")) / F.size("seq")
    return _slides(s, d).select(*GROUP, "segment_id", "start_s", "end_s", F.round(mean, 3).alias("mean_hp2"))


SPLIT_SQL = "CASE WHEN i <= greatest(1, floor(n * 0.70::DOUBLE)) THEN 'train' WHEN i <= greatest(greatest(1, floor(n * 0.70::DOUBLE)) + 1, floor(n * 0.85::DOUBLE)) THEN 'validation' ELSE 'test' END"


@query("W11_W12_split",
    f"{SEQ} SELECT machine_id, module_id, start_s, {SPLIT_SQL} AS split "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY machine_id, module_id ORDER BY start_s) AS i, "
    f"count(*) OVER (PARTITION BY machine_id, module_id) AS n FROM sli) WHERE n >= 10",
)
def split(s, d):
    return sequences.split(_slides(s, d)).select(*GROUP, "start_s", "split")


@query("L03_even_take",
    "WITH x AS (SELECT o_custkey % 5 AS g, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) - 1 AS i, "
    "count(*) OVER (PARTITION BY o_custkey % 5) AS n FROM orders), k AS (SELECT unnest(range(0, 50)) AS k) "
    "SELECT DISTINCT g, o_orderkey FROM x JOIN k ON n <= 50 OR floor(k.k * ((n - 1) / 49.0::DOUBLE)) = i",
)
def even_take(s, d):
    return sequences.even_take(table(s, d, "orders").select((F.col("o_custkey") % 5).alias("g"), "o_orderkey"), 50, ("g",), "o_orderkey")


_F = "OVER (PARTITION BY machine_id, module_id, segment_id ORDER BY s ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING)"
_FINITE = "list_filter([" + ", ".join(f"CAST({c} AS FLOAT)" for c in sequences.MODEL_FEATURES) + "], lambda x: x IS NOT NULL)"
#: Errors of a model that gives back 0.95 of its input.
RECON = f"""
re0 AS (SELECT machine_id, module_id, s, row_in_segment, count(*) {_F} AS rows_, min(len({_FINITE})) {_F} AS least_, 0.05::DOUBLE * avg(list_sum([abs(CAST(x AS DOUBLE)) FOR x IN {_FINITE}]) / {len(sequences.MODEL_FEATURES)}) {_F} AS error, [{', '.join(f'avg(abs(CAST({c} AS FLOAT))) {_F}' for c in sequences.MODEL_FEATURES)}] AS by_ FROM fea),
rec AS (SELECT machine_id, module_id, s AS start_s, error, [{', '.join(f"'{c}'" for c in sequences.MODEL_FEATURES)}][list_position(by_, list_max(by_))] AS top_feature FROM re0 WHERE rows_ = 60 AND least_ = {len(sequences.MODEL_FEATURES)} AND (row_in_segment - 1) % 5 = 0)"""


@query("A08_P20_L06_reconstruction_errors", f"{SEQ}, {RECON} SELECT machine_id, module_id, start_s, round(error, 4) AS error, top_feature FROM rec")
def reconstruction(s, d):
    e = profiles.reconstruction_errors(_slides(s, d), profiles.Scaled(0.95), sequences.MODEL_FEATURES)
    return e.select(*GROUP, "start_s", F.round("error", 4).alias("error"), "top_feature")


_SUMMED = ("hp1", "hp2", "valve", "gap1", "ratio2", "d_hp2", "mean_hp2", "std_lp2")


@query("M01_window_summaries",
    f"{SEQ}, su0 AS (SELECT machine_id, module_id, s, row_in_segment, "
    f"count(d_hp1 + mean_hp1) {_F} AS n_, {', '.join(f'median(CAST({c} AS FLOAT)::DOUBLE) {_F} AS m_{c}' for c in _SUMMED)} FROM fea) "
    f"SELECT machine_id, module_id, s AS start_s, {', '.join(f'round(m_{c}, 4) + 0.0::DOUBLE AS {c}' for c in _SUMMED)} FROM su0 "
    f"WHERE n_ = 60 AND (row_in_segment - 1) % 5 = 0",
)
def summaries(s, d):
    w = sequences.window_summaries(_slides(s, d))
    return _r(w.select(*GROUP, "start_s", *[F.col("summary")[sequences.MODEL_FEATURES.index(c)].alias(c) for c in _SUMMED]), *_SUMMED, places=4)


@query("W04_W05_valve_gaps",
    f"WITH {TEL}, dnv AS (SELECT * REPLACE (CASE WHEN source_order % 17 < 2 THEN NULL ELSE valve END AS valve) "
    f"FROM den), {FLAGS.replace('FROM den', 'FROM dnv').replace('valve < 0 AS is_homing', 'coalesce(valve < 0, false) AS is_homing')}, {RUNS}, lv AS (SELECT *, "
    f"coalesce(lead(s) OVER w - s, 1) AS gap, lead(hp2) OVER w AS n_hp2, last_value(CASE WHEN valve IS NOT NULL THEN s END IGNORE NULLS) OVER u AS b_s, last_value(valve IGNORE NULLS) OVER u AS b_v, first_value(CASE WHEN valve IS NOT NULL THEN s END IGNORE NULLS) OVER o AS a_s, first_value(valve IGNORE NULLS) OVER o AS a_v "
    f"FROM run WHERE is_active WINDOW w AS (PARTITION BY machine_id, module_id, run_id ORDER BY s), "
    f"u AS (PARTITION BY machine_id, module_id, run_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    f"o AS (PARTITION BY machine_id, module_id, run_id ORDER BY s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), "
    f"ev2 AS (SELECT *, unnest(range(0, least(gap - 1, 5) + 1)) AS k FROM lv), "
    f"fv AS (SELECT machine_id, module_id, s + k AS s, k > 0 OR valve IS NULL AS is_imputed, "
    f"CASE WHEN k = 0 THEN hp2 ELSE hp2 + (n_hp2 - hp2) * (k / CAST(gap AS DOUBLE)) END AS hp2, "
    f"CASE WHEN k = 0 AND valve IS NOT NULL THEN valve WHEN s + k - b_s <= 5 AND a_s IS NOT NULL THEN b_v + (a_v - b_v) * ((s + k - b_s) / CAST(a_s - b_s AS DOUBLE)) END AS valve "
    f"FROM ev2) SELECT machine_id, module_id, s, is_imputed, round(hp2, 6) AS hp2, round(valve, 6) AS valve FROM fv "
    f"WHERE valve IS NOT NULL",
)
def valve_gaps(s, d):
    """Rows whose valve is missing, next to gaps: that column is filled on its own."""
    rows = dense(_tel(s, d)).withColumn("valve", F.when(F.col("source_order") % 17 >= 2, F.col("valve")))
    return _r(sequences.fill_short_gaps(sequences.active_runs(sequences.row_flags(rows))).select(*GROUP, "s", "is_imputed", "hp2", "valve"), "hp2", "valve")


@query("W10_smoothed_health",
    f"{SEQ} SELECT machine_id, module_id, start_s, "
    f"round(avg(mean_hp2_) OVER (PARTITION BY machine_id, module_id, segment_id ORDER BY start_s ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 3) AS smooth_health "
    f"FROM sli",
)
def smooth(s, d):
    mean = F.aggregate("seq", F.lit(0.0), lambda a, r: a + r[2].cast("double")) / F.size("seq")
    return _r(sequences.smoothed_health(_slides(s, d).withColumn("health", mean)).select(*GROUP, "start_s", "smooth_health"), "smooth_health", places=3)


# Event windows

WIN_S = SPARSE.window_s
_ANYFAULT = {
    "NON_FINITE_SENSOR": "bool_or(" + " OR ".join(f"{c} IS NULL" for c in SENSORS) + ")",
    "SENTINEL_VALUE": "bool_or(" + " OR ".join(f"coalesce({c} = -200, false)" for c in TEMPERATURES) + ")",
    "PRESSURE_OUT_OF_RANGE": "bool_or(NOT (" + " AND ".join(f"coalesce({c} BETWEEN 0 AND 1000, false)" for c in PRESSURES) + "))",
    "TEMPERATURE_OUT_OF_RANGE": "bool_or(NOT (" + " AND ".join(f"coalesce({c} > -150 AND {c} < 250, false)" for c in TEMPERATURES) + "))",
    "NEGATIVE_VALVE": "bool_or(coalesce(valve < 0, false))",
    "DUPLICATE_TIMESTAMP": "bool_or(rep)",
    "OUT_OF_ORDER_TIMESTAMP": "bool_or(ooo)",
}
_BAD = "list_filter([" + ", ".join(f"CASE WHEN f{i} THEN '{n}' END" for i, n in enumerate(_ANYFAULT)) + "], lambda x: x IS NOT NULL)"
WIN = f"""
pr0 AS (SELECT *, coalesce(us < lag(us) OVER (PARTITION BY machine_id, module_id ORDER BY source_order), false) AS ooo, lower(trim(module_status)) IN ('changevalve', 'adjustvalve', 'mvalvehome', 'startup', 'shutdown') OR busy = 1 AS tr, lag(us) OVER t AS pus, coalesce(us = lag(us) OVER t OR us = lead(us) OVER t, false) AS rep, us // {WIN_S * 1000000} * {WIN_S} AS window_start_s FROM tel WINDOW t AS (PARTITION BY machine_id, module_id ORDER BY us, source_order)),
pr1 AS (SELECT *, coalesce((us - last_value(CASE WHEN tr THEN us END IGNORE NULLS) OVER (PARTITION BY machine_id, module_id ORDER BY us, source_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 1e6 < {SPARSE.settling_s}, false) AS st, CASE WHEN pus // {WIN_S * 1000000} * {WIN_S} = window_start_s AND us > pus THEN (us - pus) / 1e6 END AS step_s FROM pr0),
md AS (SELECT machine_id, module_id, window_start_s, c, v, row_number() OVER (PARTITION BY machine_id, module_id, window_start_s, c ORDER BY n DESC, v) AS r FROM (
  SELECT machine_id, module_id, window_start_s, 'sv' AS c, trim(sv) AS v, count(*) AS n FROM pr1 GROUP BY ALL UNION ALL SELECT machine_id, module_id, window_start_s, 'module_status', trim(module_status), count(*) FROM pr1 GROUP BY ALL)),
ag AS (SELECT machine_id, module_id, window_start_s, count(*) AS point_count, {', '.join(f'median({c}) AS {c}' for c in (*SENSORS, 'busy'))}, median(step_s) AS median_step_s, coalesce(max(step_s), 0) AS max_gap_s, bool_and(lower(trim(module_status)) IN ('on', 'run', 'running', '2') AND lower(trim(global_status)) IN ('on', 'run', 'running', '2')) AS running, bool_or(tr OR st) AS unsettled, {', '.join(f'{t} AS f{i}' for i, t in enumerate(_ANYFAULT.values()))} FROM pr1 GROUP BY 1, 2, 3),
cv AS (SELECT ag.*, point_count / CASE WHEN median_step_s > 0 THEN greatest(1.0, floor({WIN_S} / median_step_s)) ELSE {SPARSE.least_points} END AS coverage, {_BAD} AS bad, (SELECT v FROM md WHERE md.machine_id = ag.machine_id AND md.module_id = ag.module_id AND md.window_start_s = ag.window_start_s AND c = 'sv' AND r = 1) AS sv FROM ag),
win AS (SELECT *, CASE WHEN len(bad) > 0 THEN 'DATA_QUALITY_REVIEW' WHEN point_count < {SPARSE.least_points} OR max_gap_s > {SPARSE.max_gap_s} OR coverage < {SPARSE.least_coverage} THEN 'INCOMPLETE_WINDOW' WHEN NOT running OR unsettled THEN 'OFF_OR_TRANSITION' ELSE 'ELIGIBLE' END AS window_status,
  CASE WHEN len(bad) > 0 THEN array_to_string(bad, ',') WHEN point_count < {SPARSE.least_points} THEN 'TOO_FEW_POINTS' WHEN max_gap_s > {SPARSE.max_gap_s} THEN 'TIME_GAP_EXCEEDED' WHEN coverage < {SPARSE.least_coverage} THEN 'COVERAGE_BELOW_MINIMUM' ELSE concat_ws(',', CASE WHEN NOT running THEN 'OFF_OR_NON_RUNNING_STATE' END, CASE WHEN unsettled THEN 'TRANSITION_OR_SETTLING' END) END AS reasons,
  hp2 - lp2 AS pressure_gap, hp2 / greatest(abs(lp2), 0.1::DOUBLE) AS pressure_ratio, temphi - templo AS temperature_span, {MODE_SQL} AS operating_mode FROM cv)"""
WITH_WIN = f"WITH {TEL}, {WIN}"
_WINCOLS = ("coverage", "max_gap_s", *SENSORS, "pressure_gap", "pressure_ratio", "temperature_span")


def _windows(s, d):
    return windows.event_windows(_tel(s, d), SPARSE)


@query("A01_A02_A03_F06_F07_F08_F09_T02_event_windows", f"{WITH_WIN} SELECT machine_id, module_id, window_start_s, point_count, window_status, reasons, operating_mode, {_rs(*_WINCOLS)} FROM win")
def event_windows(s, d):
    w = _windows(s, d).select(*GROUP, "window_start_s", "point_count", "window_status", F.array_join("quality_reasons", ",").alias("reasons"), "operating_mode", *_WINCOLS)
    return _r(w, *_WINCOLS)


@query("A14_A15_status_counts", f"{WITH_WIN} SELECT window_status, count(*) AS n, count(DISTINCT window_start_s // 86400) AS days FROM win GROUP BY 1")
def status_counts(s, d):
    return _windows(s, d).groupBy("window_status").agg(F.count("*").alias("n"), F.count_distinct(F.floor(F.col("window_start_s") / 86400)).alias("days"))


@query("W13_W14_order_settling", f"{WITH_WIN} SELECT source_order, ooo AS out_of_order, tr AS transition, st AS settling FROM pr1")
def order_settling(s, d):
    return windows.prepared(_tel(s, d), SPARSE).select("source_order", "out_of_order", "transition", "settling")


# Evidence with given profiles: robust centers of each mode's eligible windows, and a fixed line for the residual

_PROFILED = ("hp2", "pressure_gap", "temperature_span")
LINE = (10.0, 0.18, 0.05)
EVI = f"""
el AS (SELECT *, lp2 - ({LINE[0]} + {LINE[1]}::DOUBLE * hp2 + {LINE[2]}::DOUBLE * valve) AS lp2_residual FROM win WHERE window_status = 'ELIGIBLE'),
cn AS (SELECT machine_id, module_id, operating_mode, {', '.join(f'median({c}) AS c_{c}' for c in (*_PROFILED, 'lp2_residual'))} FROM el GROUP BY 1, 2, 3),
zs AS (SELECT el.*, {', '.join(f'(el.{c} - c_{c}) / {w} AS z_{n}' for c, n, w in (('hp2', 'hp2', '4.0'), ('lp2_residual', 'lp2', '0.05'), ('pressure_gap', 'gap', '3.0'), ('temperature_span', 'span', '0.5')))} FROM el JOIN cn USING (machine_id, module_id, operating_mode)),
is0 AS (SELECT *, CASE WHEN window_start_s - lag(window_start_s) OVER k > {SPARSE.reset_s} THEN 1 ELSE 0 END AS brk FROM zs WINDOW k AS (PARTITION BY machine_id, module_id, operating_mode ORDER BY window_start_s)),
isl AS (SELECT *, sum(brk) OVER k AS island, {', '.join(f"coalesce(last_value(CASE WHEN {on} THEN true WHEN {off} THEN false END IGNORE NULLS) OVER k, false) AS {n}_on" for n, on, off in (*[(x, f'abs(z_{x}) >= 3.5', f'abs(z_{x}) < 2.5') for x in ('hp2', 'gap', 'span')], ('lp2', 'z_lp2 <= -3.5', 'z_lp2 > -2.5')))} FROM is0 WINDOW k AS (PARTITION BY machine_id, module_id, operating_mode ORDER BY window_start_s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tr0 AS (SELECT *, z_lp2 - first_value(z_lp2) OVER (PARTITION BY machine_id, module_id, operating_mode, island ORDER BY window_start_s RANGE BETWEEN {int(SPARSE.trend_s)} PRECEDING AND CURRENT ROW) AS trend FROM isl),
tr1 AS (SELECT *, coalesce(last_value(CASE WHEN trend <= -3 THEN true WHEN abs(trend) < 2 THEN false END IGNORE NULLS) OVER (PARTITION BY machine_id, module_id, operating_mode, island ORDER BY window_start_s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS trend_on FROM tr0),
ac AS (SELECT *, hp2_on OR lp2_on OR gap_on OR span_on OR trend_on AS active FROM tr1),
rr AS (SELECT *, sum(CASE WHEN active THEN 0 ELSE 1 END) OVER (PARTITION BY machine_id, module_id, operating_mode, island ORDER BY window_start_s) AS rr_ FROM ac),
evd AS (SELECT *, CASE WHEN active THEN window_start_s - min(CASE WHEN active THEN window_start_s END) OVER (PARTITION BY machine_id, module_id, operating_mode, island, rr_) + {WIN_S} ELSE 0 END AS persistent_s,
  concat_ws(',', CASE WHEN hp2_on THEN 'HP2_ROBUST_Z' END, CASE WHEN trend_on THEN 'LP2_DOWNWARD_TREND' END, CASE WHEN lp2_on THEN 'LP2_NEGATIVE_RESIDUAL' END, CASE WHEN gap_on THEN 'PRESSURE_GAP_ANOMALY' END, CASE WHEN span_on THEN 'TEMPERATURE_SPAN_ANOMALY' END) AS codes FROM rr)"""
WITH_EVI = f"WITH {TEL}, {WIN}, {EVI}"


def _evidence(s, d):
    el = _windows(s, d).where("window_status = 'ELIGIBLE'")
    residual = F.col("lp2") - (LINE[0] + LINE[1] * F.col("hp2") + LINE[2] * F.col("valve"))
    widths = {"hp2": 4.0, "pressure_gap": 3.0, "temperature_span": 0.5, "residual": 0.05}
    given = el.withColumn("residual", residual).groupBy(*evidence.KEY).agg(*[F.percentile(c, F.lit(0.5)).alias(f"center_{c}") for c in widths], *[F.lit(w).alias(f"scale_{c}") for c, w in widths.items()], F.lit(LINE[0]).alias("intercept"), F.lit(LINE[1]).alias("b_hp2"), F.lit(LINE[2]).alias("b_valve"))
    return evidence.latched_evidence(evidence.context_scores(el, given), SPARSE)


@query("M17_W15_W16_W17_W18_J02_J03_J04_evidence",
    f"{WITH_EVI} SELECT machine_id, module_id, operating_mode, window_start_s, {_rs('z_hp2', 'z_lp2', 'z_gap', 'z_span', 'trend', places=4)}, codes, active, CAST(persistent_s AS BIGINT) AS persistent_s "
    f"FROM evd",
)
def evidence_query(s, d):
    return _r(_evidence(s, d).select(*evidence.KEY, "window_start_s", "z_hp2", "z_lp2", "z_gap", "z_span", "trend", F.array_join("reason_codes", ",").alias("codes"), "active", F.col("persistent_s").cast("long").alias("persistent_s")), "z_hp2", "z_lp2", "z_gap", "z_span", "trend", places=4)


@query("M22_fusion",
    f"{WITH_EVI} SELECT machine_id, module_id, operating_mode, window_start_s, "
    f"CASE WHEN persistent_s >= {SPARSE.p1_s} AND hp2_on THEN 'P1_REVIEW' WHEN persistent_s >= {SPARSE.p2_s} THEN 'P2_REVIEW' WHEN active OR hp2_on THEN 'SHADOW' ELSE 'NORMAL' END AS review_level "
    f"FROM evd",
)
def fusion(s, d):
    """The pressure code stands in for the second evidence, with the same persistence."""
    e = _evidence(s, d)
    level = evidence.review_level(F.col("window_status"), F.col("active"), F.col("persistent_s"), F.col("hp2_on"), F.when(F.col("hp2_on"), F.col("persistent_s")).otherwise(0), SPARSE)
    return e.select(*evidence.KEY, "window_start_s", level.alias("review_level"))


# Statistics


@query("A04_A05_robust_scale", """
WITH x AS (SELECT l_returnflag, 'l_quantity' AS feature, l_quantity AS x FROM lineitem UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem), m AS (SELECT l_returnflag, feature, median(x) AS center, stddev_pop(x) AS sd FROM x GROUP BY 1, 2),
d AS (SELECT l_returnflag, feature, 1.4826::DOUBLE * median(abs(x - center)) AS mad, any_value(center) AS center, any_value(sd) AS sd FROM x JOIN m USING (l_returnflag, feature) GROUP BY 1, 2)
SELECT l_returnflag, feature, round(center, 6) AS center, round(CASE WHEN mad > 1e-8 THEN mad WHEN sd > 1e-8 THEN sd ELSE 1 END, 6) AS scale FROM d""")
def robust_scale(s, d):
    return _r(robust.center_scale(table(s, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice"]), "center", "scale")


@query("A06_percentiles", "SELECT l_shipmode_, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS p{int(p * 100)}" for p in (0.01, 0.5, 0.95, 0.99)) + " FROM (SELECT l_linestatus || l_returnflag AS l_shipmode_, l_extendedprice FROM lineitem) GROUP BY 1")
def percentiles_of_prices(s, d):
    x = table(s, d, "lineitem").withColumn("l_shipmode_", F.concat("l_linestatus", "l_returnflag"))
    names = {f"p{int(p * 100)}": p for p in (0.01, 0.5, 0.95, 0.99)}
    return percentiles.percentiles(x, ["l_shipmode_"], "l_extendedprice", names).select("l_shipmode_", *[F.round(n, 6).alias(n) for n in names])


@query("A07_standard_scaler",
    "SELECT l_returnflag, round(avg(l_tax), 6) AS mean_l_tax, "
    "round(CASE WHEN stddev_pop(l_tax) < 1e-8 THEN 1 ELSE stddev_pop(l_tax) END, 6) AS scale_l_tax FROM lineitem GROUP BY 1",
)
def scaler(s, d):
    return _r(robust.standard_scaler(table(s, d, "lineitem"), ["l_returnflag"], ["l_tax"]), "mean_l_tax", "scale_l_tax")


_ERR = (
    "err AS (SELECT l_suppkey % 6 AS machine_id, l_partkey % 7 AS module_id, l_discount * l_quantity AS error, "
    "CASE WHEN l_linenumber <= 2 THEN 'validation' WHEN l_linenumber <= 4 THEN 'test' ELSE 'train' END AS split FROM lineitem)"
)


def _errors(s, d):
    return table(s, d, "lineitem").select((F.col("l_suppkey") % 6).alias("machine_id"), (F.col("l_partkey") % 7).alias("module_id"), (F.col("l_discount") * F.col("l_quantity")).alias("error"), F.when(F.col("l_linenumber") <= 2, "validation").when(F.col("l_linenumber") <= 4, "test").otherwise("train").alias("split"))


_METRICS = (
    f"{_ERR}, st AS (SELECT machine_id, module_id, quantile_cont(error, 0.5) FILTER (split = 'validation') AS validation_p50, "
    f"quantile_cont(error, 0.99) FILTER (split = 'validation') AS validation_p99, "
    f"quantile_cont(error, 0.5) FILTER (split = 'test') AS test_p50, quantile_cont(error, 0.95) FILTER (split = 'test') AS test_p95 "
    f"FROM err GROUP BY 1, 2), "
    f"ov AS (SELECT machine_id, module_id, avg(CASE WHEN error > validation_p99 THEN 1.0 ELSE 0.0 END) AS test_exceedance FROM err "
    f"JOIN st USING (machine_id, module_id) WHERE split = 'test' GROUP BY 1, 2)"
)


@query("A09_A12_group_metrics",
    f"WITH {_METRICS} SELECT machine_id, module_id, {_rs('validation_p50', 'validation_p99', 'test_p50', 'test_p95', 'test_exceedance')} FROM st "
    f"LEFT JOIN ov USING (machine_id, module_id)",
)
def metrics(s, d):
    return _r(robust.group_metrics(_errors(s, d), ["machine_id", "module_id"]), "validation_p50", "validation_p99", "test_p50", "test_p95", "test_exceedance")


@query("A13_A20_exceedance_pivot",
    f"WITH {_METRICS} SELECT machine_id, {', '.join(f'round(max(test_exceedance) FILTER (module_id = {m}), 6) AS m{m}' for m in range(7))} FROM ov "
    f"GROUP BY 1",
)
def pivot(s, d):
    p = robust.group_metrics(_errors(s, d), ["machine_id", "module_id"]).groupBy("machine_id").pivot("module_id", list(range(7))).agg(F.round(F.first("test_exceedance"), 6))
    return p.select("machine_id", *[F.col(str(m)).alias(f"m{m}") for m in range(7)])


@query("A17_pearson", "SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def pearson(s, d):
    return _r(robust.pearson(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"), "r")


_CORR = ("hp2", "lp2", "valve", "temphi")


@query("A18_correlation_matrix", f"WITH {TEL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 3) AS r FROM tel" for i, a in enumerate(_CORR) for b in _CORR[i:]))
def correlations(s, d):
    return robust.correlation_matrix(_tel(s, d), list(_CORR))


@query("A19_balanced_weights",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(CAST((SELECT count(*) "
    "FROM lineitem) AS DOUBLE) / (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem) / c), 4) AS total "
    "FROM (SELECT l_returnflag, l_linestatus, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS c FROM lineitem) "
    "GROUP BY 1, 2",
)
def weights(s, d):
    return robust.balanced_weights(table(s, d, "lineitem").select("l_returnflag", "l_linestatus"), ["l_returnflag", "l_linestatus"]).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("total"))


@query("A16_shadow_rates",
    f"{WITH_EVI}, dc AS (SELECT machine_id, "
    f"CASE WHEN window_start_s // 86400 % 9 = 0 THEN 'UNKNOWN_REGIME' ELSE window_status END AS ws, active, hp2_on FROM evd) "
    f"SELECT machine_id, count(*) AS windows, count(*) FILTER (ws = 'ELIGIBLE') AS known, "
    f"round(count(*) FILTER (ws = 'UNKNOWN_REGIME') / greatest(1, count(*)), 6) AS unknown_rate, "
    f"round(count(*) FILTER (ws = 'ELIGIBLE' AND active) / greatest(1, count(*) FILTER (ws = 'ELIGIBLE')), 6) AS first_rate, "
    f"round(count(*) FILTER (ws = 'ELIGIBLE' AND hp2_on) / greatest(1, count(*) FILTER (ws = 'ELIGIBLE')), 6) AS second_rate "
    f"FROM dc GROUP BY 1",
)
def shadow(s, d):
    e = _evidence(s, d).withColumn("window_status", F.when(F.floor(F.col("window_start_s") / 86400) % 9 == 0, "UNKNOWN_REGIME").otherwise(F.col("window_status")))
    return _r(lifecycle.shadow_rates(e.withColumnsRenamed({"active": "first_active", "hp2_on": "second_active"}), ["machine_id"]), "unknown_rate", "first_rate", "second_rate")


# Vectors: summaries, deviations, bounded adaptation and guardrails on the embeddings

_VEC = "vec AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings)"


def _vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("summary"))


@query("M05_feature_deviation", f"WITH {_VEC} SELECT vec_id, round(list_max([abs(x) / 0.1::DOUBLE FOR x IN v]), 5) AS deviation FROM vec")
def deviation(s, d):
    zero, tenth = F.transform("summary", lambda x: F.lit(0.0)), F.transform("summary", lambda x: F.lit(0.1))
    return _r(_vectors(s, d).select("vec_id", S.feature_deviation(F.col("summary"), zero, tenth).alias("deviation")), "deviation", places=5)


@query("M09_synthetic_challenge",
    f"WITH {_VEC}, n AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 7 AS j FROM vec) SELECT vec_id, "
    f"round(list_sum([CASE WHEN i - 1 = j THEN CASE WHEN v[i] >= 0 THEN 1 ELSE -1 END * 103.0::DOUBLE * 0.1::DOUBLE ELSE v[i] END FOR i IN range(1, len(v) + 1)]), 5) AS total "
    f"FROM n",
)
def challenge(s, d):
    x = _vectors(s, d).withColumn("golden_center", F.transform("summary", lambda x: F.lit(0.0))).withColumn("golden_scale", F.transform("summary", lambda x: F.lit(0.1))).withColumn("limit", F.lit(100.0))
    return adaptive.synthetic_challenge(x, ["label"], "vec_id", "limit").select("vec_id", F.round(F.aggregate("summary", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


_M08 = (
    "WITH e AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings), "
    "t AS (SELECT label, pos, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY 1, 2), h AS (SELECT label, max(sd) AS top FROM t "
    "GROUP BY 1)"
)


@query("M08_bounded_candidate",
    f"{_M08} SELECT label, CAST(pos AS INTEGER) AS pos, "
    f"round(least(greatest(0.1::DOUBLE * m, -0.001::DOUBLE), 0.001::DOUBLE), 7) + 0.0::DOUBLE AS center, "
    f"round(least(greatest(0.1::DOUBLE + 0.1::DOUBLE * (sd - 0.1::DOUBLE), 0.09::DOUBLE), 0.11::DOUBLE), 7) AS scale, "
    f"round(least(greatest(1 + 0.1::DOUBLE * (top - 1), 0.9::DOUBLE), 1.1::DOUBLE), 7) AS threshold FROM t JOIN h USING (label)",
)
def candidate(s, d):
    e = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("sd"))
    t = e.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m", "sd"))).alias("r"), F.max("sd").alias("t_threshold"))
    targets = t.select("label", F.col("r.m").alias("t_center"), F.col("r.sd").alias("t_scale"), "t_threshold")
    same = lambda v: F.transform("t_center", lambda x: F.lit(v))
    olds = targets.select("label", same(0.0).alias("center"), same(0.1).alias("scale"), same(0.01).alias("golden_scale"), F.lit(1.0).alias("threshold"))
    out = adaptive.bounded_candidate(olds, targets, ["label"])
    return _r(out.select("label", "threshold", F.posexplode(F.arrays_zip("center", "scale")).alias("pos", "c")).select("label", "pos", F.col("c.center").alias("center"), F.col("c.scale").alias("scale"), "threshold"), "center", "scale", "threshold", places=7)


def _summaries(s, d):
    return _vectors(s, d).select(F.concat(F.lit("MX"), F.col("label").cast("string")).alias("machine_id"), F.lit(1).alias("module_id"), "vec_id", "summary", (0.05 + F.abs(F.col("summary")[0])).alias("error"))


@query("M04_M06_M07_P21_dual_scores")
def dual(s, d):
    x = _summaries(s, d)
    out = adaptive.dual_scores(x, adaptive.build_golden(x), ["machine_id", "module_id"])
    return out.select("vec_id", "machine_id", "golden_risk", "adaptive_risk", "risk", "health", "condition", "baseline_drift", "eligible")


@query("M10_alert_rates")
def alerts(s, d):
    x = _summaries(s, d)
    return adaptive.alert_rates(adaptive.dual_scores(x, adaptive.build_golden(x), ["machine_id", "module_id"]), ["machine_id"])


@query("M12_M13_regimes")
def regimes(s, d):
    el = _windows(s, d).where("window_status = 'ELIGIBLE'")
    return profiles.resolve_regimes(el, profiles.fit_regimes(el), SPARSE).select(*GROUP, "window_start_s", "operating_mode", "regime", "posterior", "log_likelihood", "regime_reason")


@query("M14_M15_M16_M18_context_profiles")
def contexts(s, d):
    el = _windows(s, d).where("window_status = 'ELIGIBLE'").withColumn("module_id", F.lit(0)).withColumn("operating_mode", F.substring("operating_mode", 1, 5))
    return profiles.fit_bundle(el, SPARSE)[1].select(*GROUP, "operating_mode", "regime", "windows", "intercept", "residual_center", "residual_scale", "forest_entry", "forest_exit")


@query("M20_bucket_evidence",
    f"{SEQ}, {RECON}, bu AS (SELECT machine_id, module_id, start_s // 300 AS bucket, count(*) AS sequences, "
    f"quantile_cont(error, 0.95) AS score, avg(CASE WHEN error >= 2 THEN 1.0 ELSE 0.0 END) AS exceedance FROM rec GROUP BY 1, 2, 3) "
    f"SELECT machine_id, module_id, bucket, sequences, round(score, 4) AS score, "
    f"round(exceedance, 6) AS exceedance, sequences >= 3 AND score >= 2 AS active FROM bu",
)
def buckets(s, d):
    e = profiles.reconstruction_errors(_slides(s, d), profiles.Scaled(0.95), sequences.MODEL_FEATURES).withColumn("bucket", F.floor(F.col("start_s") / 300))
    b = profiles.bucket_evidence(e, [*GROUP, "bucket"], 2.0)
    return b.select(*GROUP, "bucket", "sequences", F.round("score", 4).alias("score"), F.round("exceedance", 6).alias("exceedance"), "active")


# Joins, sets, ranks and serving


@query("J06_A17_aligned_series",
    f"{WITH_WIN} SELECT a.window_start_s, a.module_id, round(a.hp2, 6) AS a, round(b.hp2, 6) AS b FROM win a "
    f"JOIN win b USING (window_start_s, module_id) WHERE a.machine_id = 'MX000' AND b.machine_id = 'MX001'",
)
def aligned(s, d):
    w = _windows(s, d)
    return _r(serving.aligned(w.where("machine_id = 'MX000'"), w.where("machine_id = 'MX001'"), ["window_start_s", "module_id"], "hp2"), "a", "b")


@query("J07_overlay",
    "WITH a AS (SELECT o_orderdate AS day, max(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), "
    "b AS (SELECT o_orderdate AS day, max(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) "
    "SELECT CAST(coalesce(a.day, b.day) AS DATE) AS day, round(coalesce(b.p, a.p), 4) AS p FROM a FULL JOIN b ON a.day = b.day",
)
def overlay(s, d):
    o = table(s, d, "orders")
    side = lambda x: o.where(F.col("o_orderstatus") == x).groupBy(F.col("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("p"))
    return serving.overlay(side("O"), side("F"), ["day"], ["p"]).select(F.col("day").cast("date").alias("day"), F.round("p", 4).alias("p"))


@query("J08_S13_pending", "SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') o ON c_custkey = o_custkey")
def anti(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("J09_U05_missing_groups", "SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal < -950")
def missing(s, d):
    return table(s, d, "nation").select("n_nationkey").subtract(table(s, d, "customer").where("c_acctbal < -950").select("c_nationkey"))


@query("J10_Q05_fleet",
    f"{WITH_WIN}, l AS (SELECT machine_id, max(window_start_s) AS window_start_s FROM win GROUP BY 1) "
    f"SELECT m.machine_id, l.window_start_s, w.window_status FROM (SELECT DISTINCT machine_id FROM tel UNION SELECT 'MX999') m LEFT "
    f"JOIN l USING (machine_id) LEFT "
    f"JOIN win w ON w.machine_id = l.machine_id AND w.window_start_s = l.window_start_s AND w.module_id = 1",
)
def fleet(s, d):
    w = _windows(s, d)
    top = w.withColumn("top", F.struct("window_start_s", F.col("module_id") == 1))
    machines = w.select("machine_id").distinct().unionByName(s.createDataFrame([("MX999",)], "machine_id string"))
    states = s.createDataFrame([], "machine_id string, state string")
    last = top.groupBy("machine_id").agg(F.max("window_start_s").alias("window_start_s"))
    one = last.join(w.where("module_id = 1").select("machine_id", "window_start_s", "window_status"), ["machine_id", "window_start_s"], "left")
    return serving.fleet(machines, states, one).select("machine_id", "window_start_s", "window_status")


@query("J12_as_of",
    "SELECT e.event_id, p.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id "
    "FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts",
)
def as_of(s, d):
    e = table(s, d, "events")
    return serving.as_of(e.select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase")), ["user_id"], "ts", "last_purchase").select("event_id", "last_purchase")


@query("L02_L05_tail", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 576")
def tail(s, d):
    return serving.tail(table(s, d, "events").select("event_id", "event_type"), "event_id")


@query("L07_bounded_buffer",
    "SELECT o_custkey % 3 AS g, o_orderkey, count(*) OVER (PARTITION BY o_custkey % 3) AS total_seen "
    "FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey DESC) <= 100",
)
def fifo(s, d):
    return adaptive.bounded_buffer(table(s, d, "orders").select((F.col("o_custkey") % 3).alias("g"), "o_orderkey"), ["g"], "o_orderkey", AdaptivePolicy(buffer=100))


@query("L04_S14_first_sight",
    "SELECT o_custkey AS machine_id, o_orderkey AS path, "
    "CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) > 2 THEN 'baseline_skipped' ELSE 'pending' END AS status "
    "FROM orders",
)
def first_sight(s, d):
    from fleetvane.sources.logs import first_sight as mark

    return mark(table(s, d, "orders").select(F.col("o_custkey").alias("machine_id"), F.col("o_orderkey").alias("path")), 2)


@query("U01_U02_U03_U04_U06_sets",
    "SELECT k, count(*) AS n, count(DISTINCT src) AS sources FROM (SELECT c_nationkey AS k, 'c' AS src FROM customer "
    "UNION ALL SELECT s_nationkey, 's' FROM supplier) GROUP BY 1 HAVING count(*) > 1 AND k IN (SELECT s_nationkey "
    "FROM supplier INTERSECT SELECT c_nationkey FROM customer)",
)
def sets(s, d):
    c, p = table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))
    both = c.withColumn("src", F.lit("c")).unionByName(p.withColumn("src", F.lit("s")))
    return both.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources")).where("n > 1").join(c.intersect(p), "k", "left_semi")


@query("W20_Q06_Q13_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest(s, d):
    return serving.latest(table(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("F12_Q07_filters",
    f"{WITH_WIN} SELECT machine_id, module_id, window_start_s, window_status FROM win "
    f"WHERE module_id = 2 AND machine_id = 'MX001' AND window_status = 'ELIGIBLE'",
)
def filters(s, d):
    return _windows(s, d).where("module_id = 2 and machine_id = 'MX001' and window_status = 'ELIGIBLE'").select(*GROUP, "window_start_s", "window_status")


@query("Q08_comparison",
    "SELECT CAST(o_orderdate AS DATE) AS day, max(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS u, "
    "max(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS l FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') "
    "GROUP BY 1",
)
def comparison(s, d):
    x = table(s, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("key")).agg(F.max("o_totalprice").alias("p"))
    return serving.compare(x, ["1-URGENT", "5-LOW"], "day", "p").select("day", F.col("1-URGENT").alias("u"), F.col("5-LOW").alias("l"))


@query("S12_signature", "SELECT p_partkey, sha256(concat_ws('|', p_name, CAST(p_size AS VARCHAR), CAST(p_partkey AS VARCHAR))) AS signature FROM part")
def signatures(s, d):
    p = table(s, d, "part").select("p_partkey", F.col("p_name").alias("path"), F.col("p_size").alias("length"), F.col("p_partkey").alias("modified"))
    return serving.signature(p).select("p_partkey", "signature")
