"""Queries of the scoring cycle on given profiles, which lack some modules, modes and contexts, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetvane.config import GROUP, SPARSE
from fleetvane.operators import cycle, profiles
from fleetvane.operators.forests import Forest, mean_path
from fleetvane.plans.catalog import MODE_SQL, WIN_S, WITH_WIN, _r, _rs, _windows, query  # noqa: F401
from fleetvane.shared import shared_dir, written
from fleetvane.streaming.cycle import score_stream, use_rocksdb

#: The given line of lp2 by hp2, valve, temphi and templo, and the scales of what is centered by its median.
INTERCEPT, SLOPES = 10.0, (0.18, 0.05, 0.01, -0.02)
WIDTHS = {"hp2": 4.0, "pressure_gap": 3.0, "temperature_span": 0.5}
RESIDUAL_WIDTH = 0.05
#: A forest of one cut: what lies at 1.2 or more of z_hp2 is alone.
CUT, MANY, SIZE = 1.2, 100, 256
SCORES = tuple(float(2.0 ** (-(1 + mean_path(n)) / mean_path(SIZE))) for n in (MANY, 1))
ENTRY, EXIT = 0.8, 0.5
_NO_MODULE = "(machine_id = 'MX002' AND module_id = 5)"
_NO_MODE = "operating_mode = 'SV_ON_VALVE_B2'"
_NO_CONTEXT = "(module_id = 3 AND operating_mode = 'SV_OFF_VALVE_B1')"
_RESIDUAL = f"lp2 - ({INTERCEPT}::DOUBLE + {SLOPES[0]}::DOUBLE * hp2 + {SLOPES[1]}::DOUBLE * valve + {SLOPES[2]}::DOUBLE * temphi + {SLOPES[3]}::DOUBLE * templo)"


def _stump() -> bytes:
    """The given forest, one tree of a root and two leaves."""
    return Forest(np.array([0]), np.array([0, -1, -1], np.int16), np.array([CUT, 0.0, 0.0]), np.array([1, -1, -1], np.int32), np.array([2, -1, -1], np.int32), np.array([0.0, 1 + mean_path(MANY), 1.0]), SIZE).to_bytes()


def given(w: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Modules, regimes, contexts and the second evidence that the windows meet."""
    modules = w.select(*GROUP).distinct().where(f"NOT {_NO_MODULE}").withColumn("profile_version", F.lit("v1"))
    eligible = w.where("window_status = 'ELIGIBLE'")
    modes = eligible.select(*GROUP, "operating_mode").distinct().where(f"NOT {_NO_MODE}")
    one = lambda *v: F.array(*map(F.lit, v))
    regimes = modes.withColumns({"weights": one(1.0), "means": F.array(one(0.0, 0.0, 0.0, 0.0, 0.0)), "covariances": F.array(F.array(*[one(*row) for row in np.eye(5).tolist()])), "likelihood_floor": F.lit(float("-inf")), "fallback": F.lit(True)})
    line = F.lit(INTERCEPT) + sum((F.lit(b) * F.col(c) for b, c in zip(SLOPES, profiles.RIDGE_FEATURES, strict=True)), F.lit(0.0))
    half = F.lit(0.5)
    contexts = eligible.where(f"NOT {_NO_CONTEXT}").withColumn("residual", F.col("lp2") - line).groupBy(*GROUP, "operating_mode").agg(F.create_map(*[x for c in WIDTHS for x in (F.lit(c), F.percentile(c, half))]).alias("centers"), F.percentile("residual", half).alias("residual_center"))
    contexts = contexts.withColumns({"regime": F.lit("R0"), "intercept": F.lit(INTERCEPT), "coefficients": one(*SLOPES), "scales": F.create_map(*[F.lit(x) for c in WIDTHS.items() for x in c]), "residual_scale": F.lit(RESIDUAL_WIDTH), "forest": F.lit(_stump()), "forest_entry": F.lit(ENTRY), "forest_exit": F.lit(EXIT)})
    score = (F.col("point_count") % 7).cast("double")
    second = w.select(*GROUP, "window_start_s", score.alias("second_score"), F.lit(4.0).alias("second_threshold"), (score >= 4).alias("second_active"), F.when(score >= 4, "LSTM_RECONSTRUCTION_ANOMALY").alias("second_reason"))
    return modules, regimes, contexts, second


_LATCHED = {"hp2": ("abs(z_hp2) >= 3.5", "abs(z_hp2) < 2.5"), "gap": ("abs(z_gap) >= 3.5", "abs(z_gap) < 2.5"), "span": ("abs(z_span) >= 3.5", "abs(z_span) < 2.5"), "lp2": ("z_lp2 <= -3.5", "z_lp2 > -2.5"), "forest": (f"forest_score >= {ENTRY}", f"forest_score < {EXIT}")}
_CODES = {"hp2_on": "HP2_ROBUST_Z", "trend_on": "LP2_DOWNWARD_TREND", "lp2_on": "LP2_NEGATIVE_RESIDUAL", "gap_on": "PRESSURE_GAP_ANOMALY", "forest_on": "PRESSURE_PATTERN_ANOMALY", "span_on": "TEMPERATURE_SPAN_ANOMALY"}
_K = "PARTITION BY machine_id, module_id, operating_mode ORDER BY window_start_s"
_I = "PARTITION BY machine_id, module_id, operating_mode, island ORDER BY window_start_s"
_UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
CYCLE = f"""
el AS (SELECT *, {_RESIDUAL} AS lp2_residual FROM win WHERE window_status = 'ELIGIBLE'),
cn AS (SELECT machine_id, module_id, operating_mode, {', '.join(f'median({c}) AS c_{c}' for c in (*WIDTHS, 'lp2_residual'))} FROM el WHERE NOT {_NO_CONTEXT} GROUP BY 1, 2, 3),
lk AS (SELECT win.*, CASE WHEN window_status <> 'ELIGIBLE' THEN NULL WHEN {_NO_MODULE} THEN 'PROFILE_NOT_ACTIVE' WHEN {_NO_MODE} THEN 'MODE_NOT_IN_PROFILE' WHEN {_NO_CONTEXT} THEN 'CONTEXT_PROFILE_NOT_AVAILABLE' END AS missing FROM win),
st AS (SELECT * REPLACE (CASE WHEN missing = 'PROFILE_NOT_ACTIVE' THEN missing WHEN missing IS NOT NULL THEN 'UNKNOWN_REGIME' ELSE window_status END AS window_status) FROM lk),
z0 AS (SELECT st.*, {_RESIDUAL} AS lp2_residual, (hp2 - c_hp2) / 4.0 AS z_hp2, ({_RESIDUAL} - c_lp2_residual) / {RESIDUAL_WIDTH}::DOUBLE AS z_lp2, (pressure_gap - c_pressure_gap) / 3.0 AS z_gap, (temperature_span - c_temperature_span) / 0.5 AS z_span
  FROM st JOIN cn USING (machine_id, module_id, operating_mode) WHERE window_status = 'ELIGIBLE'),
zs AS (SELECT *, CASE WHEN z_hp2 < {CUT} THEN {SCORES[0]!r}::DOUBLE ELSE {SCORES[1]!r}::DOUBLE END AS forest_score, point_count % 7 >= 4 AS second_active FROM z0),
is0 AS (SELECT *, CASE WHEN window_start_s - lag(window_start_s) OVER ({_K}) > {SPARSE.reset_s} THEN 1 ELSE 0 END AS brk FROM zs),
isl AS (SELECT *, sum(brk) OVER k AS island, {', '.join(f"coalesce(last_value(CASE WHEN {on} THEN true WHEN {off} THEN false END IGNORE NULLS) OVER k, false) AS {n}_on" for n, (on, off) in _LATCHED.items())} FROM is0 WINDOW k AS ({_K} {_UP})),
tr0 AS (SELECT *, z_lp2 - first_value(z_lp2) OVER ({_I} RANGE BETWEEN {int(SPARSE.trend_s)} PRECEDING AND CURRENT ROW) AS trend FROM isl),
tr1 AS (SELECT *, coalesce(last_value(CASE WHEN trend <= -3 THEN true WHEN abs(trend) < 2 THEN false END IGNORE NULLS) OVER ({_I} {_UP}), false) AS trend_on FROM tr0),
ac AS (SELECT *, {' OR '.join(_CODES)} AS active FROM tr1),
rr AS (SELECT *, sum(CASE WHEN active THEN 0 ELSE 1 END) OVER ({_I}) AS ra, sum(CASE WHEN second_active THEN 0 ELSE 1 END) OVER ({_I}) AS rb FROM ac),
evi AS (SELECT *, CASE WHEN active THEN window_start_s - min(CASE WHEN active THEN window_start_s END) OVER (PARTITION BY machine_id, module_id, operating_mode, island, ra) + {WIN_S} ELSE 0 END AS first_s,
  CASE WHEN second_active THEN window_start_s - min(CASE WHEN second_active THEN window_start_s END) OVER (PARTITION BY machine_id, module_id, operating_mode, island, rb) + {WIN_S} ELSE 0 END AS second_s,
  concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _CODES.items())}) AS codes FROM rr),
cyc AS (SELECT st.machine_id, st.module_id, st.window_start_s, st.window_status, CASE WHEN st.window_status IN ('ELIGIBLE', 'UNKNOWN_REGIME') THEN st.operating_mode END AS operating_mode,
  CASE WHEN st.missing = 'MODE_NOT_IN_PROFILE' THEN 'UNKNOWN_REGIME' WHEN st.window_status IN ('ELIGIBLE', 'UNKNOWN_REGIME') THEN 'R0' END AS regime,
  array_to_string(list_sort(list_distinct(list_filter(string_split(concat_ws(',', nullif(st.reasons, ''), st.missing, nullif(codes, ''), CASE WHEN second_active THEN 'LSTM_RECONSTRUCTION_ANOMALY' END), ','), lambda x: x <> ''))), ',') AS reason_codes,
  coalesce(active, false) AS first_active, CAST(coalesce(first_s, 0) AS BIGINT) AS first_s, coalesce(second_active, false) AS second_active, CAST(coalesce(second_s, 0) AS BIGINT) AS second_s,
  z_hp2, z_lp2, z_gap, z_span, forest_score, trend,
  CASE WHEN st.window_status <> 'ELIGIBLE' THEN st.window_status WHEN active AND second_active AND first_s >= {SPARSE.p1_s} AND second_s >= {SPARSE.p1_s} THEN 'P1_REVIEW' WHEN (active AND first_s >= {SPARSE.p2_s}) OR (second_active AND second_s >= {SPARSE.p2_s}) THEN 'P2_REVIEW' WHEN active OR second_active THEN 'SHADOW' ELSE 'NORMAL' END AS review_level
  FROM st LEFT JOIN evi ON st.machine_id = evi.machine_id AND st.module_id = evi.module_id AND st.window_start_s = evi.window_start_s)"""
WITH_CYCLE = f"{WITH_WIN}, {CYCLE}"
_Z = ("z_hp2", "z_lp2", "z_gap", "z_span", "forest_score", "trend")


def _scored(s, d):
    w = _windows(s, d)
    return cycle.score_windows(w, *given(w), SPARSE)


@query("J02_J03_J04_look_ups",
    f"{WITH_CYCLE} SELECT machine_id, module_id, window_start_s, st.window_status, st.missing, cyc.operating_mode, regime FROM st "
    f"JOIN cyc USING (machine_id, module_id, window_start_s)",
)
def look_ups(s, d):
    """Windows of modules without a profile, of modes and of contexts that it lacks keep their row and say why."""
    w = _windows(s, d)
    return cycle.look_up(w, *given(w)[:3], SPARSE).select(*GROUP, "window_start_s", "window_status", "missing", "operating_mode", "regime")


@query("M17_W16_M22_cycle", f"{WITH_CYCLE} SELECT machine_id, module_id, window_start_s, window_status, operating_mode, regime, reason_codes, first_active, first_s, second_active, second_s, review_level, {_rs(*_Z, places=4)} FROM cyc")
def scoring_cycle(s, d):
    out = _scored(s, d).withColumns({"reason_codes": F.array_join("reason_codes", ","), "first_active": F.col("active"), "first_s": F.col("persistent_s").cast("long"), "second_s": F.col("second_s").cast("long")})
    return _r(out.select(*GROUP, "window_start_s", "window_status", "operating_mode", "regime", "reason_codes", "first_active", "first_s", "second_active", "second_s", "review_level", *_Z), *_Z, places=4)


@query("P14_flat_decisions",
    f"{WITH_CYCLE} SELECT machine_id, module_id, window_start_s, review_level, window_status, "
    f"CASE WHEN cyc.window_status IN ('ELIGIBLE') THEN round(abs(z_hp2), 4) END AS z, CAST(point_count % 7 AS DOUBLE) / 4 AS second_ratio "
    f"FROM cyc JOIN (SELECT machine_id, module_id, window_start_s, point_count "
    f"FROM win) USING (machine_id, module_id, window_start_s)",
)
def flat(s, d):
    f = cycle.flat_decisions(_scored(s, d))
    return f.select(*GROUP, "window_start_s", "review_level", "window_status", F.round(F.abs("z_hp2"), 4).alias("z"), "second_ratio")


@query("F10_F11_clean_windows",
    f"{WITH_CYCLE}, fi AS (SELECT * FROM win WHERE window_status = 'ELIGIBLE' AND point_count % 7 <= 4), "
    f"sc AS (SELECT fi.*, evi.z_hp2, evi.z_lp2, evi.z_gap, evi.z_span, evi.forest_score FROM fi "
    f"JOIN evi USING (machine_id, module_id, window_start_s)) SELECT machine_id, module_id, window_start_s FROM sc "
    f"WHERE NOT (abs(z_hp2) >= 3.5 OR z_lp2 <= -3.5 OR abs(z_gap) >= 3.5 OR abs(z_span) >= 3.5 OR forest_score >= {ENTRY})".replace("WHERE NOT (abs", f"WHERE NOT {_NO_MODE} AND NOT {_NO_CONTEXT} AND NOT (abs"))
def clean(s, d):
    """The given profile stands for the one that would be fit; it knows every module here."""
    w = _windows(s, d)
    _, regimes, contexts, _ = given(w)
    ratios = w.select(*GROUP, "window_start_s", (F.col("point_count") % 7 / 4).alias("ratio"))
    kept = cycle.clean_windows(w.where("window_status = 'ELIGIBLE'"), ratios, lambda _: (regimes, contexts), SPARSE)[1]
    return kept.where(f"NOT {_NO_MODULE}").select(*GROUP, "window_start_s")


_MEANS = ((180.0, 20.0, 30.0, 74.0, 18.0), (200.0, 50.0, 70.0, 75.0, 17.0))
_VARS = ((400.0, 90.0, 300.0, 8.0, 6.0), (500.0, 120.0, 260.0, 9.0, 5.0))
_WEIGHTS = (0.4, 0.6)
_LOGS = [f"ln({w}) - 0.5 * (5 * ln(2 * pi()) + {' + '.join(f'ln({v + 1e-6})' for v in vs)} + {' + '.join(f'power({c} - {m}, 2) / {v + 1e-6}' for c, m, v in zip(profiles.REGIME_FEATURES, ms, vs, strict=True))})" for w, ms, vs in zip(_WEIGHTS, _MEANS, _VARS, strict=True)]


@query("M13_regimes_of_given_models",
    f"{WITH_WIN}, lg AS (SELECT machine_id, module_id, window_start_s, {_LOGS[0]} AS a, {_LOGS[1]} AS b FROM win "
    f"WHERE window_status = 'ELIGIBLE'), "
    f"ll AS (SELECT *, greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS ll FROM lg), "
    f"po AS (SELECT *, exp(greatest(a, b) - ll) AS p FROM ll) SELECT machine_id, module_id, window_start_s, "
    f"round(p, 5) AS posterior, round(ll, 4) AS log_likelihood, "
    f"CASE WHEN p < 0.6 THEN 'LOW_POSTERIOR' WHEN ll < -20 THEN 'LOW_LIKELIHOOD' ELSE '' END AS regime_reason, "
    f"CASE WHEN p < 0.6 OR ll < -20 THEN 'UNKNOWN_REGIME' WHEN a >= b THEN 'R0' ELSE 'R1' END AS regime FROM po",
)
def regimes_of_given_models(s, d):
    w = _windows(s, d).where("window_status = 'ELIGIBLE'")
    rows = lambda x: F.array(*[F.array(*map(F.lit, r)) for r in x])
    model = w.select(*GROUP, "operating_mode").distinct().withColumns({"weights": F.array(*map(F.lit, _WEIGHTS)), "means": rows(_MEANS), "covariances": F.array(*[rows(np.diag(v).tolist()) for v in _VARS]), "likelihood_floor": F.lit(-20.0), "fallback": F.lit(False)})
    out = profiles.resolve_regimes(w, model, SPARSE, policy_floor=False)
    return out.select(*GROUP, "window_start_s", F.round("posterior", 5).alias("posterior"), F.round("log_likelihood", 4).alias("log_likelihood"), "regime_reason", "regime")


@query("T04_stream_cycle", f"{WITH_CYCLE} SELECT machine_id, module_id, window_start_s, window_status, operating_mode, regime, reason_codes, first_active, first_s, second_active, second_s, review_level, {_rs(*_Z, places=4)} FROM cyc")
def stream_cycle(s, d):
    """The same windows as a stream of three batches, whose state goes from one to the next."""
    use_rocksdb(s)
    base = shared_dir(s, "stream")
    w = written(_windows(s, d), "windows")
    modules, regimes, contexts, second = (written(df, "given") for df in given(w))
    parts = w.withColumn("_part", F.ntile(3).over(Window.orderBy("window_start_s")))
    for i in (1, 2, 3):
        parts.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = s.readStream.schema(w.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out = score_stream(source, modules, regimes, contexts, second, SPARSE)
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = s.read.parquet(f"{base}/out").withColumns({"reason_codes": F.array_join("reason_codes", ","), "first_active": F.col("active"), "first_s": F.col("persistent_s").cast("long")})
    return _r(out.select(*GROUP, "window_start_s", "window_status", "operating_mode", "regime", "reason_codes", "first_active", "first_s", "second_active", "second_s", "review_level", *_Z), *_Z, places=4)
