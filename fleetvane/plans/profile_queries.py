"""Queries of fitted profiles and of candidate validation over telemetry, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvane.config import GROUP
from fleetvane.functions import scalar as S
from fleetvane.operators import adaptive, profiles, reconstruct, serving, validation
from fleetvane.plans.catalog import MODE_SQL, SEQ, TEL, _flags, _r, _rs, _tel, query
from fleetvane.sources import prepared
from fleetvane.sources.telemetry import table

KEY = ("machine_id", "module_id", "operating_mode")
X = profiles.RIDGE_FEATURES
_MODES = f"""{TEL}, md AS (SELECT *, {MODE_SQL} AS operating_mode, hp2 - lp2 AS pressure_gap, temphi - templo AS temperature_span FROM tel),
ok AS (SELECT * FROM md QUALIFY count(*) OVER (PARTITION BY machine_id, module_id, operating_mode) >= 25)"""


def _rows(s, d) -> DataFrame:
    """Telemetry by machine, module and mode, one row an event."""
    mode = S.operating_mode(F.col("sv"), F.col("valve"))
    return _tel(s, d).withColumns({"operating_mode": mode, "pressure_gap": F.col("hp2") - F.col("lp2"), "pressure_ratio": S.ratio(F.col("hp2"), F.col("lp2"), 0.1), "temperature_span": F.col("temphi") - F.col("templo")})


# Mixtures: what holds for every fit, whatever its components


@query(
    "M12_mixture_moments",
    f"""WITH {_MODES}
SELECT machine_id, module_id, operating_mode, count(*) AS windows, {', '.join(f'round(avg({c}), 3) AS mean_{c}' for c in profiles.REGIME_FEATURES)}, {', '.join(f'round(var_pop({c}) + 0.00123, 2) AS spread_{c}' for c in profiles.REGIME_FEATURES)}
FROM md GROUP BY 1, 2, 3 HAVING count(*) >= {profiles.LEAST_REGIME}""",
)
def mixture_moments(s, d):
    """A fitted mixture has its group's mean, and its group's variances but for the ridge."""
    m = profiles.fit_regimes(_rows(s, d)).where("not fallback").withColumn("c", F.explode(F.arrays_zip("weights", "means", "covariances")))
    n = range(len(profiles.REGIME_FEATURES))
    mean = [F.sum(F.col("c.weights") * F.col("c.means")[i]) for i in n]
    second = [F.sum(F.col("c.weights") * (F.col("c.covariances")[i][i] + F.col("c.means")[i] * F.col("c.means")[i])) for i in n]
    out = m.groupBy(*KEY, "windows").agg(*[F.round(v, 3).alias(f"mean_{c}") for v, c in zip(mean, profiles.REGIME_FEATURES, strict=True)], *[F.round(v - e * e - 1e-5 + 0.00123, 2).alias(f"spread_{c}") for v, e, c in zip(second, mean, profiles.REGIME_FEATURES, strict=True)])
    return out


# Contexts: ridge coefficients by elimination, centers and scales


def _elimination() -> str:
    """CTEs that solve (n * covariance + 1) b = n * covariance with lp2, column after column."""
    d = range(len(X))
    cells = [f"count(*) * covar_pop({a}, {b}) + {int(i == j)} AS a{i}{j}" for i, a in enumerate(X) for j, b in enumerate(X)]
    steps = [f"g0 AS (SELECT machine_id, module_id, operating_mode, count(*) AS windows, avg(lp2) AS my, {', '.join(f'avg({c}) AS m{i}' for i, c in enumerate(X))}, {', '.join(cells)}, {', '.join(f'count(*) * covar_pop({c}, lp2) AS r{i}' for i, c in enumerate(X))} FROM ok GROUP BY 1, 2, 3)"]
    for k in d:
        new = [f"a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j} AS a{i}{j}" for i in d for j in d if i > k and j >= k] + [f"r{i} - a{i}{k} / a{k}{k} * r{k} AS r{i}" for i in d if i > k]
        steps.append(f"g{k + 1} AS (SELECT {'* REPLACE (' + ', '.join(new) + ')' if new else '*'} FROM g{k})")
    last = len(X)
    for k in reversed(d):
        minus = "".join(f" - a{k}{j} * b{j}" for j in d if j > k)
        steps.append(f"g{last + 1} AS (SELECT *, (r{k}{minus}) / a{k}{k} AS b{k} FROM g{last})")
        last += 1
    steps.append(f"ln AS (SELECT machine_id, module_id, operating_mode, windows, my - ({' + '.join(f'b{i} * m{i}' for i in d)}) AS intercept, {', '.join(f'b{i}' for i in d)} FROM g{last})")
    return ",\n".join(steps)


_CONTEXTS = f"""{_MODES},
{_elimination()},
rs AS (SELECT ok.*, lp2 - intercept - ({' + '.join(f'b{i} * {c}' for i, c in enumerate(X))}) AS residual FROM ok JOIN ln USING (machine_id, module_id, operating_mode)),
ce AS (SELECT machine_id, module_id, operating_mode, median(hp2) AS center_hp2, median(residual) AS residual_center FROM rs GROUP BY 1, 2, 3),
sc AS (SELECT machine_id, module_id, operating_mode, any_value(center_hp2) AS center_hp2, any_value(residual_center) AS residual_center, greatest(1.4826::DOUBLE * median(abs(hp2 - center_hp2)), 1e-6) AS scale_hp2, greatest(1.4826::DOUBLE * median(abs(residual - residual_center)), 1e-6) AS residual_scale
  FROM rs JOIN ce USING (machine_id, module_id, operating_mode) GROUP BY 1, 2, 3)"""
_PROFILE = ("intercept", "b0", "b1", "b2", "b3", "center_hp2", "scale_hp2", "residual_center", "residual_scale")


@query("M14_M15_M16_M18_profiles_of_modes",
    f"WITH {_CONTEXTS} SELECT machine_id, module_id, operating_mode, windows, {_rs(*_PROFILE, places=4)}, true AS levels FROM ln "
    f"JOIN sc USING (machine_id, module_id, operating_mode)",
)
def profiles_of_modes(s, d):
    """Coefficients equal the solved normal equations; levels: the forest's exit level isn't above its entry level, and both are in (0, 1)."""
    p = profiles.fit_contexts(_rows(s, d).withColumn("regime", F.lit("R0")))
    levels = (F.col("forest_exit") <= F.col("forest_entry")) & F.col("forest_exit").between(0.01, 0.99) & F.col("forest_entry").between(0.01, 0.99)
    out = p.select(*KEY, "windows", "intercept", *[F.col("coefficients")[i].alias(f"b{i}") for i in range(len(X))], F.col("centers")["hp2"].alias("center_hp2"), F.col("scales")["hp2"].alias("scale_hp2"), "residual_center", "residual_scale", levels.alias("levels"))
    return _r(out, *_PROFILE, places=4)


# Golden profiles, dual scores and validation on arrays of four features

V = ("hp2", "lp2", "valve", "temphi")


def _summaries(s, d) -> DataFrame:
    t = _tel(s, d)
    return t.select(*GROUP, "source_order", "us", F.array(*V).alias("summary"), (0.01 * F.abs(F.col("lp2") - 50)).alias("error"))


_SUM = f"{TEL}, sm AS (SELECT *, 0.01::DOUBLE * abs(lp2 - 50) AS error FROM tel)"
_GOLD = (
    f"{_SUM}, gc AS (SELECT machine_id, module_id, {', '.join(f'median({c}) AS c_{c}, stddev_pop({c}) AS d_{c}' for c in V)} FROM sm GROUP BY 1, 2),"
    f" gm AS (SELECT machine_id, module_id, {', '.join(f'1.4826::DOUBLE * median(abs({c} - c_{c})) AS m_{c}, any_value(c_{c}) AS c_{c}, any_value(d_{c}) AS d_{c}' for c in V)} FROM sm JOIN gc USING (machine_id, module_id) GROUP BY 1, 2),"
    f" gs AS (SELECT machine_id, module_id, {', '.join(f'c_{c}, CASE WHEN m_{c} > 1e-8 THEN m_{c} WHEN d_{c} > 1e-8 THEN d_{c} ELSE 1 END AS s_{c}' for c in V)} FROM gm),"
    f" gd AS (SELECT sm.machine_id, sm.module_id, error, greatest({', '.join(f'abs({c} - c_{c}) / s_{c}' for c in V)}) AS deviation FROM sm JOIN gs USING (machine_id, module_id))"
)
_GOLDEN = (*[f"{k}_{c}" for c in V for k in ("c", "s")], "error_threshold", "deviation_threshold")


@query("M04_M06_A21_golden_profiles",
    f"WITH {_GOLD} SELECT machine_id, module_id, windows, {_rs(*_GOLDEN, places=5)} FROM gs JOIN (SELECT machine_id, module_id, "
    f"count(*) AS windows, quantile_cont(error, 0.99) AS error_threshold, quantile_cont(deviation, 0.99) AS deviation_threshold "
    f"FROM gd GROUP BY 1, 2) USING (machine_id, module_id)",
)
def golden_profiles(s, d):
    g = adaptive.build_golden(_summaries(s, d))
    sides = [F.col(f"golden_{side}")[i].alias(f"{k}_{c}") for i, c in enumerate(V) for k, side in (("c", "center"), ("s", "scale"))]
    return _r(g.select(*GROUP, "windows", *sides, F.col("golden_error_threshold").alias("error_threshold"), F.col("adaptive_deviation_threshold").alias("deviation_threshold")), *_GOLDEN, places=5)


#: Given profiles: centers, scales, an inverse and limits of the golden and the adaptive side, and a candidate's.
INVERSE = ((1.2, 0.1, 0.0, 0.0), (0.1, 1.1, 0.05, 0.0), (0.0, 0.05, 0.9, 0.0), (0.0, 0.0, 0.0, 1.0))
SIDES = {
    "golden": ((240.0, 56.0, 50.0, 74.0), (60.0, 11.0, 30.0, 3.0), (0.25, 2.2, 1.6)),
    "adaptive": ((245.0, 57.0, 49.0, 74.5), (62.0, 11.5, 29.0, 3.1), (0.26, 2.1, 1.5)),
    "candidate": ((248.0, 57.5, 47.5, 74.4), (60.0, 11.0, 30.5, 3.0), (0.275, 2.1, 1.45)),
}


def _given(kind: str, name: str) -> list:
    center, scale, (error, deviation, distance) = SIDES[kind]
    one = lambda v: F.array(*map(F.lit, v))
    return [one(center).alias(f"{name}_center"), one(scale).alias(f"{name}_scale"), F.array(*map(one, INVERSE)).alias(f"{name}_inverse"), F.lit(error).alias(f"{name}_error_threshold"), F.lit(deviation).alias(f"{name}_deviation_threshold"), F.lit(distance).alias(f"{name}_distance_threshold")]


def _risk(kind: str, columns: tuple[str, ...] = V) -> str:
    center, scale, (error, deviation, distance) = SIDES[kind]
    z = [f"(({c} - {m}::DOUBLE) / {w}::DOUBLE)" for c, m, w in zip(columns, center, scale, strict=True)]
    form = " + ".join(f"{v}::DOUBLE * {z[i]} * {z[j]}" for i, row in enumerate(INVERSE) for j, v in enumerate(row) if v)
    return f"greatest(error / {error}::DOUBLE, greatest({', '.join(f'abs({x})' for x in z)}) / {deviation}::DOUBLE, sqrt(greatest({form}, 0) / 4) / {distance}::DOUBLE)"


_DUAL = (
    f"{_SUM}, dr AS (SELECT *, {_risk('golden')} AS golden_risk, {_risk('adaptive')} AS adaptive_risk FROM sm), "
    f"rk AS (SELECT *, greatest(adaptive_risk, 0.5 * golden_risk) AS risk FROM dr)"
)


@query("M05_M07_P21_scores_of_given_profiles",
    f"WITH {_DUAL} SELECT source_order, {_rs('golden_risk', 'adaptive_risk', 'risk', places=5)}, "
    f"round(least(greatest(100 - 40 * risk, 0), 100), 3) AS health, "
    f"CASE WHEN risk < 0.5 THEN 'Normal' WHEN risk < 1 THEN 'Watch' WHEN risk < 1.5 THEN 'Warning' ELSE 'Critical' END AS condition, golden_risk >= 1 AS baseline_drift, adaptive_risk < 0.5 AND golden_risk < 0.8 AS eligible "
    f"FROM rk",
)
def scores_of_given_profiles(s, d):
    x = _summaries(s, d)
    given = x.select(*GROUP).distinct().select(*GROUP, *_given("golden", "golden"), *_given("adaptive", "adaptive"))
    out = adaptive.dual_scores(x, given, list(GROUP))
    return _r(out.select("source_order", "golden_risk", "adaptive_risk", "risk", F.round("health", 3).alias("health"), "condition", "baseline_drift", "eligible"), "golden_risk", "adaptive_risk", "risk", places=5)


_SPLIT = "source_order % 3 < 2"
_MOVED = ", ".join(f"CASE WHEN j = {i} THEN {m}::DOUBLE + CASE WHEN {c} >= {m} THEN 1 ELSE -1 END * {SIDES['golden'][2][1] + 3}::DOUBLE * {w}::DOUBLE ELSE {c} END AS {c}" for i, (c, m, w) in enumerate(zip(V, SIDES["golden"][0], SIDES["golden"][1], strict=True)))
_C, _A, _G = SIDES["candidate"], SIDES["adaptive"], SIDES["golden"]
_STEPS = (max(abs(a - b) / g for a, b, g in zip(_C[0], _A[0], _G[1], strict=True)), max(abs(a / b - 1) for a, b in zip(_C[1], _A[1], strict=True)), abs(_C[2][0] / _A[2][0] - 1))
_VALID = f"""{_SUM}, rf AS (SELECT *, (row_number() OVER (PARTITION BY machine_id, module_id ORDER BY source_order) - 1) % 4 AS j FROM sm WHERE {_SPLIT}),
sy AS (SELECT machine_id, module_id, {_MOVED}, error FROM rf),
al AS (SELECT machine_id, module_id, 'reference' AS kind, NULL AS day, {_risk('adaptive')} >= 1 AS o, {_risk('candidate')} >= 1 AS n FROM rf
  UNION ALL SELECT machine_id, module_id, 'synthetic', NULL, {_risk('adaptive')} >= 1, {_risk('candidate')} >= 1 FROM sy
  UNION ALL SELECT machine_id, module_id, 'recent', us // 86400000000, {_risk('adaptive')} >= 1, {_risk('candidate')} >= 1 FROM sm WHERE NOT ({_SPLIT})),
va AS (SELECT machine_id, module_id, count(*) FILTER (kind = 'recent') AS windows, count(DISTINCT day) AS days, {', '.join(f"coalesce(avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (kind = '{k}'), 0) AS {n}" for k, c, n in (('reference', 'o', 'champion_reference'), ('reference', 'n', 'candidate_reference'), ('recent', 'n', 'candidate_recent'), ('synthetic', 'o', 'champion_synthetic'), ('synthetic', 'n', 'candidate_synthetic')))},
  {_STEPS[0]!r}::DOUBLE AS center_step, {_STEPS[1]!r}::DOUBLE AS scale_change, {_STEPS[2]!r}::DOUBLE AS threshold_change FROM al GROUP BY 1, 2),
vr AS (SELECT *, concat_ws(',', CASE WHEN windows < 200 THEN 'insufficient_candidate_windows' END, CASE WHEN days < 3 THEN 'insufficient_candidate_days' END) AS short, concat_ws(',', CASE WHEN candidate_reference > greatest(0.05, champion_reference + 0.02) THEN 'reference_false_alert_rate_regressed' END,
  CASE WHEN candidate_recent > 0.05 THEN 'candidate_does_not_fit_eligible_recent_data' END, CASE WHEN candidate_synthetic < 0.8 THEN 'synthetic_detection_below_guardrail' END, CASE WHEN candidate_synthetic + 0.05 < champion_synthetic THEN 'synthetic_detection_regressed' END,
  CASE WHEN center_step > 0.1 + 1e-9 THEN 'center_step_exceeded' END, CASE WHEN scale_change > 0.1 + 1e-9 THEN 'scale_step_exceeded' END, CASE WHEN threshold_change > 0.1 + 1e-9 THEN 'threshold_step_exceeded' END) AS failed FROM va)"""
_TEN = validation.RATES[2:]


def _baselines(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    groups = x.select(*GROUP).distinct()
    return groups.select(*GROUP, *_given("golden", "golden"), *_given("adaptive", "adaptive")), groups.select(*GROUP, *_given("candidate", "adaptive"))


@query("M10_candidate_validation",
    f"WITH {_VALID} SELECT machine_id, module_id, windows, days, {_rs(*_TEN)}, "
    f"CASE WHEN failed <> '' THEN 'AUTO_REJECTED' WHEN short <> '' THEN 'REVIEW_REQUIRED' ELSE 'SHADOW' END AS outcome, "
    f"coalesce(nullif(concat_ws(',', nullif(short, ''), nullif(failed, '')), ''), 'all_validation_gates_passed') AS reasons FROM vr",
)
def candidate_validation(s, d):
    """The ten figures of a given candidate against a given champion, and the verdict."""
    x = _summaries(s, d)
    champions, candidates = _baselines(x)
    recent = x.where(f"not ({_SPLIT})").withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    out = validation.verdicts(validation.candidate_rates(champions, candidates, x.where(_SPLIT), recent, list(GROUP), "source_order"))
    return _r(out.withColumn("reasons", F.array_join("reasons", ",")).select(*GROUP, *validation.RATES, "outcome", "reasons"), *_TEN)


_TESTED = f"""{_VALID.split(chr(10) + 'al AS')[0]}
te AS (SELECT machine_id, module_id, avg(CASE WHEN {_risk('adaptive')} >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS alert_rate FROM rf GROUP BY 1, 2),
ts AS (SELECT machine_id, module_id, avg(CASE WHEN {_risk('adaptive')} >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS detection FROM sy GROUP BY 1, 2),
tt AS (SELECT *, alert_rate > greatest(0.05, CASE WHEN module_id = 1 THEN alert_rate ELSE 0.01 END + 0.02) AS bad_rate, detection < least(0.8, greatest(0, 1.0 - 0.05)) AS bad_detection FROM te JOIN ts USING (machine_id, module_id))"""


@query("M11_L08_self_tests",
    f"WITH {_TESTED} SELECT machine_id, module_id, {_rs('alert_rate', 'detection')}, "
    f"CASE WHEN NOT (bad_rate OR bad_detection) THEN 'CHAMPION_HEALTHY' WHEN module_id <= 3 THEN 'AUTO_ROLLED_BACK' ELSE 'REVIEW_REQUIRED' END AS outcome, concat_ws(',', "
    f"CASE WHEN bad_rate THEN 'deployed_reference_alert_rate_failed' END, "
    f"CASE WHEN bad_detection THEN 'deployed_synthetic_detection_failed' END, "
    f"CASE WHEN NOT (bad_rate OR bad_detection) THEN 'frozen_self_test_passed' WHEN module_id <= 3 THEN 'restored_previous_champion' ELSE 'no_rollback_profile_available' END) AS reasons, "
    f"CASE WHEN (bad_rate OR bad_detection) AND module_id <= 3 THEN 'v2' END AS restored_version FROM tt",
)
def self_tests(s, d):
    """Deployed profiles on their frozen rows; those of modules 1 to 3 have two former versions to fall back to."""
    x = _summaries(s, d)
    champions, _ = _baselines(x)
    champions = champions.withColumns({"deployed_alert_rate": F.when(F.col("module_id") != 1, F.lit(0.01)), "deployed_detection": F.lit(1.0)})
    history = champions.where("module_id <= 3").select(*GROUP, F.explode(F.array(*[F.struct(F.lit(f"v{i}").alias("version"), F.lit(i).alias("saved_at")) for i in (1, 2)])).alias("h")).select(*GROUP, "h.*")
    out = validation.self_tests(champions, x.where(_SPLIT), history, list(GROUP), "source_order")
    return _r(out.withColumn("reasons", F.array_join("reasons", ",")), "alert_rate", "detection")


# Reconstruction by principal components: with two features the leading axis has a closed form


@query(
    "M03_M21_component_errors",
    f"""WITH {TEL}, pc AS (SELECT machine_id, module_id, avg(hp2) AS mx, avg(lp2) AS my, 0.5::DOUBLE * atan2(2 * covar_pop(hp2, lp2), var_pop(hp2) - var_pop(lp2)) AS a FROM tel GROUP BY 1, 2),
er AS (SELECT source_order, abs(((lp2 - my) * cos(a) - (hp2 - mx) * sin(a)) * sin(a)) AS ex, abs(((lp2 - my) * cos(a) - (hp2 - mx) * sin(a)) * cos(a)) AS ey FROM tel JOIN pc USING (machine_id, module_id))
SELECT source_order, round((ex + ey) / 2, 4) + 0.0::DOUBLE AS error, CASE WHEN ex > ey THEN 'hp2' ELSE 'lp2' END AS top_feature FROM er""",
)
def component_errors(s, d):
    """Errors of one-step windows of two features by the component that is fit for each machine and module."""
    w = _tel(s, d).select("source_order", *GROUP, F.array(F.array("hp2", "lp2")).alias("seq"))
    out = reconstruct.component_errors(w, reconstruct.fit_components(w, list(GROUP), 1), list(GROUP), ("hp2", "lp2"))
    return _r(out.select("source_order", "error", "top_feature"), "error", places=4)


# Audit: a day of telemetry stands for a file


@query(
    "A10_S05_S06_file_audit",
    f"""{SEQ}, fl AS (SELECT CAST(us // 86400000000 AS VARCHAR) AS file, module_id, is_active FROM act), fs AS (SELECT DISTINCT file FROM fl), ak AS (SELECT file, unnest([1, 2, 3, 4, 5, 8]) AS module_id FROM fs),
co AS (SELECT file, module_id, count(*) AS raw_rows, count(*) FILTER (is_active) AS accepted_rows, count(*) FILTER (NOT is_active) AS rejected_rows FROM fl GROUP BY 1, 2)
SELECT file, module_id, coalesce(raw_rows, 0) AS raw_rows, coalesce(accepted_rows, 0) AS accepted_rows, coalesce(rejected_rows, 0) AS rejected_rows, coalesce(raw_rows, 0) // 10 AS windows FROM ak LEFT JOIN co USING (file, module_id)""",
)
def audit_of_days(s, d):
    """Counts of every file and module, modules without rows (8) included; every tenth row stands for a window."""
    rows = _flags(s, d).withColumn("file", F.floor(F.col("us") / 86_400_000_000).cast("string"))
    tenth = rows.groupBy("file", "module_id").agg(F.count("*").alias("n")).select("file", "module_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 10))).alias("i")).where("i > 0")
    return prepared.file_audit(rows, tenth, rows.select("file"), (1, 2, 3, 4, 5, 8)).select("file", "module_id", "raw_rows", "accepted_rows", "rejected_rows", "windows")


# Files that are due: orders stand for files, filled ones for what the registry knows; every third of these has changed since


@query(
    "S13_J08_L02_pending_files",
    """WITH f AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_custkey AS length, CAST(floor(o_totalprice) AS BIGINT) AS modified, o_orderstatus, o_orderkey FROM orders),
s AS (SELECT *, sha256(concat_ws('|', path, CAST(length AS VARCHAR), CAST(modified AS VARCHAR))) AS signature FROM f),
r AS (SELECT path, CASE WHEN o_orderkey % 3 = 0 THEN sha256('old') ELSE signature END AS signature FROM s WHERE o_orderstatus = 'F')
SELECT path, s.signature FROM s ANTI JOIN r USING (path, signature) ORDER BY path DESC LIMIT 500""",
)
def pending_files(s, d):
    o = table(s, d, "orders")
    files = serving.signature(o.select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").alias("length"), F.floor("o_totalprice").cast("long").alias("modified"), "o_orderstatus", "o_orderkey"))
    old = F.when(F.col("o_orderkey") % 3 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.col("signature"))
    registry = files.where("o_orderstatus = 'F'").select("path", old.alias("signature"))
    return serving.pending(files, registry, limit=500, newest=True).select("path", "signature")
