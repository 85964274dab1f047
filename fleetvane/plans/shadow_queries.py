"""Queries of local calibration, runtime status and what else the catalog's first parts leave open."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetvane.config import AdaptivePolicy
from fleetvane.functions import scalar as S
from fleetvane.operators import adaptive, profiles, robust, sequences, serving, shadow
from fleetvane.plans.catalog import MODE_SQL, RECON, SEQ, _r, _slides, _tel, query
from fleetvane.shared import written
from fleetvane.sources.telemetry import SQL as TEL
from fleetvane.sources.telemetry import table

_N = len(sequences.MODEL_FEATURES)
_BY = ["machine_id"]
#: Of the synthetic telemetry few machines have twenty windows.
_LEAST = 15
_CALIBRATION = f"""
pl0 AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY start_s, module_id) AS i, count(*) OVER (PARTITION BY machine_id) AS n FROM sli),
pl AS (SELECT *, greatest(1, CAST(floor(n * 0.70::DOUBLE) AS BIGINT)) AS train, greatest(greatest(1, CAST(floor(n * 0.70::DOUBLE) AS BIGINT)) + 1, CAST(floor(n * 0.85::DOUBLE) AS BIGINT)) AS valid FROM pl0 WHERE n >= {_LEAST}),
st AS (SELECT p.machine_id, p.i, p.train, p.valid, p.module_id, p.start_s, f.s, [{', '.join(f'CAST({c} AS FLOAT)::DOUBLE' for c in sequences.MODEL_FEATURES)}] AS v FROM pl p JOIN fea f ON f.machine_id = p.machine_id AND f.module_id = p.module_id AND f.segment_id = p.segment_id AND f.s BETWEEN p.start_s AND p.end_s),
ce AS (SELECT machine_id, i, train, valid, s, unnest(v) AS x, unnest(range({_N})) AS feature FROM st),
sc AS (SELECT machine_id, feature, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END AS sd FROM ce WHERE i <= train GROUP BY 1, 2),
er AS (SELECT machine_id, i, train, 0.05::DOUBLE * avg(abs(CAST((x - m) / sd AS FLOAT)::DOUBLE)) AS error FROM ce JOIN sc USING (machine_id, feature) WHERE i > train AND i <= valid GROUP BY 1, 2, 3)"""


@query("M19_W12_local_calibration",
    f"{SEQ}, {_CALIBRATION} SELECT machine_id, train AS training_windows, count(*) AS validation_windows, "
    f"round(greatest(quantile_cont(error, 0.99), 1e-8::DOUBLE), 4) AS threshold FROM er GROUP BY 1, 2",
)
def calibration(s, d):
    out = shadow.local_calibration(_slides(s, d), profiles.Scaled(0.95), sequences.MODEL_FEATURES, _BY, ["start_s", "module_id"], least=_LEAST)
    return _r(out.select(*_BY, "training_windows", "validation_windows", "threshold"), "threshold", places=4)


@query("M02_scaler_transform",
    f"{SEQ}, {_CALIBRATION} SELECT machine_id, module_id, start_s, CAST(feature AS INTEGER) AS feature, "
    f"round(avg(CAST((x - m) / sd AS FLOAT)::DOUBLE), 3) + 0.0::DOUBLE AS mean_z "
    f"FROM (SELECT machine_id, module_id, start_s, unnest(v) AS x, unnest(range({_N})) AS feature FROM st) c "
    f"JOIN (SELECT machine_id, feature, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END AS sd FROM ce "
    f"GROUP BY 1, 2) q USING (machine_id, feature) GROUP BY 1, 2, 3, 4",
)
def transformed(s, d):
    w = _slides(s, d)
    whole = shadow.scaled(w.join(shadow.fit_scalers(w, _BY), _BY))
    means = whole.select("machine_id", "module_id", "start_s", F.explode("seq").alias("row")).select("machine_id", "module_id", "start_s", F.posexplode("row").alias("feature", "z"))
    return _r(means.groupBy("machine_id", "module_id", "start_s", "feature").agg(F.avg(F.col("z").cast("double")).alias("mean_z")), "mean_z", places=3)


@query("J05_calibration_source",
    f"{SEQ}, {RECON}, t AS (SELECT machine_id, quantile_cont(error, 0.99) AS threshold FROM rec "
    f"WHERE machine_id <> 'MX002' GROUP BY 1), l AS (SELECT machine_id, quantile_cont(error, 0.95) AS threshold FROM rec "
    f"WHERE machine_id = 'MX000' GROUP BY 1) SELECT r.machine_id, r.module_id, r.start_s, "
    f"round(coalesce(l.threshold, t.threshold), 4) AS threshold, "
    f"CASE WHEN l.machine_id IS NOT NULL THEN 'LOCAL_BOOTSTRAP' WHEN t.machine_id IS NOT NULL THEN 'TRAINED_GROUP' END AS calibration_source, "
    f"CASE WHEN l.machine_id IS NULL AND t.machine_id IS NULL THEN 'LSTM_SHADOW_GROUP_NOT_CONFIGURED' END AS reason FROM rec r LEFT "
    f"JOIN l USING (machine_id) LEFT JOIN t USING (machine_id)",
)
def sources(s, d):
    e = profiles.reconstruction_errors(_slides(s, d), profiles.Scaled(0.95), sequences.MODEL_FEATURES).select("machine_id", "module_id", "start_s", "error")
    e = written(e, "errors")  # thresholds take several passes over them
    trained, local = robust.group_thresholds(e.where("machine_id <> 'MX002'"), _BY), robust.group_thresholds(e.where("machine_id = 'MX000'"), _BY, 0.95)
    out = shadow.calibrated(e, trained, local, _BY, ("threshold",))
    return _r(out.select("machine_id", "module_id", "start_s", "threshold", "calibration_source", "reason"), "threshold", places=4)


_BUFFER = (
    "SELECT c_nationkey AS g, count(*) AS total_seen, least(count(*), 100) AS buffer_windows FROM orders "
    "JOIN customer ON o_custkey = c_custkey GROUP BY 1"
)


@query("A23_runtime_status",
    f"WITH b AS ({_BUFFER}), k AS (SELECT c_nationkey AS g, max(c_custkey) AS candidate_version FROM customer WHERE c_acctbal < 0 "
    f"GROUP BY 1) SELECT n_nationkey AS g, n_name AS champion_version, candidate_version, "
    f"coalesce(buffer_windows, 0) AS buffer_windows, coalesce(total_seen, 0) AS total_seen FROM nation LEFT "
    f"JOIN k ON k.g = n_nationkey LEFT JOIN b ON b.g = n_nationkey",
)
def status(s, d):
    champions = table(s, d, "nation").select(F.col("n_nationkey").alias("g"), F.col("n_name").alias("champion_version"))
    customers = table(s, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("g"))
    candidates = customers.where("c_acctbal < 0").groupBy("g").agg(F.max("c_custkey").alias("candidate_version"))
    seen = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(customers.select("c_custkey", "g"), "c_custkey")
    return serving.runtime_status(champions, candidates, adaptive.bounded_buffer(seen.select("g", "o_orderkey"), ["g"], "o_orderkey", AdaptivePolicy(buffer=100)), ["g"])


@query("L08_rollback_target", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS version FROM orders GROUP BY 1")
def rollback(s, d):
    history = table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("saved_at"))
    return adaptive.rollback_target(history, ["o_custkey"]).select("o_custkey", "version")


@query("P18_coverage_tone",
    f"WITH {TEL} SELECT source_order, round(valve * 100, 6) AS coverage_percent, "
    f"CASE WHEN m IN ('P1_REVIEW', 'REJECTED') THEN 'danger' WHEN m IN ('P2_REVIEW', 'APPROVAL_REQUIRED') THEN 'warning' WHEN m IN ('NORMAL', 'ACTIVE') THEN 'success' WHEN m IN ('SHADOW', 'SHADOW_VALIDATION') THEN 'info' ELSE 'neutral' END AS tone "
    f"FROM (SELECT *, "
    f"CASE CAST(source_order AS BIGINT) % 6 WHEN 0 THEN 'P1_REVIEW' WHEN 1 THEN 'P2_REVIEW' WHEN 2 THEN 'NORMAL' WHEN 3 THEN 'SHADOW' WHEN 4 THEN 'ACTIVE' ELSE {MODE_SQL} END AS m "
    f"FROM tel)",
)
def tones(s, d):
    t, k = _tel(s, d), F.col("source_order").cast("long") % 6
    level = F.when(k == 0, "P1_REVIEW").when(k == 1, "P2_REVIEW").when(k == 2, "NORMAL").when(k == 3, "SHADOW").when(k == 4, "ACTIVE").otherwise(S.operating_mode(F.col("sv"), F.col("valve")))
    return _r(t.select("source_order", S.coverage_percent(F.col("valve")).alias("coverage_percent"), S.tone(level).alias("tone")), "coverage_percent")
