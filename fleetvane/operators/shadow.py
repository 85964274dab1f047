"""Calibration of a sequence model: scalers and thresholds of groups, fitted on a group's own windows, and which of them holds for a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvane.config import MonitorPolicy
from fleetvane.operators.profiles import Reconstructor, bucket_evidence, reconstruction_errors

#: Deviations below this count as 1, and no threshold is below it.
LEAST = 1e-8


def fit_scalers(windows: DataFrame, by: list[str]) -> DataFrame:
    """(by, scaler_mean, scaler_scale): each feature's mean and population deviation over all steps of a group's windows.

    Values are summed up where they lie; a row per group and feature meets in one task.
    """
    steps = windows.select(*by, F.explode("seq").alias("row"))
    cells = steps.select(*by, F.posexplode("row").alias("feature", "x")).withColumn("x", F.col("x").cast("double"))
    stats = cells.groupBy(*by, "feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("scale"))
    stats = stats.withColumn("scale", F.when(F.col("scale") < LEAST, 1.0).otherwise(F.col("scale")))
    listed = stats.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("feature", "mean", "scale"))).alias("r"))
    return listed.select(*by, F.col("r.mean").alias("scaler_mean"), F.col("r.scale").alias("scaler_scale"))


def scaled(windows: DataFrame) -> DataFrame:
    """windows, with scaler_mean and scaler_scale, whose seq is standardised to floats."""
    one = lambda x, i: ((x.cast("double") - F.col("scaler_mean")[i]) / F.col("scaler_scale")[i]).cast("float")
    return windows.withColumn("seq", F.transform("seq", lambda row: F.transform(row, one)))


def local_calibration(windows: DataFrame, model: Reconstructor, names: tuple[str, ...], by: list[str], order: list[str], least: int = 20, percentile: float = 0.99) -> DataFrame:
    """(by, scaler_mean, scaler_scale, threshold, training_windows, validation_windows) of the groups with `least` windows or more.

    By position, the first 70 % of a group's windows make the scaler, and the errors of the next 15 % the threshold.
    """
    group = Window.partitionBy(*by)
    placed = windows.withColumns({"_n": F.count("*").over(group), "_i": F.row_number().over(group.orderBy(*order))}).where(F.col("_n") >= least)
    train = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(0.70)))
    valid = F.greatest(train + 1, F.floor(F.col("_n") * F.lit(0.85)))
    placed = placed.withColumns({"training_windows": train, "_valid": valid})
    scalers = fit_scalers(placed.where("_i <= training_windows"), by)
    held = placed.where("_i > training_windows and _i <= _valid").join(scalers, by)
    errors = reconstruction_errors(scaled(held).select(*by, "training_windows", "seq"), model, names)
    limits = errors.groupBy(*by, "training_windows").agg(F.greatest(F.percentile("error", F.lit(percentile)), F.lit(LEAST)).alias("threshold"), F.count("*").alias("validation_windows"))
    return scalers.join(limits, by).select(*by, "scaler_mean", "scaler_scale", "threshold", "training_windows", "validation_windows")


def calibrated(rows: DataFrame, trained: DataFrame, local: DataFrame, by: list[str], columns: tuple[str, ...] = ("scaler_mean", "scaler_scale", "threshold")) -> DataFrame:
    """rows with the calibration that holds for their group and its calibration_source: the local one, else the trained one.

    Where there is neither, the columns are null and reason says so; no row is lost. trained and local have a row a group.
    """
    out = rows
    for side, name in ((local, "_local"), (trained, "_trained")):
        out = out.join(side.select(*by, F.struct(*columns).alias(name)), by, "left")
    is_local, is_trained = F.col("_local").isNotNull(), F.col("_trained").isNotNull()
    out = out.withColumns({c: F.when(is_local, F.col(f"_local.{c}")).otherwise(F.col(f"_trained.{c}")) for c in columns})
    source = F.when(is_local, "LOCAL_BOOTSTRAP").when(is_trained, "TRAINED_GROUP")
    return out.withColumns({"calibration_source": source, "reason": F.when(source.isNull(), "LSTM_SHADOW_GROUP_NOT_CONFIGURED")}).drop("_local", "_trained")


def shadow_evidence(windows: DataFrame, trained: DataFrame, local: DataFrame, model: Reconstructor, names: tuple[str, ...], by: list[str], bucket: Column, policy: MonitorPolicy = MonitorPolicy()) -> DataFrame:
    """(by, bucket, sequences, score, threshold, exceedance, active, reason, calibration_source) of every bucket of windows.

    Too few sequences are reported before a missing calibration is.
    """
    found = calibrated(windows.withColumn("bucket", bucket), trained, local, by)
    errors = reconstruction_errors(scaled(found.where("calibration_source is not null")).select(*by, "bucket", "threshold", "calibration_source", "seq"), model, names)
    scored = bucket_evidence(errors, [*by, "bucket", "threshold", "calibration_source"], F.col("threshold"), policy)
    few = F.when(F.col("sequences") < policy.least_sequences, "LSTM_SHADOW_INSUFFICIENT_SEQUENCES").otherwise(F.col("reason"))
    unknown = found.where("calibration_source is null").groupBy(*by, "bucket", "reason").agg(F.count("*").alias("sequences")).withColumns({"reason": few, "active": F.lit(False)})
    return scored.unionByName(unknown, allowMissingColumns=True)
