"""Result tables in and out: typed CSV, partitioned Parquet with per-subject overwrite, one-row JSON."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SWEEP_SCHEMA = (
    "dataset string, subject string, enova_threshold double, trial_duration_sec double, ref_cov_source string, n_1s_windows_total long, "
    "n_1s_windows_rejected long, n_orig_epochs_kept long, pct_retained double, mean_enova double, sensai_score double, n_bad_channels int, "
    "n_flat_channels int, snr_improvement_db double, rmse double, correlation double, residual_power_ratio double, psd_similarity double, "
    "mu_band_correlation double, beta_band_correlation double, erd_correlation double, erd_preserved int, ba_baseline double, "
    "ba_corrupted_no_clean double, ba_reconstruct double, ba_reject_keep double, reconstruct_wins int, rejection_precision double, "
    "rejection_recall double, false_rejection_rate double, rejection_rate double, error string"
)


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """A sweep CSV with its header; NaN becomes null, so that it never sorts or compares as the largest number."""
    df = spark.read.schema(SWEEP_SCHEMA).csv(path, header=True, enforceSchema=False)
    return df.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def write_sweep(df: DataFrame, path: str) -> None:
    """Overwrites only the (dataset, subject) partitions that df has: a sweep can be resumed subject by subject."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "subject").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def union_results(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; what a frame lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, which all executors see; in a local folder on a local master that names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    shared = shared or f"file://{tempfile.mkdtemp(prefix='undula-')}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
