import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import ged, inject
from undula.plans import numeric, sweep
from undula.sources import adapters

SF = "/root/testdata/sf0.001"
SIZE, FS = 64, 8
NAMES = [c[0] for c in adapters.ELECTRODES]


def recording(rec: str, seed: int, size: int = SIZE, names=NAMES):
    x = np.random.default_rng(seed).normal(size=(len(names), size)).cumsum(1)
    return [(rec, c, i, float(x[k, i])) for k, c in enumerate(names) for i in range(size)]


def spoilt(rows, at, value):
    return [(r, c, i, value if (c, i) == at else v) for r, c, i, v in rows]


@pytest.fixture(scope="module")
def matrix():
    p = np.array([c[1:] for c in adapters.ELECTRODES])
    return np.exp(-((p[:, None] - p[None]) ** 2).sum(-1))


def swept(df, matrix, keep=numeric.written):
    return sweep.run_subjects(df, NAMES, SIZE, matrix, FS, [0.2, 0.6], keep)


def plain(rows) -> list[tuple]:
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def test_failures_are_rows_and_change_no_other(spark, matrix):
    good = recording("a", 1) + recording("b", 2)
    bad = spoilt(recording("nan", 3), ("C3", 9), math.nan) + spoilt(recording("inf", 4), ("O1", 63), math.inf) + spoilt(recording("null", 5), ("O1", 0), None)
    bad += [("flat", c, i, 1.0) for c in NAMES for i in range(SIZE)] + [r for r in recording("short", 6) if r[2] < 40]
    # a channel that the reference doesn't have is found by the kernel's first stage alone
    bad += [(r, "Cz" if c == "C3" else c, i, v) for r, c, i, v in recording("strange", 7)]
    schema = "rec string, ch string, i long, v double"
    rows = swept(spark.createDataFrame(good + bad, schema), matrix).collect()
    reasons = {r["rec"]: r["error"] for r in rows if r["error"]}
    assert reasons.pop("strange").startswith("broadband: ")
    assert reasons == {
        "nan": "input: 1 samples are not finite", "inf": "input: 1 samples are not finite", "null": "input: 1 samples are not finite",
        "flat": "input: signal in 0 of 8 channels, more than 3 needed", "short": "input: a channel has 40 of 64 samples",
    }
    assert all(r[k] is None for r in rows if r["error"] for k in ("rmse", "mean_enova", "enova_threshold", "n_true_positives"))
    alone = swept(spark.createDataFrame(good, schema), matrix).collect()
    assert plain(r for r in rows if not r["error"]) == plain(alone) and len(alone) == 4


def test_clean_names_the_recording_that_fails(spark, matrix):
    df = spark.createDataFrame(spoilt(recording("nan", 3), ("C3", 9), math.nan), "rec string, ch string, i long, v double")
    with pytest.raises(Exception, match="nan: input: 1 samples are not finite"):
        ged.clean(df, matrix, FS, SIZE).collect()


def test_an_artifact_gets_smaller_in_every_subject(spark):
    rows = numeric.subject_sweep(spark, SF).collect()
    assert rows and not any(r["error"] for r in rows)
    assert min(r["snr_improvement_db"] for r in rows) > 0 and max(r["residual_power_ratio"] for r in rows) < 1
    assert np.mean([r["snr_improvement_db"] for r in rows]) > 3
    for k in ("n_true_positives", "n_false_positives", "n_missed"):
        assert sum(r[k] for r in rows) > 0
    assert all(r["n_true_positives"] + r["n_missed"] == r["n_corrupted_windows"] for r in rows)


def test_sensors_have_the_mixture_as_their_covariance(spark, matrix):
    rec, size = adapters.mixed_recordings(spark, SF, np.linalg.cholesky(matrix + 1e-6 * np.eye(8)).tolist())
    x = {(r["rec"], r["ch"], r["i"]): r["v"] for r in rec.collect()}
    recs = sorted({k[0] for k in x})
    wide = np.concatenate([[[x[r, c, i] for i in range(size)] for c in NAMES] for r in recs], axis=1)
    assert len(x) == len(recs) * 8 * size
    off = ~np.eye(8, dtype=bool)
    assert np.corrcoef(np.corrcoef(wide)[off], matrix[off])[0, 1] > 0.9
    again = {(r["rec"], r["ch"], r["i"]): r["v"] for r in adapters.mixed_recordings(spark, SF, np.linalg.cholesky(matrix + 1e-6 * np.eye(8)).tolist())[0].repartition(3).collect()}
    assert again == x


def test_drawn_epochs_are_exact_and_repeatable(spark):
    recs = spark.createDataFrame([(str(k),) for k in range(40)] * 3, "rec string")
    drawn = inject.drawn_epochs(recs, 21, 0.3, 8, 8.0)
    rows = drawn.collect()
    assert drawn.groupBy("rec").agg(F.count("*").alias("n"), F.count_distinct("epoch").alias("d")).where("n <> 7 or d <> 7").count() == 0 and len(rows) == 280
    assert {r["artifact_type"] for r in rows} == set(inject.DRAWN) and all(r["amplitude_uv"] == inject.DRAWN[r["artifact_type"]] for r in rows)
    assert all(r["end_sample"] - r["start_sample"] == 7 and r["start_sample"] == 8 * r["epoch"] for r in rows)
    assert sorted(rows) == sorted(inject.drawn_epochs(recs.repartition(5), 21, 0.3, 8, 8.0).collect())
    # no epoch is drawn more often than chance lets it
    assert drawn.groupBy("epoch").count().agg(F.max("count")).first()[0] < 28


def test_deviates_are_normal_and_of_their_key(spark):
    x = spark.range(20_000).select(adapters.normal(3, F.col("id"), F.lit("Fz")).alias("x"), adapters.normal(4, F.col("id"), F.lit("Fz")).alias("y"))
    m = x.agg(F.avg("x"), F.stddev_pop("x"), F.kurtosis("x"), F.corr("x", "y")).first()
    assert abs(m[0]) < 0.03 and abs(m[1] - 1) < 0.03 and abs(m[2]) < 0.15 and abs(m[3]) < 0.03
    assert x.repartition(7).agg(F.sum(F.round("x", 9))).first()[0] == pytest.approx(x.agg(F.sum(F.round("x", 9))).first()[0])


def test_a_stopped_sweep_is_finished_and_equals_one_run(spark, matrix, tmp_path):
    people = [str(k) for k in range(6)]
    df = spark.createDataFrame([r for k in people for r in recording(k, int(k))] + spoilt(recording("nan", 3), ("C3", 9), math.nan), "rec string, ch string, i long, v double")
    requested = spark.createDataFrame([(k,) for k in [*people[:5], "nan", "nobody"]], "rec string")
    runs = []

    def run(recs):
        runs.append({r["rec"] for r in recs.select("rec").distinct().collect()})
        return swept(recs, matrix).withColumn("dataset", F.lit("d")).withColumnRenamed("rec", "subject")

    one = sweep.resumed(spark, f"file://{tmp_path}/one", requested, df, run).collect()
    assert runs == [{*people[:5], "nan"}]
    runs.clear()
    path = f"file://{tmp_path}/two"
    sweep.resumed(spark, path, requested, df, run, batches=3, most_batches=1)
    first = set().union(*runs)
    assert 0 < len(first) < 6
    two = sweep.resumed(spark, path, requested, df, run, batches=3).collect()
    assert sum(map(len, runs)) == len(set().union(*runs)) == 6
    assert plain(two_ := [r.asDict().values() for r in two]) == plain(r.asDict().values() for r in one) and len(two_) == 11
    sweep.resumed(spark, path, requested, df, run, batches=3)
    assert sum(map(len, runs)) == 6
