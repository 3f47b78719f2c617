"""Choosing references, interpolating channels, sweeping thresholds, moving thresholds, the grid of hours."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import ged, linalg, montage
from undula.plans import sweep
from undula.sources import adapters

RNG = np.random.default_rng(5)


def positions(spark, n=6):
    rows = [(f"c{k}", k, math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n), 0.0) for k in range(n)]
    return spark.createDataFrame(rows, "ch string, ch_idx int, x double, y double, z double")


def test_reference_choices(spark):
    names = [f"c{k}" for k in range(6)]
    own = np.eye(6)
    assert montage.reference_covariance(own, names) is own
    with pytest.raises(ValueError, match="shape"):
        montage.reference_covariance(np.eye(5), names)
    with pytest.raises(ValueError, match="unknown"):
        montage.reference_covariance("warped", names)
    with pytest.raises(ValueError, match="positions are needed"):
        montage.reference_covariance("precomputed", names)
    rbf = montage.reference_covariance("channel_positions", names, positions(spark))
    assert np.allclose(rbf, rbf.T) and np.linalg.eigvalsh(rbf).min() > 0
    assert np.allclose(montage.reference_covariance("precomputed", names, positions(spark)), rbf)
    g = RNG.normal(size=(6, 6))
    matrix = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(6) for j in range(6)], "i int, j int, g double")
    template = spark.createDataFrame([(k, f"C{k}") for k in range(6)], "idx int, label string")
    assert np.allclose(montage.reference_covariance("precomputed", names[::-1], matrix=matrix, template=template), g[::-1, ::-1])
    placed = positions(spark).select(F.col("ch_idx").alias("idx"), F.col("ch").alias("label"), "x", "y", "z")
    assert np.allclose(montage.reference_covariance("interpolated", names, positions(spark), matrix, placed), g, atol=1e-6)
    with pytest.raises(ValueError, match="no template channel for zz"):
        montage.gather(matrix, template, spark.createDataFrame([("zz",)], "name string"))


def test_interpolated_channel_lies_between_its_neighbours(spark):
    x = spark.createDataFrame([("r", f"c{k}", t, float(k if k != 2 else 99)) for k in range(6) for t in range(3)], "rec string, ch string, i long, v double")
    bad = spark.createDataFrame([("c2",)], "ch string")
    got = {(r["ch"], r["i"]): r["v"] for r in montage.interpolate_channels(x, positions(spark), bad, nearest=2).collect()}
    assert len(got) == 18 and all(got["c2", t] == pytest.approx(2) for t in range(3)) and got["c5", 0] == 5


def test_splines_keep_constants_and_come_nearer_to_smooth_fields(spark):
    p = RNG.normal(size=(40, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    w = montage.spline_matrix(p[30:], 7 * p[:30])
    assert np.allclose(w.sum(1), 1, atol=1e-9)
    assert np.allclose(montage.spline_matrix(p[:30], p[:30], smoothing=0.0), np.eye(30), atol=1e-6)
    rows = [(f"c{k}", *map(float, x)) for k, x in enumerate(p)]
    places = spark.createDataFrame(rows, "ch string, x double, y double, z double")
    bad = spark.createDataFrame([(f"c{k}",) for k in range(30, 40)], "ch string")
    field = [p[:, 0] * p[:, 1] + p[:, 2], np.full(40, 3.0)]
    rec = spark.createDataFrame([("r", f"c{k}", t, float(field[t][k])) for k in range(40) for t in range(2)], "rec string, ch string, i long, v double")
    errors = {}
    for spline in (True, False):
        got = {(r["ch"], r["i"]): r["v"] for r in montage.interpolate_channels(rec, places, bad, spline=spline).collect()}
        assert len(got) == 80 and all(got[f"c{k}", 1] == pytest.approx(3) for k in range(30, 40))
        errors[spline] = np.mean([(got[f"c{k}", 0] - field[0][k]) ** 2 for k in range(30, 40)])
    assert errors[True] < errors[False] / 2
    assert montage.spline_weights(places.limit(0), places).count() == 0
    with pytest.raises(ValueError, match="without a place"):
        montage.spline_weights(places, spark.createDataFrame([("x", 0.0, 0.0, None)], places.schema))


def test_sweep_counts(spark):
    e = spark.createDataFrame([("r", k, v) for k, v in enumerate([0.1, 0.6, 0.9, 0.95])], "rec string, epoch long, enova double")
    truth = spark.createDataFrame([(2,), (1,)], "epoch long")
    got = {r["enova_threshold"]: r for r in sweep.apply_thresholds(e, [0.5, 0.9, 1.0], truth).collect()}
    assert [got[t]["n_1s_windows_rejected"] for t in (0.5, 0.9, 1.0)] == [3, 1, 0]
    assert (got[0.5]["n_true_positives"], got[0.5]["n_false_positives"], got[0.5]["n_missed"]) == (2, 1, 0)
    assert got[0.9]["false_rejection_rate"] == 0.5 and got[1.0]["rejection_precision"] == 0
    retained = [got[t]["pct_retained"] for t in (0.5, 0.9, 1.0)]
    assert retained == sorted(retained)
    assert sweep.apply_thresholds(e, [0.5]).first()["n_true_positives"] == 0


def test_artifact_benchmark_has_a_row_each(spark):
    rec = adapters.with_index(spark.createDataFrame([("r", c, t, float(v)) for c in ("Fp1", "O2") for t, v in enumerate(RNG.normal(size=48))], "rec string, ch string, i long, v double"))
    rows = sweep.artifact_benchmark(rec, sweep.deterministic_injectors(24, [0, 1], 24), 48).collect()
    assert {r["artifact_type"] for r in rows} == {"line_noise", "drift", "electrode_pop", "blink", "saccade"}
    assert all(r["rmse"] > 0 for r in rows)


def plain_step(y):
    smooth = [sum(y[j] for j in range(i - 3, i + 3) if 0 <= j < len(y)) / 6 for i in range(len(y))]
    g = np.diff(smooth)
    n = len(g)
    return 1 + max(range(2, n - 1), key=lambda k: (abs(g[:k].mean() - g[k:].mean()) * math.sqrt(k * (n - k) / n), -k))


def test_change_of_slope(spark):
    from undula.operators import signal

    for x in (np.concatenate([np.zeros(20), np.arange(1, 21.0)]), RNG.normal(size=30)):
        df = spark.createDataFrame([("r", t, float(v)) for t, v in enumerate(x)], "rec string, t int, v double")
        assert signal.changepoint(df, ["rec"], "t", "v").first()["split"] == plain_step(x)


def test_epoch_similarity_of_the_reference_itself():
    r, pcs = ged.prepared_reference(np.diag([9.0, 4, 3, 0.1, 0.1]))
    x = np.diag([3, 2, 1.7, 0.1, 0.1]) @ np.linalg.qr(RNG.normal(size=(60, 5)))[0].T
    assert 0 <= ged.epoch_similarity(x, pcs) <= 1
    assert linalg.subspace_similarity(pcs, pcs) == pytest.approx(1)


def test_moving_thresholds_stay_near_the_windows_own():
    r, pcs = ged.prepared_reference(np.diag([9.0, 4, 3, 0.1, 0.1]))
    s = ged.spectrum(np.random.default_rng(8).normal(size=(20, 5, 40)), r)
    own = [ged.search(ged.Spectrum(s.values[a : a + 4], s.vectors[a : a + 4]), r, pcs, 3.0, 0.0, 12.0)[1] for a in range(0, 17, 2)]
    got = ged.window_thresholds(s, r, pcs, 3.0, 0.0, 12.0, 4)
    assert got.shape == (20,) and (got > 0).all()
    # knots are on epochs 2, 4, ..., 18: there the curve is the three-point mean
    mean = [(x + y + z) / 3 for x, y, z in zip([0, *own], own, [*own[1:], 0])]
    assert got[2:19:2] == pytest.approx(mean)


def test_an_event_outside_the_grid_is_an_error(spark, tmp_path):
    at = "timestamp_ntz'{}' as ts"
    for day, fails in (("2024-01-30 23:59:59", False), ("2023-12-31 23:30:00", True), ("2024-01-31 00:00:00", True)):
        folder = tmp_path / day[:10]
        spark.sql(f"select 'view' as event_type, 1.5D as value, {at.format(day)} union all select 'view', 2D, null").write.parquet(f"{folder}/events.parquet")
        rec = adapters.events_recording(spark, str(folder))
        if fails:
            with pytest.raises(Exception, match="outside the 720 hours"):
                rec.collect()
        else:
            assert sum(r["v"] for r in rec.collect()) == 1.5
