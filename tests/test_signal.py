"""Contracts and properties of the relational operators on small made-up recordings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.functions import itr
from undula.functions.scalars import csp_components, even_samples, noise_multiplier, significance, wavelet_level
from undula.operators import inject, quality, reject, signal, stats
from undula.sources import adapters, io


def recording(spark, x, names=None):
    names = names or [f"c{k}" for k in range(len(x))]
    return spark.createDataFrame([("r", names[c], t, float(v)) for c, row in enumerate(x) for t, v in enumerate(row)], "rec string, ch string, i long, v double")


def parts(spark, clean, noise):
    rows = [("r", f"c{c}", t, float(clean[c][t]), float(noise[c][t])) for c in range(len(clean)) for t in range(len(clean[0]))]
    return spark.createDataFrame(rows, "rec string, ch string, i long, clean double, noise double")


RNG = np.random.default_rng(1)


def test_enova_limits(spark):
    x, zero = RNG.normal(size=(4, 100)), np.zeros((4, 100))
    assert all(r["enova"] == 0 for r in signal.enova_per_epoch(parts(spark, x, zero), 25).collect())
    assert all(abs(r["enova"] - 1) < 1e-9 for r in signal.enova_per_epoch(parts(spark, zero, x), 25).collect())
    assert all(r["enova"] == 0 for r in signal.enova_per_epoch(parts(spark, zero, zero), 25).collect())


def test_enova_matches_numpy_and_drops_the_tail(spark):
    c, z = RNG.normal(size=(3, 110)) * 10, RNG.normal(size=(3, 110)) * 2
    got = {r["epoch"]: r["enova"] for r in signal.enova_per_epoch(parts(spark, c, z), 25).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for e, v in got.items():
        s = slice(25 * e, 25 * e + 25)
        assert v == pytest.approx(z[:, s].var() / (c + z)[:, s].var())


def test_recording_shorter_than_an_epoch_is_one_epoch(spark):
    c, z = RNG.normal(size=(2, 10)), RNG.normal(size=(2, 10))
    (r,) = signal.enova_per_epoch(parts(spark, c, z), 25).collect()
    assert r["enova"] == pytest.approx(z.var() / (c + z).var())


def test_noisy_channel_stands_out(spark):
    c, z = RNG.normal(size=(5, 200)), RNG.normal(size=(5, 200))
    z[0] *= 20
    got = {r["ch"]: r["enova"] for r in signal.enova_per_channel(parts(spark, c, z), 50).collect()}
    assert got["c0"] > max(v for k, v in got.items() if k != "c0")


def test_bands_add_up_and_shift_along(spark):
    x = RNG.normal(size=(1, 64))
    b = signal.haar_bands(recording(spark, x), 64, 4)
    total = {r["i"]: r["s"] for r in b.groupBy("i").agg(F.sum("v").alias("s")).collect()}
    assert all(abs(total[t] - x[0, t]) < 1e-12 for t in range(64))
    one = {(r["i"], r["band"]): r["v"] for r in b.collect()}
    two = {(r["i"], r["band"]): r["v"] for r in signal.haar_bands(recording(spark, np.roll(x, 5, axis=1)), 64, 4).collect()}
    assert all(abs(two[(t + 5) % 64, k] - v) < 1e-12 for (t, k), v in one.items())


def test_overlap_weights_are_one(spark):
    w = signal.overlap_add(recording(spark, RNG.normal(size=(1, 80))), 20, 80)
    assert all(abs(r["weight"] - 1) < 1e-12 for r in w.collect())


def test_padding_mirrors_the_tail(spark):
    got = {r["i"]: r["v"] for r in signal.mirror_pad(recording(spark, [[1, 2, 3, 4, 5]]), 4).collect()}
    assert [got[t] for t in range(8)] == [1, 2, 3, 4, 5, 5, 4, 3]
    assert signal.mirror_pad(recording(spark, [[1, 2, 3, 4]]), 4).count() == 4


@pytest.mark.parametrize(("thr", "kept"), [(1.0, 10), (0.0, 0), (0.9, 5)])
def test_rejection(spark, thr, kept):
    e = spark.createDataFrame([("r", k, 0.95 if k % 2 else 0.5) for k in range(10)], "rec string, epoch long, enova double")
    out = reject.reject_epochs(recording(spark, RNG.normal(size=(2, 100))), e, thr, 10).where("ch = 'c0'").orderBy("new_i").collect()
    assert len(out) == 10 * kept
    assert [r["new_i"] for r in out] == list(range(10 * kept))


def test_value_at_the_threshold_and_the_tail_stay(spark):
    e = spark.createDataFrame([("r", 0, 0.9), ("r", 1, 0.95)], "rec string, epoch long, enova double")
    out = reject.reject_epochs(recording(spark, [range(25)]), e, 0.9, 10).orderBy("i").collect()
    assert [r["i"] for r in out] == [*range(10), *range(20, 25)]
    assert [r["new_i"] for r in out] == list(range(15))


def test_taper_falls_before_a_cut_and_rises_after(spark):
    s = spark.createDataFrame([("r", t, int(not 10 <= t < 20)) for t in range(30)], "rec string, i long, keep int")
    f = {r["i"]: r["factor"] for r in reject.taper_factors(s, 4).collect()}
    assert f[5] == 1 and f[9] == 0 and f[6] == 1 and 0 < f[8] < f[7] < 1
    assert f[20] == 0 and f[23] == 1 and f[24] == 1


def test_flat_and_bad_channels(spark):
    x = RNG.normal(size=(3, 50))
    x[2] = 0
    flat = reject.flat_channels(recording(spark, x))
    e = spark.createDataFrame([("r", "c0", 0.3), ("r", "c1", 0.95), ("r", "c2", 0.1)], "rec string, ch string, enova double")
    got = {r["ch"]: (r["flat"], r["bad"], r["enova"]) for r in reject.bad_channels(e, flat, 0.9).collect()}
    assert got == {"c0": (False, False, 0.3), "c1": (False, True, 0.95), "c2": (True, True, math.inf)}


def test_names_match_exactly_first(spark):
    names = spark.createDataFrame([("fp1",), ("FC",), ("zz",)], "name string")
    template = spark.createDataFrame([(0, "FC3"), (1, "Fp1x"), (2, "FP1")], "idx int, label string")
    assert {r["name"]: r["idx"] for r in reject.match_names(names, template).collect()} == {"fp1": 2, "FC": 0}


def test_marker_end_is_included(spark):
    m = spark.createDataFrame([(5, 20), (95, 200)], "start_i long, end_i long")
    assert sorted(r["epoch"] for r in reject.marker_windows(m, 10, 10).collect()) == [0, 1, 2, 9]


def test_rejection_quality_without_anything(spark):
    none = spark.createDataFrame([], "epoch long")
    r = reject.rejection_quality(none, none, 5).first()
    assert (r["n_true_positives"], r["rejection_precision"], r["false_rejection_rate"]) == (0, 0, 0)


def triple(spark, ref, cor, cln):
    rows = [("r", f"c{c}", t, float(ref[c][t]), float(cor[c][t]), float(cln[c][t])) for c in range(len(ref)) for t in range(len(ref[0]))]
    return spark.createDataFrame(rows, "rec string, ch string, i long, ref double, cor double, cln double")


def test_perfect_cleaning_and_none(spark):
    ref = RNG.normal(size=(3, 100))
    cor = ref + 4 * RNG.normal(size=(3, 100))
    best, none = quality.removal(triple(spark, ref, cor, ref)).first(), quality.removal(triple(spark, ref, cor, cor)).first()
    assert best["snr_improvement_db"] > 0 and best["residual_power_ratio"] < 1e-9 and best["rmse"] == 0
    assert abs(none["snr_improvement_db"]) < 1e-6 and none["residual_power_ratio"] == pytest.approx(1)
    assert quality.removal(triple(spark, ref, ref, ref)).first()["snr_improvement_db"] is None
    assert quality.mean_correlation(triple(spark, ref, cor, ref)).first()["correlation"] == pytest.approx(1)


def test_constant_channels_have_no_correlation(spark):
    flat = np.ones((2, 20))
    assert quality.mean_correlation(triple(spark, flat, flat, flat)).first()["correlation"] == 0


@pytest.mark.parametrize("name", ["line", "drift", "pop", "blink", "saccade", "noise", "channel"])
def test_injection_leaves_the_input_and_repeats(spark, name):
    rec = adapters.with_index(recording(spark, np.zeros((3, 100)), ["Fp1", "Fz", "T7"]))
    f = {
        "line": lambda: inject.line_noise(rec, 50, 10.0), "drift": lambda: inject.drift(rec, 50), "pop": lambda: inject.electrode_pop(rec, [1], 25, 3, 50),
        "blink": lambda: inject.blink(rec, [1], 25, 3, 10), "saccade": lambda: inject.saccade(rec, [1], 25, 3, 9), "noise": lambda: inject.growing_noise(rec, 100, 5.0),
        "channel": lambda: inject.channel_noise(rec, ["Fz"], [1], 25),
    }[name]
    one, two = ({(r["ch"], r["i"]): r["artifact"] for r in f().collect()} for _ in range(2))
    assert one == two and any(one.values())
    if name in ("pop", "blink", "saccade", "channel"):
        assert all(v == 0 for (_, i), v in one.items() if not 25 <= i < 50)
    assert rec.where("v <> 0").count() == 0


def test_noise_is_normal_and_the_same_on_every_partitioning(spark):
    rec = adapters.with_index(recording(spark, np.zeros((4, 2000)), ["Fp1", "Fz", "T7", "Cz"]))
    noise = lambda df: {(r["ch"], r["i"]): r["artifact"] for r in inject.channel_noise(df, ["Fz", "Cz"], [0, 1], 1000).collect()}
    one = noise(rec)
    assert one == noise(rec.repartition(7, "i")) == noise(rec.orderBy(F.desc("i")).coalesce(1))
    assert {c for (c, _), v in one.items() if v} == {"Fz", "Cz"}
    for c in ("Fz", "Cz"):
        for e in (0, 1):
            x = np.array([one[c, i] for i in range(1000 * e, 1000 * e + 1000)])
            assert 18 < x.std() < 88 and abs(x.mean()) < 0.15 * x.std() and abs(np.mean(np.abs(x) < x.std()) - 0.683) < 0.06
    assert abs(np.corrcoef([one["Fz", i] for i in range(2000)], [one["Cz", i] for i in range(2000)])[0, 1]) < 0.1
    last = inject.channel_noise(rec.where("i <= 1000"), ["Fz"], [1], 1000)  # an epoch of one sample
    assert last.where("artifact <> 0").count() == 0


def test_wolpaw(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (0.2,), (0.8,), (float("nan"),), (None,)], "p double")
    got = [r[0] for r in df.select(itr.wolpaw_bits(F.col("p"), F.lit(2))).collect()]
    assert got[:3] == [0, 1, 0] and got[4:] == [0, 0]
    assert got[3] == pytest.approx(1 + 0.8 * math.log2(0.8) + 0.2 * math.log2(0.2))
    assert spark.range(1).select(itr.actions_per_letter(F.lit(0.0), F.lit(0.5))).first()[0] == math.inf
    assert spark.range(1).select(itr.bits_per_minute(F.lit(0.9), F.lit(0.0), F.lit(0.0), F.lit(2))).first()[0] == 0


def test_corrections(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    df = spark.createDataFrame([(str(k), v) for k, v in enumerate(p)], "key string, p double")
    got = {r["key"]: r for r in stats.benjamini_hochberg(df).collect()}
    assert [round(got[str(k)]["p_bh"], 9) for k in range(4)] == [0.04, round(0.04 * 4 / 3, 9), round(0.04 * 4 / 3, 9), 0.5]
    assert all(r["p_bh"] <= r["p_bonferroni"] + 1e-12 for r in got.values())


def test_scalars(spark):
    assert (even_samples(1.0, 250), even_samples(1.5, 2), wavelet_level(250, 0.5, 10_000), noise_multiplier("auto-"), noise_multiplier("?")) == (250, 4, 9, 6.0, 3.0)
    assert [r[0] for r in spark.createDataFrame([(5,), (22,), (60,)], "n int").select(csp_components(F.col("n"))).collect()] == [2, 6, 8]
    assert [r[0] for r in spark.createDataFrame([(0.0001,), (0.02,), (0.5,), (None,)], "p double").select(significance(F.col("p"))).collect()] == ["***", "*", "ns", None]
    with pytest.raises(ValueError, match="unknown dataset"):
        adapters.dataset_info(spark, "nobody")


def test_sweep_files(spark, tmp_path):
    one = spark.createDataFrame([("A", "1", 0.1, float("nan"))], "dataset string, subject string, enova_threshold double, ba_reject_keep double")
    two = spark.createDataFrame([("B", "2", 0.2, "failed")], "dataset string, subject string, enova_threshold double, error string")
    both = io.union_results(one, two)
    assert both.count() == 2 and len(both.columns) == 5
    io.write_sweep(both, str(tmp_path / "s"))
    io.write_sweep(one.withColumn("error", F.lit(None).cast("string")), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    cols = [c.split()[0] for c in io.SWEEP_SCHEMA.split(", ")]
    full = spark.range(1).select(*[F.lit("NaN" if c == "rmse" else None).cast("string").alias(c) for c in cols])
    io.write_csv(full, str(tmp_path / "c"))
    assert io.read_sweep(spark, str(tmp_path / "c")).first()["rmse"] is None
    assert '"dataset":"A"' in io.as_json(one).first()["json"]
