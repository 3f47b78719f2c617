"""What keeps the queries' memory and shuffles in step with their input: no samples in joins, none sent through the driver."""

import numpy as np
import pytest

from undula.operators import ged, linalg
from undula.plans import numeric

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ged_clean", "ged_full", "ged_channels", "sliding_vs_global", "sensai_curve", "sensai_final"])
def test_samples_are_never_joined(spark, name):
    # estimated by its files, a table of samples is small enough to be sent through the driver
    assert "Join" not in plan(getattr(numeric, name)(spark, SF))


def test_a_stack_is_cleaned_as_each_alone():
    rng = np.random.default_rng(4)
    r, pcs = ged.prepared_reference(np.cov(rng.normal(size=(5, 40))))
    x = rng.normal(size=(7, 5, 100)).cumsum(-1)
    for window in (None, 3):
        clean, noise, score, t, theta = ged.clean_stack(x, r, pcs, 12, 3.0, -6.0, 12.0, window)
        for k in range(7):
            one = ged.clean_band(x[k], r, pcs, 12, 3.0, -6.0, 12.0, window)
            assert np.array_equal(one[0], clean[k]) and np.array_equal(one[1], noise[k]) and one[2:] == (score[k], t[k], theta[k])


def test_scores_looked_up_equal_scores_made():
    rng = np.random.default_rng(5)
    r, pcs = ged.prepared_reference(np.cov(rng.normal(size=(8, 40))))
    s = ged.spectrum(rng.normal(size=(6, 8, 30)), r)
    scores, size = ged.epoch_scores(s, r, pcs, 3.0), np.abs(s.values)
    for theta in np.percentile(size, [0, 20, 50, 80, 100]):
        assert ged.mean_score(size[None], scores[None], np.array([theta]))[0] == pytest.approx(ged.sensai(s, r, pcs, theta, 3.0), abs=1e-6)
    seen = linalg.bounded_minima(lambda x: (x - np.array([3.3, 7.0])) ** 2, np.zeros(2), np.full(2, 10.0))
    assert list(seen) == [linalg.bounded_minimum(lambda x: (x - at) ** 2, 0, 10) for at in (3.3, 7.0)]


def test_permutations_need_no_join_and_deal_as_before(spark):
    import itertools

    from pyspark.sql import functions as F

    from undula.operators import decode

    trials = numeric.embedded_trials(spark, SF).where("unit in ('0', '1')")
    df = decode.permutation_test(trials, 8, permutations=4)
    assert "Join" not in plan(df) and "Window" not in plan(df)
    got = {r["unit"]: (r["observed"], r["p"]) for r in df.collect()}
    rows = trials.select("*", *[F.xxhash64("trial", F.lit(k), F.lit(7)).alias(f"h{k}") for k in range(1, 5)]).collect()
    for unit in "01":
        own = sorted((r for r in rows if r["unit"] == unit), key=lambda r: r["trial"])
        x = np.array([r["x"] for r in own]).reshape(len(own), 8, 8)
        means = []
        for k in range(5):
            y = np.array([r["label"] for r in (sorted(own, key=lambda r: (r[f"h{k}"], r["trial"])) if k else own)])
            fold = np.empty(len(own), int)
            for g, f in itertools.product((0, 1), (0,)):
                at = sorted(np.flatnonzero(y == g), key=lambda j: ((own[j]["trial"] * 7919 + 42) % 10007, own[j]["trial"]))
                fold[at] = np.arange(1, len(at) + 1) % 3
            means.append(np.mean([decode.balanced_accuracy_kappa(y[fold == f], decode.predict(x[fold != f], y[fold != f], x[fold == f], "csp"))[0] for f in range(3)]))
        assert got[unit] == pytest.approx((means[0], np.mean([m >= means[0] for m in means[1:]])))


def test_spectra_of_many_channels_equal_each(spark):
    from undula.operators import spectral

    rng = np.random.default_rng(6)
    x = {("a", "p"): rng.normal(size=40), ("a", "q"): rng.normal(size=40), ("b", "p"): rng.normal(size=9)}
    df = spark.createDataFrame([(*k, i, float(v)) for k, w in x.items() for i, v in enumerate(w)], "rec string, ch string, i long, v double")
    got = {}
    for r in spectral.psd(df, 8.0, 16).collect():
        got.setdefault((r["rec"], r["ch"]), {})[r["freq"]] = r["power"]
    for k, w in x.items():
        f, p = spectral.welch(w, 8.0, 16)
        assert np.allclose([got[k][v] for v in f], p) and len(got[k]) == len(f)
    assert "FlatMapGroupsInPandas" not in plan(spectral.psd(df, 8.0))


def test_a_mean_at_the_limit_is_the_same_in_any_order(spark, tmp_path):
    from pyspark.sql import functions as F

    from undula.sources import adapters

    # in doubles, fiftieths added up in another order differ in their last bits
    rows = [(k, 1, "A", float(q), 0.09, 0.0) for k, q in enumerate([1, 50, 7, 33, 46, 3, 29, 41, 13, 37, 50, 50, 49, 39])]
    seen = set()
    for turn in range(len(rows)):
        path = f"{tmp_path}/{turn}"
        df = spark.createDataFrame(rows[turn:] + rows[:turn], "k long, l_suppkey long, l_returnflag string, l_quantity double, l_discount double, l_tax double")
        df.coalesce(1).write.parquet(f"{path}/lineitem.parquet")
        seen.add(adapters.sweep(spark, path).select(F.col("ba_rej")).first()[0])
    assert seen == {448 / 14 / 50}


def test_splines_need_no_join_of_samples(spark):
    # the grid came by a join, and samples were paired with all weights
    assert "Join" not in plan(numeric.spline_interpolation(spark, SF))


@pytest.mark.parametrize("name", ["subject_sweep", "four_conditions"])
def test_sweeps_join_and_write_no_samples(spark, monkeypatch, name):
    # samples were joined with their artifacts, means, cleaned values and spectra, and written between
    kept = []
    monkeypatch.setattr(numeric, "written", lambda df: kept.append(df) or df)
    rows = getattr(numeric, name)(spark, SF)
    assert "Join" not in plan(rows) and not any({"i", "v", "x", "clean"} & set(df.columns) for df in kept)


def test_artifacts_and_measures_of_a_stack_equal_those_of_rows(spark):
    from pyspark.sql import functions as F

    from undula.operators import inject, quality, signal, spectral
    from undula.sources import adapters

    names, fs, size, rng = [c[0] for c in adapters.ELECTRODES], 8, 43, np.random.default_rng(8)
    order, recs = sorted(names), ["a", "b", "c"]
    x = rng.normal(size=(3, 8, size)).cumsum(-1)
    x[1, 2] = 0.7
    df = spark.createDataFrame([(r, c, i, float(x[k, j, i])) for k, r in enumerate(recs) for j, c in enumerate(order) for i in range(size)], "rec string, ch string, i long, v double")
    drawn = inject.drawn_epochs(df, size // fs, 0.6, fs, fs)
    at = (F.array_position(F.array(*[F.lit(c) for c in names]), F.col("ch")) - 1).cast("int")
    want = {(r["rec"], r["ch"], r["i"]): r["artifact"] for r in inject.inject_drawn(df.withColumn("ch_idx", at), drawn, fs, fs).collect()}
    held = sorted(inject.with_drawn(ged.packed(df), names, size // fs, 0.6).collect())
    assert {(r["rec"], e) for r in held for e in r["drawn"][0]} == {(r["rec"], r["epoch"]) for r in drawn.collect()}
    a = inject.drawn_stack(np.array([r["weights"] for r in held]), np.array([r["drawn"] for r in held]), size, fs, inject.shapes(spark, size, fs))
    assert {(r, c, i): a[k, j, i] for k, r in enumerate(recs) for j, c in enumerate(order) for i in range(size)} == want and np.count_nonzero(a)

    clean = x + rng.normal(size=x.shape)
    clean[2, 3], clean[1, 2] = -0.1, 0.7
    noise, cor = x + a - clean, x + a
    noise[1, 2] = 0
    long = spark.createDataFrame([(r, c, i, *(float(v[k, j, i]) for v in (x, cor, clean, clean, noise))) for k, r in enumerate(recs) for j, c in enumerate(order) for i in range(size)], "rec string, ch string, i long, ref double, cor double, cln double, clean double, noise double")
    by = lambda df, *keys: np.array([[np.nan if v is None else v for v in r[len(keys) :]] for r in sorted(df.collect(), key=lambda r: r[: len(keys)])], float)
    same = lambda got, want: np.allclose(got, want, rtol=1e-9, atol=1e-9, equal_nan=True)
    assert same(np.stack(quality.removal_stack(x, cor, clean), -1), by(quality.removal(long), "rec"))
    assert same(quality.mean_correlation_stack(x, clean), by(quality.mean_correlation(long), "rec")[:, 0])
    assert same(spectral.psd_similarity_stack(x, clean, fs, 0.5, 4), by(spectral.psd_similarity(long, fs, 0.5, 4), "rec")[:, 0])
    assert same(signal.enova_stack(clean, noise, fs).ravel(), by(signal.enova_per_epoch(long, fs, size), "rec", "epoch")[:, 0])
    assert same(signal.enova_channels_stack(clean, noise, fs).ravel(), by(signal.enova_per_channel(long, fs), "rec", "ch")[:, 0])
    assert quality.variance(np.full((2, 7), 0.1)).tolist() == [0, 0]


def test_conditions_of_a_recording_that_cannot_be_cleaned(spark):
    from undula.operators import decode
    from undula.plans import sweep
    from undula.sources import adapters

    names, fs, days, rng = sorted(c[0] for c in adapters.ELECTRODES), 8, 30, np.random.default_rng(9)
    rows, p = [], np.array([c[1:] for c in sorted(adapters.ELECTRODES)])
    for rec, method in (("a", "csp"), ("b", "riemann"), ("flat", "csp"), ("nan", "csp")):
        x, y = rng.normal(size=(8, days * fs + 3)), rng.integers(0, 2, days)
        x[0, : days * fs] *= np.repeat(1 + 3 * y, fs)
        x = np.repeat(x[:1], 8, 0) * np.array([[1, 1] + [0] * 6]).T if rec == "flat" else x
        fold = decode.dealt_folds(np.arange(days), y, 3)
        if rec == "nan":
            x[5, int(np.flatnonzero(fold == 0)[0]) * fs] = np.nan
        rows.append((rec, names, x.tolist(), None, y.tolist(), method))
    df = lambda rows: spark.createDataFrame(rows, "rec string, ch array<string>, x array<array<double>>, error string, labels array<int>, method string")
    run = lambda rows: sorted((tuple(r) for r in sweep.four_conditions(df(rows), names, days * fs + 3, np.exp(-((p[:, None] - p[None]) ** 2).sum(-1)), fs, [0.0, 0.9]).collect()), key=repr)
    got = run(rows)
    assert len(got) == 20 and [r for r in got if r[0] in "ab"] == run(rows[:2])
    by = {r[:3]: r[3:] for r in got}
    for rec, _, x, _, labels, method in rows[:2]:
        z, y = np.array(x)[:, : days * fs].reshape(8, days, fs).swapaxes(0, 1), np.array(labels)
        own = decode.dealt_folds(np.arange(days), y, 3) != 0
        assert by[rec, "baseline", None] == pytest.approx((own.sum(), (~own).sum(), *decode.balanced_accuracy_kappa(y[~own], decode.predict(z[own], y[own], z[~own], method)), None))
        assert by[rec, "reconstruct", None][1] == (~own).sum() and by[rec, "reject_keep", 0.0][1] < (~own).sum()
    assert by["nan", "baseline", None][2:] == (None, None, "test: values that are not finite")
    assert by["nan", "reconstruct", None][2:] == by["nan", "reject_keep", 0.9][2:] == (None, None, "input: 1 samples are not finite")
    assert by["flat", "reconstruct", None][4] == "input: signal in 2 of 8 channels, more than 3 needed"
