"""The numeric kernels against closed forms and plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import decode, ged, inference, linalg, spectral, stats

RNG = np.random.default_rng(3)


def reference(n):
    a = RNG.normal(size=(n, n))
    return linalg.shrink(a @ a.T)


def test_generalized_identities():
    r, x = reference(6), RNG.normal(size=(4, 6, 50))
    c = linalg.covariance(x)
    w, v = linalg.generalized(c, r)
    for k in range(4):
        assert np.allclose(v[k].T @ r @ v[k], np.eye(6)) and np.allclose(c[k] @ v[k], r @ v[k] * w[k])
    assert np.allclose(c[0], np.cov(x[0]))


def test_split_limits():
    r, x = reference(5), RNG.normal(size=(3, 5, 40))
    s = ged.spectrum(x, r)
    clean, noise = ged.split(x, s, r, np.inf)
    assert np.allclose(clean, x) and np.allclose(noise, 0)
    clean, noise = ged.split(x, s, r, 0.0)
    assert np.allclose(clean, 0) and np.allclose(noise, x)


def test_score_from_spectrum_equals_score_from_signals():
    r, x = reference(6), RNG.normal(size=(5, 6, 80))
    s = ged.spectrum(x, r)
    theta = float(np.median(s.values))
    clean, noise = ged.split(x, s, r, theta)
    pcs = linalg.top_components(r)
    want = 0.0
    for sign, part in ((1.0, clean), (-3.0, noise)):
        q = np.broadcast_to(pcs, (5, *pcs.shape))
        for _ in range(2):
            q = np.linalg.qr(linalg.covariance(part) @ q)[0]
        want += sign * 100 * linalg.subspace_similarity(q, np.broadcast_to(pcs, q.shape)).mean()
    assert ged.sensai(s, r, pcs, theta, 3.0) == pytest.approx(want, abs=1e-6)


def test_threshold_map():
    v = np.concatenate([RNG.uniform(0.1, 9, 200), [0.0]])
    want = math.exp(1.05 * np.percentile(np.log(v[:-1]) + 100, 98) - 100)
    assert ged.eigenvalue_threshold(0.0, v) == pytest.approx(want)


def test_clean_band_takes_out_a_strong_artifact():
    # the signal follows the reference's covariance, of a few strong sources; the artifact comes from elsewhere
    sources = np.linalg.qr(RNG.normal(size=(16, 16)))[0] * 2.0 ** -np.arange(16)
    r, pcs = ged.prepared_reference(sources @ sources.T)
    x = np.linalg.cholesky(r) @ RNG.normal(size=(16, 400))
    direction = RNG.normal(size=(16, 1))
    bad = x + 4 * direction * np.sin(np.arange(400) / 3)
    clean, noise, *_ = ged.clean_band(bad, r, pcs, 50, 3.0, -6.0, 12.0)
    assert np.allclose(clean + noise, bad)
    assert ((clean - x) ** 2).mean() < 0.2 * ((bad - x) ** 2).mean()
    moved, *_ = ged.clean_band(bad, r, pcs, 50, 3.0, -6.0, 12.0, window=4)
    assert moved.shape == x.shape and np.isfinite(moved).all()


def test_minimum_and_akima():
    assert linalg.bounded_minimum(lambda x: (x - 3.3) ** 2, 0, 10) == pytest.approx(3.3, abs=1e-2)
    x = np.arange(7.0)
    assert np.allclose(linalg.akima(x, 2 * x + 1, np.array([0.5, 3.25, 6])), [2, 7.5, 13])
    assert np.allclose(linalg.akima(x, x**2, x), x**2)
    assert np.allclose(linalg.akima(np.array([0.0, 0, 2]), np.array([1.0, 1, 3]), np.array([1.0])), [2])


def test_butterworth_passes_and_stops():
    s = spectral.butter_sections(8, 13, 250)
    f = np.array([2.0, 10.2, 40.0])
    z = np.exp(-2j * np.pi * f / 250)
    h = np.prod([(b0 + b1 * z + b2 * z**2) / (1 + a1 * z + a2 * z**2) for b0, b1, b2, _, a1, a2 in s], axis=0)
    assert abs(h[1]) == pytest.approx(1, abs=1e-3) and abs(h[0]) < 1e-2 and abs(h[2]) < 1e-2
    edges = np.exp(-2j * np.pi * np.array([8.0, 13.0]) / 250)
    h = np.prod([(b0 + b1 * edges + b2 * edges**2) / (1 + a1 * edges + a2 * edges**2) for b0, b1, b2, _, a1, a2 in s], axis=0)
    assert np.allclose(np.abs(h), 2**-0.5, atol=1e-6)


def test_zero_phase_keeps_a_tone_in_place():
    t = np.arange(1000) / 250
    x = np.sin(2 * np.pi * 10 * t) + np.sin(2 * np.pi * 50 * t)
    y = spectral.zero_phase(spectral.butter_sections(8, 13, 250), x[None])[0]
    assert np.corrcoef(y[200:800], np.sin(2 * np.pi * 10 * t)[200:800])[0, 1] > 0.999


def test_welch_finds_the_tone_and_the_power():
    t = np.arange(5000) / 250
    f, p = spectral.welch(3 * np.sin(2 * np.pi * 25 * t), 250)
    assert abs(f[p.argmax()] - 25) < 1 and p.sum() * (f[1] - f[0]) == pytest.approx(4.5, rel=0.02)


def test_ledoit_wolf_lies_between():
    x = RNG.normal(size=(12, 8)) * np.arange(1, 9)
    s, c = np.cov(x.T, ddof=0), decode.ledoit_wolf(x)
    assert np.trace(c) == pytest.approx(np.trace(s)) and np.linalg.cond(c) < np.linalg.cond(s)


@pytest.mark.parametrize("method", ["csp", "riemann"])
def test_decoders_tell_classes_apart(method):
    y = np.arange(80) % 2
    x = RNG.normal(size=(80, 4, 60))
    x[y == 1, 0] *= 3
    p = decode.predict(x[:60], y[:60], x[60:], method)
    assert (p == y[60:]).mean() > 0.9
    with pytest.raises(ValueError, match="unknown"):
        decode.predict(x, y, x, "nothing")


def test_conditions_equal_decoders_fitted_apart(spark):
    rows, want, fits = [], [], {"baseline": "raw", "corrupted": "raw", "gone": "raw", "reconstruct": "cleaned", "broken": "cleaned"}
    for unit, method in (("u", "csp"), ("w", "riemann")):
        for k in range(40):
            x = RNG.normal(size=(4, 30))
            x[k % 2] *= 2
            noisy = x + RNG.normal(size=x.shape)
            rows.append((unit, "raw", "baseline", method, k, k % 2, k < 24, x.ravel().tolist()))
            rows.append((unit, "cleaned", "reconstruct", method, k, k % 2, k < 24, (0.9 * noisy).ravel().tolist()))
            if k >= 24:
                rows.append((unit, "raw", "corrupted", method, k, k % 2, False, noisy.ravel().tolist()))
                rows.append((unit, "cleaned", "broken", method, k, k % 2, False, [None, *x.ravel().tolist()[1:]]))
    rows += [("few", "raw", "baseline", "csp", k, k % 2, k < 6, [1.0] * 120) for k in range(12)]
    df = spark.createDataFrame(rows, "unit string, fit string, condition string, method string, trial long, label int, train boolean, x array<double>")
    got = {(r["unit"], r["condition"]): r for r in decode.decode_conditions(df.where("train"), df.where("not train"), 4, fits).collect()}
    assert len(got) == 13
    for unit, method in (("u", "csp"), ("w", "riemann")):
        for c, base in (("baseline", "baseline"), ("corrupted", "baseline"), ("reconstruct", "reconstruct")):
            alone = df.where((F.col("unit") == unit) & (F.col("condition").isin(c, base)) & (F.col("train") | (F.col("condition") == c)))
            want = decode.decode(alone, 4, method).first()
            assert (got[unit, c]["n_train"], got[unit, c]["n_test"], got[unit, c]["error"]) == (24, 16, None)
            assert got[unit, c]["balanced_accuracy"] == pytest.approx(want["balanced_accuracy"]) and got[unit, c]["kappa"] == pytest.approx(want["kappa"])
        assert got[unit, "gone"]["error"] == "test: 0 trials" and "not finite" in got[unit, "broken"]["error"] and got[unit, "broken"]["kappa"] is None
    assert got["few", "baseline"]["error"].startswith("training") and got["few", "baseline"]["balanced_accuracy"] is None


def test_four_conditions_on_cleaned_trials(spark):
    from undula.plans import catalogue, numeric  # noqa: F401

    rows = catalogue.QUERIES["four_conditions"](spark, "/root/testdata/sf0.001").collect()
    recs = {r["rec"] for r in rows}
    assert len(rows) == 7 * len(recs) > 0 and all(r["n_train"] >= 8 for r in rows)
    mean = lambda c: np.mean([r["balanced_accuracy"] for r in rows if r["condition"] == c and r["balanced_accuracy"] is not None])
    assert mean("baseline") > mean("corrupted") and mean("baseline") > 0.6
    tests = {(r["rec"], r["enova_threshold"]): r["n_test"] for r in rows if r["condition"] == "reject_keep"}
    assert all(tests[r, 0.3] <= tests[r, 0.5] <= tests[r, 0.7] <= tests[r, 0.9] for r in recs) and len(set(tests.values())) > 1


def test_signed_rank_tail_by_enumeration():
    n, w = 6, 4
    sums = [sum(r for r in range(1, n + 1) if m >> (r - 1) & 1) for m in range(1 << n)]
    want = min(1, 2 * min(np.mean([s <= w for s in sums]), np.mean([s >= w for s in sums])))
    assert inference.wilcoxon_tail(w, n, 0) == pytest.approx(want)
    assert inference.wilcoxon_tail(600, 60, 0, exact_up_to=100) == pytest.approx(inference.wilcoxon_tail(600, 60, 0), abs=0.01)


def test_signed_rank_families_equal_enumeration(spark):
    """Tied, zero and null differences; tails over all sign patterns of the mid-ranks, corrections by hand."""
    rng, rows, want = np.random.default_rng(3), [], {}
    for k, n in enumerate([2, 3, 7, 12, 15]):
        for side in ("two-sided", "greater", "less"):
            d = [float(x) for x in rng.integers(-4, 6, n)]
            rows += [(f"f{k % 2}", f"{k}{side}", side, x) for x in [*d, None]]
            nz = [x for x in d if x]
            a = sorted(abs(x) for x in nz)
            rank = [a.index(abs(x)) + (a.count(abs(x)) + 1) / 2 for x in nz]
            w = sum(r for r, x in zip(rank, nz, strict=True) if x > 0)
            sums = (np.arange(1 << len(nz))[:, None] >> np.arange(len(nz)) & 1) @ np.array(rank)
            up, down = np.mean(sums >= w), np.mean(sums <= w)
            p = {"greater": up, "less": down, "two-sided": min(1, 2 * min(up, down))}[side] if len(nz) >= 3 else None
            want[f"{k}{side}"] = (n, len(nz), w, p)
    df = spark.createDataFrame(rows, "family string, t string, side string, d double")
    got = {r["t"]: r for r in stats.benjamini_hochberg(inference.signed_rank_test(df, ["family", "t"]), key="t", by=("family",)).collect()}
    assert set(got) == set(want) and any(p is None for *_, p in want.values())
    for t, (pairs, n, w, p) in want.items():
        assert (got[t]["n_pairs"], got[t]["n"], got[t]["w_plus"]) == (pairs, n, w)
        assert got[t]["p"] is None if p is None else got[t]["p"] == pytest.approx(p, abs=1e-12)
    for f in ("f0", "f1"):
        own = sorted(((got[t]["p"] if got[t]["p"] is not None else 1.0), t) for t in got if got[t]["family"] == f)
        for i, (p, t) in enumerate(own):
            assert got[t]["p_bonferroni"] == pytest.approx(min(1, p * len(own)))
            assert got[t]["p_bh"] == pytest.approx(min(1, min(q * len(own) / (j + 1) for j, (q, _) in enumerate(own) if j >= i)))
    normal = inference.signed_rank_test(df, ["family", "t"], exact_up_to=5)
    assert all(r["p"] is None or abs(r["p"] - want[r["t"]][3]) < 0.15 for r in normal.collect())


def test_families_of_a_small_sweep(spark):
    values = {0.1: [0.5, 0.6, 0.7, 0.8], 0.2: [0.9, 0.9, 0.9, 0.95], 0.3: [0.5, 0.6, 0.7, None]}
    rows = [("A" if s < 3 else "B", s, t, v, 0.4) for t, x in values.items() for s, v in enumerate(x)]
    d = stats.family_differences(spark.createDataFrame(rows, "dataset string, subject int, thr double, m double, o double"), "m", "o", 0.1)
    got = {(r["family"], r["dataset"], r["t1"], r["t2"]): (r["side"], r["n"]) for r in d.groupBy("family", "dataset", "t1", "t2", "side").agg(F.count("*").alias("n")).collect()}
    assert got == {
        ("pairs", None, 0.1, 0.2): ("two-sided", 4), ("pairs", None, 0.1, 0.3): ("two-sided", 3), ("pairs", None, 0.2, 0.3): ("two-sided", 3),
        ("over default", None, 0.1, 0.2): ("greater", 4), ("over default", None, 0.1, 0.3): ("greater", 3),
        ("best over default", "A", 0.1, 0.2): ("greater", 3), ("best over default", "B", 0.1, 0.2): ("greater", 1),
        ("over other", None, None, 0.1): ("greater", 4), ("over other", None, None, 0.2): ("greater", 4), ("over other", None, None, 0.3): ("greater", 3),
    }


def test_filters_in_blocks_equal_the_recursion():
    import time

    sections = spectral.butter_sections(1, 40, 250)
    for n in (1, 2, 63, 64, 65, 1000):
        x = RNG.normal(size=(3, n))
        want = x.copy()
        for b0, b1, b2, _, a1, a2 in sections:
            y = np.zeros_like(want)
            for t in range(n):
                past = lambda z, k: z[:, t - k] if t >= k else 0.0  # noqa: E731, B023
                y[:, t] = b0 * want[:, t] + b1 * past(want, 1) + b2 * past(want, 2) - a1 * past(y, 1) - a2 * past(y, 2)
            want = y
        assert np.allclose(spectral._run(sections, x), want, rtol=0, atol=1e-9 * np.abs(want).max())
    began = time.process_time()
    assert np.isfinite(spectral._run(sections, RNG.normal(size=(1, 1_000_000)))).all()
    assert time.process_time() - began < 10


def test_tails():
    assert inference.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert inference.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert inference.t_tail(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert inference.t_tail(0.0, 5) == pytest.approx(1)


def test_bootstrap_equals_numpy(spark):
    x = np.sort(RNG.normal(size=30))
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, v double")
    r = inference.bootstrap_ci(df, ["k"], "v", draws=200).first()
    means = x[np.random.default_rng(42).integers(0, 30, (200, 30))].mean(1)
    assert (r["lo"], r["hi"]) == (pytest.approx(np.percentile(means, 2.5)), pytest.approx(np.percentile(means, 97.5)))


def test_failed_unit_keeps_its_row(spark):
    df = spark.createDataFrame([("u", k, 0, k > 1, [0.0] * 8) for k in range(4)], "unit string, trial long, label int, train boolean, x array<double>")
    r = decode.decode(df, 2).first()
    assert r["balanced_accuracy"] is None and r["error"] == "too few trials"


def test_perm_test_runs_the_default_number_of_shuffles(spark, monkeypatch):
    from undula.plans import numeric

    seen, real = [], decode.cross_validate
    monkeypatch.setattr(decode, "cross_validate", lambda t, *a: seen.append(t.selectExpr("count(distinct split(unit, '#')[1])").first()[0]) or real(t, *a))
    numeric.perm_test(spark, "/root/testdata/sf0.001")
    assert seen == [101]


EVENTS = "event_id long, user_id long, event_type string, value double, ts timestamp_ntz"


@pytest.fixture(scope="module")
def events_dir(spark, tmp_path_factory):
    """Two users with five channels, one with a channel alone, and rows that lack a user, a type or a time."""
    import datetime

    start, rows = datetime.datetime(2024, 3, 1), []
    for user, kinds in ((1, "abcde"), (2, "abcde"), (3, "b")):
        for k in range(160 if user < 3 else 5):
            rows.append((len(rows), user, kinds[k % len(kinds)], float(RNG.normal(50, 20)), start + datetime.timedelta(hours=float(RNG.uniform(0, 239)))))
    rows += [(900, None, "a", 1.0, start), (901, 1, None, 1.0, start), (902, 1, "a", 1.0, None), (903, 2, "a", None, start)]
    path = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{path}/events.parquet")
    spark.createDataFrame([], EVENTS).write.parquet(f"{path}/none/events.parquet")
    return path, rows


def test_subject_recordings_equal_interpolation(spark, events_dir):
    import datetime

    from undula.sources import adapters

    path, rows = events_dir
    rec, names, size = adapters.subject_recordings(spark, path)
    got = {}
    for r in rec.collect():
        got.setdefault((r["rec"], r["ch"]), {})[r["i"]] = r["v"]
    whole = [r for r in rows if None not in (r[1], r[2], r[4])]
    assert names == list("abcde") and len(got) == 15 and all(len(v) == size for v in got.values())
    for (user, ch), values in got.items():
        bins = {}
        for _, u, kind, value, ts in whole:
            if str(u) == user and kind == ch and value is not None:
                bins.setdefault((ts - datetime.datetime(2024, 3, 1)) // datetime.timedelta(hours=3), []).append(value)
        at = [-1, *sorted(bins), size]
        want = np.interp(range(size), at, [0.0, *(np.mean(bins[k]) for k in sorted(bins)), 0.0])
        assert np.allclose([values[i] for i in range(size)], want)
    assert adapters.subject_recordings(spark, f"{path}/none")[0].count() == 0


def test_sweep_of_subjects(spark, events_dir):
    import __spark_entry__ as entry

    rows = entry.queries()["subject_sweep"](spark, events_dir[0]).collect()
    # user 3 has few events, which are felt in all electrodes
    done = [r for r in rows if r["error"] is None]
    assert {(r["subject"], r["enova_threshold"]) for r in done} == {(u, t) for u in "123" for t in (0.1, 0.3, 0.5, 0.7, 0.9)} and len(done) == len(rows)
    for r in done:
        assert r["pct_retained"] == pytest.approx(100 * (1 - r["n_1s_windows_rejected"] / r["n_1s_windows_total"]), abs=1e-5)
    for u in "123":
        cut = [r["n_1s_windows_rejected"] for r in sorted(done, key=lambda r: r["enova_threshold"]) if r["subject"] == u]
        assert cut == sorted(cut, reverse=True) and len({(r["rmse"], r["mean_enova"]) for r in done if r["subject"] == u}) == 1


def test_second_pass_is_by_recording(spark, events_dir):
    from undula.operators import signal
    from undula.plans import numeric

    rec, names, size, ref, matrix = numeric.subjects(spark, events_dir[0])
    first = ged.clean(rec.where("rec <> '3'"), matrix, 8, size)
    shares = {(r["rec"], r["ch"]): r["enova"] for r in signal.enova_per_channel(first, 8).collect()}
    limit = sorted(shares.values())[-2]
    worst = max(shares, key=shares.get)
    parts, bad = ged.two_pass(rec.where("rec <> '3'"), ref, 8, size, limit)
    assert [tuple(r) for r in bad.collect()] == [worst]
    left = {(r["rec"], r["ch"]) for r in parts.select("rec", "ch").distinct().collect()}
    assert left == set(shares) - {worst}
    # what is cleaned again is cleaned against the reference of the channels that are left
    keep = [k for k, c in enumerate(names) if c != worst[1]]
    alone = ged.clean(rec.where(f"rec = '{worst[0]}' and ch <> '{worst[1]}'"), matrix[np.ix_(keep, keep)], 8, size)
    want = {(r["ch"], r["i"]): r["clean"] for r in alone.collect()}
    got = {(r["ch"], r["i"]): r["clean"] for r in parts.where(f"rec = '{worst[0]}'").collect()}
    assert want.keys() == got.keys() and np.allclose([want[k] for k in want], [got[k] for k in want])
