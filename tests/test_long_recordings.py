"""Thresholds of recordings of more than 500 epochs come from all of them."""

import numpy as np
import pytest

from undula.functions.scalars import noise_multiplier
from undula.operators import ged, linalg, signal
from undula.plans import numeric

FS, SIZE, NAMES, RECS = numeric.FS_SUBJECT, 30_000, list("abcde"), list("pqr")


@pytest.fixture(scope="module")
def recordings(spark):
    """Recordings as the reference expects, with artifacts of every strength in some of their epochs, and the reference."""
    matrix = numeric.montage_of(spark, NAMES)[1]
    rng = np.random.default_rng(12)
    x = np.linalg.cholesky(matrix + 1e-6 * np.eye(5)) @ rng.normal(size=(len(RECS), 5, SIZE))
    strength = np.repeat((rng.random((len(RECS), SIZE // 16)) < 0.1) * rng.lognormal(1, 1, (len(RECS), SIZE // 16)), 16, axis=-1)
    return x + rng.normal(size=x.shape) * strength[:, None], matrix


@pytest.fixture(autouse=True)
def recorded(spark, recordings, monkeypatch):
    x, matrix = recordings
    rows = spark.createDataFrame([(r, NAMES, v.tolist(), None) for r, v in zip(RECS, x, strict=True)], "rec string, ch array<string>, x array<array<double>>, error string")
    monkeypatch.setattr(numeric, "subject_rows", lambda *_: (rows, NAMES, SIZE, matrix))
    # here only: the queries' tasks search as they do
    monkeypatch.setattr(ged, "searched", over_all)


def over_all(values, scores, lo, hi):
    """searched(), a recording and an epoch at a time."""
    out = []
    for v, s in zip(np.abs(values), scores, strict=True):
        level = np.percentile(np.log(v[v > 0]) + 100, 98)
        theta = lambda t: np.exp((105 - t) / 100 * level - 100)  # noqa: B023, E731
        score = lambda t: np.mean([own[(size >= theta(t)).sum()] for size, own in zip(v, s, strict=True)])  # noqa: B023, E731
        t = linalg.bounded_minimum(lambda x: -score(x), float(lo), float(hi))  # noqa: B023
        out.append((t, theta(t)))
    return tuple(np.array(x) for x in zip(*out, strict=True))


def by(rows, *keys) -> dict:
    return {tuple(r[k] for k in keys): tuple(v for k, v in r.asDict().items() if k not in keys) for r in rows}


def same(got: dict, want: dict) -> bool:
    return got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_ged_clean(spark, recordings):
    x, (ref, pcs), want = recordings[0], ged.prepared_reference(recordings[1]), {}
    plan = ged.band_plan(FS, SIZE, 0.5)
    assert SIZE // plan[0]["n"] > 600
    for p, v in zip(plan, signal.haar_stack(ged.referenced_stack(x), len(plan) - 1), strict=True):
        if p["n"]:
            _, _, score, t, _ = ged.clean_stack(v, ref, pcs, p["n"], noise_multiplier("auto"), p["t_min"], 12.0)
            want |= {(r, p["band"]): (score[k], t[k]) for k, r in enumerate(RECS)}
    assert same(by(numeric.ged_clean(spark, "").where("score is not null").drop("enova").collect(), "rec", "band"), want)


def cleaned(recordings, window_seconds=None) -> tuple:
    x, (ref, pcs) = recordings[0], ged.prepared_reference(recordings[1])
    assert SIZE // 16 > 600
    return *ged.cleaner(FS, SIZE, window_seconds=window_seconds)(x, ref, pcs), pcs


def test_ged_full(spark, recordings):
    shares = signal.enova_stack(*cleaned(recordings)[:2], FS)
    want = {(r, k): (v,) for r, own in zip(RECS, shares, strict=True) for k, v in enumerate(own)}
    assert same(by(numeric.ged_full(spark, "").collect(), "rec", "epoch"), want)


def test_sensai_final(spark, recordings):
    clean, noise, pcs = cleaned(recordings)
    want = {(r,): (v,) for r, v in zip(RECS, ged.final_sensai_stack(clean, noise, pcs, FS), strict=True)}
    assert same(by(numeric.sensai_final(spark, "").collect(), "rec"), want)


def test_sliding_vs_global(spark, recordings):
    want = {}
    for key, seconds in (("global", None), ("win8s", 8.0)):
        shares = signal.enova_stack(*cleaned(recordings, seconds)[:2], FS)
        want |= {(key, r): (v,) for r, v in zip(RECS, shares.mean(-1), strict=True)}
    assert same(by(numeric.sliding_vs_global(spark, "").collect(), "window_key", "rec"), want)


def test_windows_of_many_epochs(monkeypatch):
    monkeypatch.undo()
    s = ged.Spectrum(np.random.default_rng(13).lognormal(size=(1, 1300, 5)), np.zeros((1, 1300, 5, 5)))
    scores = np.random.default_rng(14).normal(size=(1, 1300, 6))
    own = [over_all(s.values[:, a : a + 600], scores[:, a : a + 600], -6.0, 12.0)[1][0] for a in (0, 300, 600)]
    got = ged.moving_thresholds(s.values, scores, -6.0, 12.0, 600)[0]
    assert got[[300, 600, 900]] == pytest.approx([sum(own[:2]) / 3, sum(own) / 3, sum(own[1:]) / 3])
