import math
import random

import numpy as np
import pytest

from tests.llm.helpers import clashing
from tests.oracle import assert_same, connect
from undula.llm import bond, queries

SF = "/root/testdata/sf0.001"
ROWS = "vec_id long, embedding array<float>, label int"


def plain(rows: list[tuple], positives: int = 5, negatives: int = 5) -> list[tuple]:
    """Every score of every anchor, sorted."""
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], c) for i, v, c in rows if None not in (i, v, c) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, c in ok:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, d) for j, w, d in ok if j != i)
        for s, p, _ in [x for x in scored if x[2] == c][:positives]:
            found = [x for x in scored if x[2] != c and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(i, p, r, j, -s, -n) for r, (n, j, _) in enumerate(found, 1)]
    return sorted(out)


def mined(df, rules=bond.Rules()):
    from pyspark.sql import functions as F

    found = bond.hard_negatives(df, F.col("vec_id") % 100 == 0, rules)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def random_rows(n: int, dims: int, labels: int, seed: int, steps: int = 8) -> list[tuple]:
    """Few steps make many ties; the first label holds a third of the rows."""
    rng = random.Random(seed)
    return [(k, [rng.randint(-steps, steps) / 256 / 2 for _ in range(dims)], 0 if k % 3 == 0 else rng.randrange(labels)) for k in range(n)]


def test_query_against_sql(spark):
    assert_same(queries.op11_hard_negatives(spark, SF), connect(SF), queries.ORACLE_SQL["op11_hard_negatives"])


@pytest.mark.parametrize("dims", [1, 5, 40])
def test_all_scores_with_ties(spark, monkeypatch, dims):
    monkeypatch.setattr(bond, "GROUP_VALUES", 64 * dims)
    monkeypatch.setattr(bond, "ANCHOR_BLOCK", 2)
    rows = random_rows(420, dims, 4, dims)
    assert mined(spark.createDataFrame(rows, ROWS)) == plain(rows)


def test_awkward_rows(spark):
    rows = random_rows(120, 6, 3, 9)
    rows += [(None, [0.1] * 6, 1), (200, None, 1), (300, [0.1] * 6, None), (400, [0.1, None] * 3, 0), (500, [math.nan] * 6, 0), (600, [math.inf] * 6, 0)]
    rows += [(700, [], 1), (800, [0.5, 0.25], 2), (5, rows[5][1], rows[5][2]), (-100, [0.5] * 6, 0), (900, [0.0] * 6, 77), (901, [3000.0] * 6, 1)]
    assert mined(clashing(spark.createDataFrame(rows, ROWS)).drop("label").join(spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] is not None], "vec_id long, label int").distinct(), "vec_id")) == plain(rows)
    twice = [*rows, rows[100]]
    assert mined(spark.createDataFrame(twice, ROWS)) == plain(twice)


def test_empty_and_too_large(spark):
    assert mined(spark.createDataFrame([], ROWS)) == []
    assert mined(spark.createDataFrame([(1, [0.5], 1)], ROWS)) == []
    rows = [(0, [0.5, 0.5], 1), (1, [0.5, 0.4], 1), (2, [0.5, 0.3], 2)]
    assert mined(spark.createDataFrame([*rows, (3, [1e30, 0.0], 1), (4, [1e9, 0.0], 2)], ROWS)) == plain(rows) != []


def test_scan_drops_no_row_of_a_window():
    rng = np.random.default_rng(3)
    for _ in range(60):
        d, n, k = rng.integers(1, 70), rng.integers(1, 400), rng.integers(1, 6)
        x, a = rng.integers(-9, 10, (d, n)).astype(float), rng.integers(-9, 10, d).astype(float)
        exact, low = a @ x, rng.integers(-50, 50, 3).astype(float)
        high = low + rng.integers(0, 60, 3)
        rows, score = bond.vertical_scan(x, a, np.arange(n), low, high, np.full(3, -np.inf), int(k))
        assert (score == exact[rows]).all()
        for lo, hi in zip(low, high, strict=True):
            want = np.sort(exact[(exact >= lo) & (exact <= hi)])[::-1][:k]
            assert (np.sort(score[(score >= lo) & (score <= hi)])[::-1][:k] == want).all()


def test_integers_beyond_doubles(spark):
    # products above 2^53: doubles would round them
    rows = [(0, [900_000.0, 3.0], 1), (1, [900_000.0, 1.0], 1), (2, [900_000.0, 0.99609375], 2), (3, [899_999.9375, 5.0], 2)]
    assert mined(spark.createDataFrame(rows, ROWS)) == plain(rows) != []
