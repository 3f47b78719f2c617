import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import clashing
from tests.oracle import assert_same, connect
from undula.llm import prefixtrie, queries

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(convs: dict[int, list[tuple]]) -> list[tuple]:
    """Nodes as a dictionary of prefixes."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for node, of in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(not any(len(y) > len(x) and y[: len(x)] == x for y in members) for x in below)
        saved = sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in below)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children), leaves, saved, digest))
    return sorted(out, key=repr)


def rebuilt(rows: list[tuple]) -> dict[int, list[tuple]]:
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    head = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: head[c]] + v[head[c] :] for c, v in own.items()}


def built(df):
    convs = prefixtrie.sequences(df)
    return prefixtrie.spliced(convs, F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6)


def nodes(df, **how) -> list[tuple]:
    found = prefixtrie.trie(df, **how)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()), key=repr)


def test_query_against_sql(spark):
    assert_same(queries.op12_prefix_trie(spark, SF), connect(SF), queries.ORACLE_SQL["op12_prefix_trie"])


def test_both_ends_of_every_prefix():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.integers(0, 5, n)
        table = prefixtrie.RangeMinimum(values)
        at, d = np.repeat(np.arange(n), 6), np.tile(np.arange(6), n)
        right, left = table.right(at, d), table.left(at, d)
        for i, k, r, l in zip(at, d, right, left, strict=True):
            want = i
            while want + 1 < n and values[want + 1] >= k:
                want += 1
            assert r == want
            want = i
            while want > 0 and values[want] >= k:
                want -= 1
            assert l == want
        first = rng.integers(0, n, 50)
        last = first + rng.integers(0, n - first)
        assert (table.least(first, last) == [values[a : b + 1].min() for a, b in zip(first, last, strict=True)]).all()


@pytest.mark.parametrize("seed,range_turns", [(0, 8), (1, 3), (2, 1), (3, 100)])
def test_shared_starts_over_many_ranges(spark, seed, range_turns):
    # a third are copies of one conversation, a third share a deep start, the rest are drawn from few turns
    rng = random.Random(seed)
    deep, rows = [f"d{k}" for k in range(12)], []
    for c in rng.sample(range(-40, 700), 90):
        turns = ["one", "two"] if c % 3 == 0 else deep[: rng.randint(1, 12)] + ["x"] * rng.randint(0, 2) if c % 3 == 1 else [rng.choice("ab") for _ in range(rng.randint(1, 5))]
        rows += [(c, t, "user", x) for t, x in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS)
    own = defaultdict(list)
    for c, t, role, x in sorted(rows):
        own[c].append((role, x))
    assert nodes(prefixtrie.sequences(df), range_turns=range_turns) == plain(own)


def test_awkward_turns(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["hi", "hé", "", None])) for c in range(95, 330) for t in rng.sample(range(9), rng.randint(1, 6))]
    rows += [(None, 0, "user", "lost"), (150, None, "user", "null first"), (160, 3, "user", "again"), (160, 3, "user", "again"), (100, 0, "system", "x" * 300_000)]
    rows += [(9_007, t, "user", str(t)) for t in range(700)]
    # a concatenation that reads alike is no equal turn
    rows += [(400, 0, "ab", "c"), (401, 0, "a", "bc")]
    unique = {(c, t): x for c, t, *x in rows if not (c == 160 and t == 3)}
    rows = [(c, t, *x) for (c, t), x in unique.items()] + [(160, 3, "user", "again")] * 2
    assert nodes(built(clashing(spark.createDataFrame(rows, TURNS)))) == plain(rebuilt(rows))


def test_turnless_and_empty(spark):
    rows = [(c, 0, "user", "only") for c in (101, 102, 103, 104, 105, 106, 107)]
    turns = rebuilt(rows)
    assert [] in turns.values()
    assert nodes(built(spark.createDataFrame(rows, TURNS))) == plain(turns)
    assert nodes(built(spark.createDataFrame([], TURNS))) == []
    assert nodes(built(spark.createDataFrame([(None, 1, "user", "x")], TURNS))) == []
