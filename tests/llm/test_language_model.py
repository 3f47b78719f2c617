import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, documents
from undula.llm import ctw, queries

SF = "/root/testdata/sf0.001"


def condition():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0


def learned(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 != 0


def low(text) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Tree:
    """A context tree for one node of the byte's binary tree, walked node by node."""

    def __init__(self, depth):
        self.depth, self.counts = depth, {}

    def add(self, context: bytes, bit: int):
        for j in range(self.depth + 1):
            self.counts.setdefault(context[len(context) - j :], [0, 0])[bit] += 1

    def weigh(self):
        children: dict = {}
        for c in self.counts:
            if c:
                children.setdefault(c[1:], []).append(c)

        def all_of(c):
            a, b = self.counts[c]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
            self.own[c] = own
            if len(c) == self.depth:
                self.all[c] = own
                return own
            below = sum(all_of(x) for x in children.get(c, []))
            top = max(own, below)
            self.all[c] = math.log(0.5) + top + math.log(math.exp(own - top) + math.exp(below - top))
            return self.all[c]

        self.own, self.all = {}, {}
        if b"" in self.counts:
            all_of(b"")

    def one(self, context: bytes, j: int = 0) -> float:
        c = context[len(context) - j :]
        a, b = self.counts.get(c, (0, 0))
        estimate = (b + 0.5) / (a + b + 1)
        if j == self.depth:
            return estimate
        w = math.exp(math.log(0.5) + self.own[c] - self.all[c]) if c in self.all else 0.5
        return w * estimate + (1 - w) * self.one(context, j + 1)


def plain(rows, depth, smooth=0.1):
    def positions(text):
        data = bytes([255]) * depth + low(text).encode() + bytes([255])
        for k in range(depth, len(data)):
            for b in range(8):
                yield data[k - depth : k], (1 << b) | data[k] >> (8 - b), data[k] >> (7 - b) & 1

    trees = {n: Tree(depth) for n in range(1, 256)}
    words = Counter()
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
    for i, t in rows:
        if learned(i):
            words.update(token(t))
            for context, n, bit in positions(t):
                trees[n].add(context, bit)
    for t in trees.values():
        t.weigh()
    n, v = sum(words.values()), len(words)
    out = []
    for i, t in rows:
        score = 0.0
        for context, node, bit in positions(t):
            one = trees[node].one(context)
            score += math.log10(one if bit else 1 - one)
        of = token(t)
        base = sum(math.log10((words[w] + smooth) / (n + smooth * (v + 1))) for w in of)
        out.append((i, learned(i), len(of), sum(words[w] > 0 for w in of), n, base, score))
    return out


def held(found) -> list[tuple]:
    rows = found.select("id", "learns", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    return [tuple(r) for r in rows]


def same(a: list[tuple], b: list[tuple]):
    key = lambda r: (repr(r[0]), r[1:5], round(r[5], 3), round(r[6], 3))
    a, b = sorted(a, key=key), sorted(b, key=key)
    assert [x[:5] for x in a] == [x[:5] for x in b]
    for x, y in zip(a, b, strict=True):
        assert x[5:] == pytest.approx(y[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_against_trees_in_memory(spark, monkeypatch, depth):
    monkeypatch.setattr(ctw, "BLOCK", 2000)
    monkeypatch.setattr(ctw, "SLICE", 700)
    monkeypatch.setattr(ctw, "HELD", 600)
    rng = random.Random(depth)
    rows = [(k, " ".join(rng.choice(["the", "The", "cat", "Ébène", "sat\n", "on", "ΑΒ", "a\x00b", "zq%d" % rng.randrange(9)]) for _ in range(rng.randint(1, 40)))) for k in range(60)]
    rows += [(None, "null id"), (200, None), (201, ""), (202, "  \t"), (203, "the cat " * 2000), (7, rows[7][1]), (204, "unseen wörds ONLY 12345")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(held(ctw.scores(df, condition(), depth=depth)), plain(rows, depth))


def test_clashing_names_and_partitions(spark):
    docs = documents(spark)
    wide = clashing(docs).withColumns({c: F.lit(1) for c in ("block", "learns", "kind", "value", "ctx", "bits")})
    same(held(ctw.scores(wide.repartition(7), condition())), held(ctw.scores(docs.coalesce(1), condition())))


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    found = {r.id: r for r in ctw.scores(df, F.lit(None).cast("boolean")).collect()}
    assert found[1].score == pytest.approx(3 * 8 * math.log10(0.5)) and found[2].score == pytest.approx(8 * math.log10(0.5))
    assert found[1].base_score == 0 and found[1].train_tokens == 0 and found[1].n_known == 0 and found[1].bits_per_byte == pytest.approx(8)
    assert ctw.scores(df.where("false"), F.lit(True)).collect() == []
    with pytest.raises(ValueError):
        ctw.scores(df, F.lit(True), depth=7)


def test_probabilities_of_all_bytes_add_up(spark):
    # every byte after each of some contexts, so that the mixture's estimates can be summed
    rows = [((c << 8) | b, 3 if b in (97, 98) else 0) for c in (0x61626364, 0x62626364, 0x01020304) for b in range(256)]
    found = ctw.gram_estimates(spark.createDataFrame(rows, "key long, n long")).withColumn("c", F.shiftright("key", 8)).groupBy("c").agg(F.sum(F.pow(F.lit(10.0), "log10p")).alias("s")).collect()
    assert len(found) == 3 and all(r.s == pytest.approx(1, abs=1e-9) for r in found)


def test_query_beats_its_base(spark):
    found = queries.op13_language_model(spark, SF).toPandas()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    out = found[found.held_out]
    assert len(out) and out.bits_per_byte.mean() < 4 and (found.n_known <= found.n_tokens).all()
    assert (found.train_tokens == found[~found.held_out].n_tokens.sum()).all()
