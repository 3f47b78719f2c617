import base64
import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, clashing, documents
from tests.oracle import assert_same, connect
from undula.llm import mixing, queries, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name])


PAGES = [(1, "http://a/x y\r\n", "<p>one</p>"), (2, None, "<p>one</p>"), (9, "u", "<p>one</p>"), (3, "u", None), (4, "u", ""), (5, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 5), (6, "u", "ü" * 200_000), (None, "u", "<p>one</p>"), (7, "u", "same"), (7, "u", "same"), (8, "u", "lone")]


def plain_warc(rows, least=0):
    last = defaultdict(lambda: None)
    for i, _, html in rows:
        d = (html or "").encode()
        if len(d) >= least and i is not None and (last[d] is None or i > last[d]):
            last[d] = i
    out = []
    for i, _, html in rows:
        d = (html or "").encode()
        revisit = len(d) >= least and last[d] is not None and i != last[d]
        out.append((i, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "revisit" if revisit else "response", last[d] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archives(clashing(pages), f"file://{tmp_path}/w", min_bytes=least)
    read = warc.read_archives(spark, f"file://{tmp_path}/w").cache()
    records = warc.resolve_revisits(read.select("page_id", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes")))
    got = sorted((tuple(r) for r in records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    assert got == plain_warc(PAGES, least)
    payloads = {r["page_id"]: r["payload"] for r in read.where("record_type = 'response'").collect()}
    assert bytes(payloads[5]).decode() == PAGES[5][2] and bytes(payloads[6]).decode() == PAGES[6][2]
    assert {r["url"] for r in read.where("page_id = 1").collect()} == {"http://a/x%20y%0D%0A"}


def test_archives_of_nothing(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert warc.read_archives(spark, f"file://{tmp_path}/w").count() == 0


def plain_targets(sizes: dict, weights=(5, 2, 1), cap=3) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, open_ = dict.fromkeys(sizes, 0.0), {s for s in sizes if sizes[s]}
    left = float(sum(sizes.values()))
    while left > 1e-9 and open_:
        unit, full = left / sum(w[s] for s in open_), set()
        for s in list(open_):
            target[s] += unit * w[s]
        left = 0.0
        for s in open_:
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                full.add(s)
        open_ -= full
    return target


def test_mix_targets_and_copies(spark):
    rng = random.Random(2)
    extra = [(1000 + k, " ".join(["w"] * rng.choice([1, 3, 50, 400])), "en", rng.choice(["s1", "s1", "s1", "z", "Z", "é"]), 0) for k in range(600)]
    extra.append((5000, "tiny", "en", "aaa", 0))
    rows = mixing.plan(clashing(documents(spark, extra))).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["mix_size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert 0 <= r["mix_taken"] <= 3 * r["mix_size"] and r["mix_taken"] == r["mix_copies"] * r["mix_size"]
        sizes[r["source"]] += r["mix_size"]
        taken[r["source"]] += r["mix_taken"]
    want = plain_targets(sizes)
    for r in rows:
        assert r["mix_source_size"] == sizes[r["source"]] and r["mix_target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        largest = max(r["mix_size"] for r in rows if r["source"] == s)
        assert abs(taken[s] - want[s]) <= max(largest, 0.1 * want[s])
    again = sorted((repr(r["doc_id"]), r["mix_size"], r["mix_taken"]) for r in mixing.plan(documents(spark, extra).repartition(7)).collect())
    assert again == sorted((repr(r["doc_id"]), r["mix_size"], r["mix_taken"]) for r in rows)


def test_systematic_counts_are_exact(spark):
    rows = [(k, "a b c", "en", "x" if k % 3 else "y", 5) for k in range(300)]
    got = mixing.plan(spark.createDataFrame(rows, DOCS)).groupBy("source").agg(F.sum("mix_copies").alias("n"), (F.first("mix_target") / 3).alias("want")).collect()
    assert all(abs(r["n"] - r["want"]) <= 1 for r in got)


def test_mix_emits_copies_with_all_columns(spark):
    docs = documents(spark)
    planned = mixing.plan(docs).agg(F.sum("mix_copies")).first()[0]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == planned
    assert mixing.plan(docs.limit(0)).count() == 0
    only_empty = docs.where("doc_id in (100, 101)")
    assert [r["mix_taken"] for r in mixing.plan(only_empty).collect()] == [0, 0]
