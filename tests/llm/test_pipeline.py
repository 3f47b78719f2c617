import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, clashing, components, documents, words
from tests.llm.test_search_dedup import plain_fingerprint, shingles_5
from undula.llm import decontam, mixing, toxicity
from undula.llm.common import table
from undula.llm.tokens import WordVocabulary, vocabulary_path

SF = "/root/testdata/sf0.001"


def plain_representatives(rows):
    """The smallest id of each group linked by 3 bits of the fingerprint or by 5-word shingles of Jaccard similarity 0.8."""
    text = {r["doc_id"]: r["text"] or "" for r in rows}
    bits = {i: plain_fingerprint(t) for i, t in text.items()}
    sets = {i: shingles_5(t) for i, t in text.items()}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0
    return sorted(set(components(sorted(text), lambda a, b: (bits[a] ^ bits[b]).bit_count() <= 3 or alike(a, b)).values()))


def test_each_stage_on_its_own_input(spark):
    import corpus_pipeline as p

    docs = table(spark, SF, "documents")
    columns = docs.columns
    rows = {}
    for name, stage in p.STAGES:
        before = docs
        docs = p.materialize(stage(spark, docs, SF), "test")
        rows[name] = docs.count()
        if name == "toxicity":
            scores = toxicity.score(before, toxicity.fit(before, table(spark, SF, "labels"))).where("score < 0.3")
            assert rows[name] == scores.count() < before.count()
        if name == "simhash near-dedup":
            assert sorted(r["doc_id"] for r in docs.collect()) == plain_representatives(before.collect())
        if name == "benchmark decontamination":
            hit = {r["doc_id"] for r in decontam.contained_items(before, table(spark, SF, "benchmark")).collect()}
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r["doc_id"] for r in before.collect() if r["doc_id"] not in hit)
        if name == "mixing to target weights":
            assert rows[name] == mixing.plan(before).selectExpr("sum(mix_copies)").first()[0]
        if name != "token-ID output":
            assert docs.columns == columns
    v, at = WordVocabulary(vocabulary_path("word_bpe_49k.json")), 0
    want = []
    for r in sorted(before.collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*v.encoder.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, docs.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1]) == want
    assert [n for n, _ in p.STAGES] == list(rows)


def test_run_gives_the_same(spark):
    import corpus_pipeline as p

    assert p.run(spark, SF).count() > 0


def awkward(spark, docs, folder):
    """A folder of tables with these documents, and few labels and items."""
    rng = random.Random(2)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, int(k % 5 == 0)) for k in range(40)] + [(3, None, None), (None, 1, 1), (0, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, words(rng, 12)), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_with_nulls_repeats_and_clashing_names(spark, tmp_path):
    import corpus_pipeline as p

    folder = awkward(spark, clashing(documents(spark)).withColumn("mix_note", F.lit("mine")), tmp_path)
    first = docs = table(spark, folder, "documents")
    for _, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, folder), "test")
        assert docs.columns == first.columns and 0 < docs.count()
        assert {r["mix_note"] for r in docs.collect()} == {"mine"} and {r["mix_size"] for r in docs.collect()} == {"x"}
    assert p.run(spark, folder).count() == docs.count()


def test_an_empty_table(spark, tmp_path):
    import corpus_pipeline as p

    assert p.run(spark, awkward(spark, documents(spark).limit(0), tmp_path)).count() == 0


def test_repeats_that_differ_elsewhere_are_picked_alike_on_any_partitioning(spark):
    from undula.llm import mixing, simhash

    rng = random.Random(7)
    text = words(rng, 40)
    rows = [(1, text, "en", "a", k) for k in range(12)] + [(k, words(rng, 30), "en", "b", 0) for k in range(2, 9)]
    docs = spark.createDataFrame(rows, DOCS)
    found = set()
    for df in (docs, docs.repartition(5), docs.orderBy(F.desc("n_chars")).coalesce(1)):
        found.add((tuple(sorted(map(repr, mixing.mix(df).collect()))), tuple(sorted(map(repr, simhash.without_copies(df).collect())))))
    assert len(found) == 1
    assert simhash.without_copies(docs).where("doc_id = 1").count() == 1
