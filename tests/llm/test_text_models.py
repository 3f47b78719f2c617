import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, clashing, documents, words
from undula.llm import fertility, quotes, tokencount, tokenfile, toxicity
from undula.llm.tokens import WordVocabulary, vocabulary_path

WORD_FILE, PIECE_FILE = "word_bpe_49k.json", "piece_bpe_32k.model"
PARTS = ["a", "B", "é", "É", ",", ".", "'", "s", "S", "l", "'s", " ", "  ", "\n", "\t", "<|endoftext|>", "%", "1", "ß", "́", "▁", "“", "…", "日", "<", "|", ">", "\x1c", "²", "ª", "\xa0", "İ"]


def odd_texts(n):
    rng = random.Random(3)
    return ["", " ", "<s></s> <unk>", "\r\n);\r\n}", "x" * 5000, "Å,", "it's rock'd, you'll''s"] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("limit", [10**6, 5])
def test_word_vocabulary_equals_the_library(limit):
    v = WordVocabulary(vocabulary_path(WORD_FILE), limit)
    for t in odd_texts(1500):
        assert np.frombuffer(v.ids([t.encode()])[0], "<u4").tolist() == v.encoder.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = tokenfile.pack(v)
        assert len(control) == -(-n // 4) and np.array_equal(tokenfile.unpack(control, data, n), v)


def test_token_file_round_trip(spark, tmp_path):
    docs = documents(spark)
    file = tokenfile.write(clashing(docs), f"file://{tmp_path}/t", vocabulary_path(WORD_FILE), ids_per_shard=20_000, ids_per_block=5_000)
    v = WordVocabulary(vocabulary_path(WORD_FILE))
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    want, at = [], 0
    for r in rows:
        ids = np.array([*v.encoder.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = tokenfile.read(spark, file).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokenfile.read(spark, tokenfile.write(docs.limit(0), f"file://{tmp_path}/e", vocabulary_path(WORD_FILE))).count() == 0


def test_ranks_follow_frequency(spark, tmp_path):
    file = tokenfile.write(documents(spark), f"file://{tmp_path}/t", vocabulary_path(WORD_FILE))
    counts = [r["count"] for r in spark.read.parquet(file.ranks_path).orderBy("rank").collect()]
    assert counts == sorted(counts, reverse=True)


def test_spliced_counts_equal_whole_counts():
    v = tokencount.piece_vocabulary(vocabulary_path(PIECE_FILE))
    rng = random.Random(5)
    assert v.words_end_tokens
    for _ in range(400):
        t = "".join(rng.choice(["a", "thé", " ", "  ", "   ", "\n", "▁", "{", "日", "x" * 5, "the ", "ing "]) for _ in range(rng.randint(0, 300)))
        for chunk, overlap in ((40, 8), (25, 3), (100, 20)):
            assert tokencount.count_tokens(t, v, chunk, overlap) == len(v.encoder.encode(t)), repr(t)
    assert tokencount.count_tokens("x" * 3000, v, 100, 10) == len(v.encoder.encode("x" * 3000))


def test_token_counts_of_all_rows(spark):
    v = tokencount.piece_vocabulary(vocabulary_path(PIECE_FILE))
    docs = documents(spark, [(300 + k, t, "en", "s", 0) for k, t in enumerate(odd_texts(200))])
    got = tokencount.token_counts(clashing(docs), vocabulary_path(PIECE_FILE), chunk=2_000, overlap=50)
    want = [(repr(r["doc_id"]), len((r["text"] or "").encode()), len(v.encoder.encode(r["text"] or ""))) for r in docs.collect()]
    assert sorted((repr(r["id"]), r["n_bytes"], r["n_tokens"]) for r in got.collect()) == sorted(want)


def plain_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, cover = len(w), set()
    grams = Counter(tuple(w[k : k + 5]) for k in range(n - 4))
    for k in range(n - 4):
        if grams[tuple(w[k : k + 5])] > 1:
            cover |= set(range(k, k + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), n < 10 or 100 * len(cover) > 20 * n


def test_fertility_counters_and_junk(spark):
    rng = random.Random(7)
    prose = words(rng, 400).split()
    extra = [(400 + k, " ".join(rng.choice(prose) for _ in range(150)), "xx", "s", 0) for k in range(80)]
    extra += [(600 + k, " | ".join(rng.choice(prose) for _ in range(150)), "xx", "s", 0) for k in range(5)]
    extra += [(700, "é a b c d e a b c d e a b c d e\nsame line\nsame line\n\n same line", "en", "s", 0), (701, "\x01\x02" * 400 + " a b c d e f g h i j k", "xx", "s", 0)]
    docs = documents(spark, extra)
    got = fertility.verdicts(clashing(docs), vocabulary_path(PIECE_FILE)).collect()
    want = sorted((repr(r["doc_id"]), *plain_base(r["text"] or "")) for r in docs.collect())
    assert sorted((repr(r["id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    kept = {r["id"]: r["kept"] for r in got if r["id"] is not None}
    assert not any(kept[k] for k in range(600, 605)) and not kept[701] and not kept[100]
    assert sum(kept[k] for k in range(400, 480)) >= 78
    assert fertility.verdicts(docs.limit(0), vocabulary_path(PIECE_FILE)).count() == 0


def labelled(n, seed):
    rng = random.Random(seed)
    bad = ["idiot", "moron", "stupid"]
    rows = []
    for k in range(n):
        w = words(rng, rng.randint(20, 200)).split()
        if k % 4 == 0:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((k, " ".join(w), int(k % 4 == 0)))
    return rows


def test_toxicity_held_out_and_misspelt(spark):
    rows = labelled(900, 1)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows] + [(9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (None, "some words here", "en", "s", 0)], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(0, 1, 1), (None, 1, 1), (5, 1, None), (99_999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(clashing(docs), clashing(labels))
    got = {r["id"]: r["score"] for r in toxicity.score(clashing(docs), model).collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == truth[i] for i in held]) > 0.97
    assert got[9000] == got[9001] == 0 and all(0 <= s <= 1 for s in got.values())
    clean = words(random.Random(4), 60)
    seen = model.scores([t.encode() for t in (clean, clean + " you idiiot", clean + " what a moronn")])
    assert seen[0] < 0.3 <= min(seen[1:])
    left = toxicity.without_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == sum(s < 0.3 for s in got.values())


def test_held_out_rows_change_nothing(spark):
    rows = labelled(300, 2)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], DOCS)
    weights = []
    for flip in (False, True):
        y = [(i, 1, 1 - y if flip and zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows]
        weights.append(toxicity.fit(docs, spark.createDataFrame(y, "doc_id long, quality int, toxic int")).weights)
    assert np.array_equal(*weights)


def test_one_label_gives_a_constant(spark):
    docs = documents(spark)
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert max(r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()) < 0.3
    assert toxicity.fit(docs, labels.limit(0)).scores([b"a b"])[0] < 0.6


CHAT = [
    (1, 0, "user", "Hello there\nhow are you?\n\nSecond para."), (1, 1, "assistant", "> hello there how\n> are you?\nFine."), (1, 2, "user", ">> Hello there\n>> how are you?\n> Fine.\nGood"),
    (1, 3, "assistant", "> good\n\nok"), (1, 4, "user", "new topic"), (2, 0, "user", "> Second PARA.\nfrom elsewhere"), (2, 1, "user", "> nobody said\nx"), (2, 2, "user", None),
    (None, 0, "user", "> Fine."), (2, 3, "user", ""), (2, 3, "user", ""), (3, 0, "user", "thanks"), (3, 1, "user", "thanks"), (3, 2, "user", " > > thanks\n>  THANKS "), (3, 3, "user", ">\n> \n"),
    # a sentence of a paragraph, re-wrapped; an interleaved reply; two paragraphs run together; lines of a list; the wrong order
    (4, 0, "user", "First point here. Second point is\nlonger! Third?\n\nA closing paragraph\n\n- one\n- two\n- three"), (4, 1, "assistant", "> Second\n> point is longer!\nyes"),
    (4, 2, "user", "> First point here.\nno\n> Second point is longer! Third?\nmaybe"), (4, 3, "user", "> Third?\n> A closing paragraph\nok"), (4, 4, "user", "> - two\n> - three\nthese"),
    (4, 5, "user", "> Third? First point here.\nwrong"), (4, 6, "user", "> point here.\ncut"),
]


def test_quotes(spark):
    got = quotes.conversations(clashing(spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string"))).collect()
    by = {(r["conv_id"], r["turn"]): (r["n_quotes"], r["n_linked"], r["reply_to_conv"], r["reply_to_turn"], r["thread_turn"], r["depth"], r["body"]) for r in got}
    assert len(got) == len(CHAT)
    assert by[1, 1] == (1, 1, 1, 0, 0, 1, "Fine.") and by[1, 2] == (2, 2, 1, 1, 0, 2, "Good") and by[1, 3] == (1, 1, 1, 2, 0, 3, "\nok")
    assert [by[4, k][:4] for k in range(1, 7)] == [(1, 1, 4, 0), (2, 2, 4, 0), (1, 1, 4, 0), (1, 1, 4, 0), (1, 0, None, None), (1, 0, None, None)]
    assert by[1, 4] == (0, 0, None, None, 4, 0, "new topic") and by[2, 0] == (1, 1, 1, 0, 0, 0, "from elsewhere")
    assert by[2, 1][:4] == (1, 0, None, None) and by[2, 2][6] is None and by[None, 0][:4] == (0, 0, None, None)
    assert by[3, 2] == (2, 2, 3, 1, 1, 1, "") and by[3, 3][:2] == (0, 0)
    assert quotes.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quotes_equal_sql(spark):
    import duckdb
    import pandas as pd

    from tests.oracle import assert_same
    from undula.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(CHAT, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert_same(quotes.conversations(spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")), con, ORACLE_SQL["op3_quotation_links"])


def test_quotes_of_parts_are_all_found(spark):
    """Thousands of messages that quote one to three sentences in a row of an earlier one, cut anywhere and re-wrapped."""
    rng = random.Random(9)
    rows, want = [], {}
    for c in range(300):
        texts = []
        for t in range(8):
            sentences = [f"{words(rng, rng.randint(4, 12))} {c} {t} {k}." for k in range(rng.randint(1, 6))]
            text = "".join(s + rng.choice([" ", "\n", "\n\n"]) for s in sentences)
            if texts and rng.random() < 0.7:
                up = rng.randrange(len(texts))
                a = rng.randrange(len(texts[up]))
                quoted = " ".join(texts[up][a : a + rng.randint(1, 3)]).split(" ")
                cut = rng.randint(1, len(quoted))
                text = "".join(f"> {' '.join(part)}\n" for part in (quoted[:cut], quoted[cut:]) if part) + text
                want[c, t] = up
            texts.append(sentences)
            rows.append((c, t, "user", text))
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("n_quotes > 0").collect()
    assert {(r["conv_id"], r["turn"]): r["reply_to_turn"] for r in got} == want and len(want) > 1000


def test_runs_of_few_distinct_lines_equal_brute_force(spark):
    """Messages of hundreds of lines of two kinds, so that every run begins at many places, and quotations that are or are not a run of theirs."""
    rng = random.Random(4)
    said = {(c, 0): [rng.choice(["ok", "no"]) for _ in range(rng.randint(1, 300))] for c in range(6)} | {(6, 0): ["ok"] * 500}
    quoted = {}
    for k in range(150):
        own = said[rng.randrange(7), 0]
        a = rng.randrange(len(own))
        part = own[a : a + rng.randint(1, 40)]
        if rng.random() < 0.5:
            part = [*part, "ok" if rng.random() < 0.5 else "no"]
        quoted[100 + k, 0] = part
    rows = [(c, t, "u", "\n".join(x)) for (c, t), x in said.items()] + [(c, t, "u", "\n".join(f"> {y}" for y in x)) for (c, t), x in quoted.items()]
    holds = lambda x, y: any(x[a : a + len(y)] == y for a in range(len(x)))
    want = {at: min((c for (c, _), x in said.items() if holds(x, y)), default=None) for at, y in quoted.items()}
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("n_quotes > 0").collect()
    assert {(r["conv_id"], r["turn"]): r["reply_to_conv"] for r in got} == want
    assert 20 < sum(v is None for v in want.values()) < 130


def test_a_long_chain_of_replies(spark):
    rows = [(1, 0, "u", "message 0")] + [(1, k, "u", f"> message {k - 1}\nmessage {k}") for k in range(1, 40)]
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r["thread_turn"], r["depth"]) for r in got} == {(0, k) for k in range(40)}


def test_fertility_bands_hold_for_scripts_spelt_by_bytes_and_short_texts(spark):
    rng = random.Random(9)
    ethiopic = lambda n: " ".join("".join(chr(rng.randrange(0x1200, 0x1240)) for _ in range(rng.randint(2, 5))) for _ in range(n))
    extra = [(400 + k, ethiopic(100), "am", "s", 0) for k in range(60)]
    extra += [(500, words(rng, 160), "am", "s", 0)]  # another script: far below the class in bytes
    extra += [(600 + k, " ".join(rng.choice(["the", "house", "stands", "near", "a", "river", "and", "old", "trees"]) for _ in range(22)), "en", "s", 0) for k in range(60)]
    extra += [(700, "\x01\x02\x03\x04 the house stands near a river and old \x05\x06\x07\x08\x0e\x0f\x10", "en", "s", 0)]
    got = {r["id"]: r for r in fertility.verdicts(documents(spark, extra), vocabulary_path(PIECE_FILE)).collect()}
    assert min(got[k]["byte_share"] for k in range(400, 460)) > 0.25
    assert sum(got[k]["kept"] for k in range(400, 460)) >= 58 and not got[500]["kept"]
    assert got[700]["n_tokens"] < 48 and not got[700]["base_failed"] and not got[700]["kept"]
    assert sum(got[k]["kept"] for k in range(600, 660) if not got[k]["base_failed"]) >= 0.9 * sum(not got[k]["base_failed"] for k in range(600, 660)) > 0
