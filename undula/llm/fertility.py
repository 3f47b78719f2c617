"""Quality rules: base counters of a text, and how a public vocabulary cuts it up.

Fertility is characters per token; the share of byte-fallback tokens and the entropy of the token distribution go with
it, as does its min-entropy, which the commonest token alone sets. Bands hold for a language and a length class (half
an octave of tokens, as entropy grows with length) and come from the quartiles of all documents in it that pass the
base rules. A document is judged by its distance from the median, in standard deviations as that side's quartile gives them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm import textscan
from undula.llm.common import byte_rows, materialize, slices
from undula.llm.tokencount import piece_vocabulary

SYMBOLS = b"#*$%&|<>"
#: Bands up to this number are broadcast.
BANDS_SENT = 20_000


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: Standard deviations from the median at which one measure alone, or fertility and entropy together below it, reject.
    alone: float = 4.5
    together: float = 5.5
    #: A deviation counts as this share of the median at least: an even class still has room.
    least_deviation: float = 0.01
    #: The least deviation of the byte-fallback share; of the commonest token's share it falls with n tokens, by / sqrt(n).
    least_byte_deviation: float = 0.05
    least_top_deviation: float = 0.11
    #: A class of fewer documents takes the bands of both shares from its whole language, if that has so many.
    least_class: int = 8


SCHEMA = "id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double, top_share double"


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeat_words(w: textscan.Words, n: int, width: int = 5) -> np.ndarray:
    """Per text, the words that lie in a run of `width` words found twice or more in it."""
    text, h = textscan.shingles(w, width)
    if not len(h):
        return np.zeros(n, np.int64)
    own = textscan.mix(h ^ textscan.mix(text.astype(np.uint64)))
    _, index, count = np.unique(own, return_inverse=True, return_counts=True)
    k = len(w.hash) - width + 1
    starts = np.flatnonzero(w.text[:k] == w.text[width - 1 :])[count[index] > 1]
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return np.bincount(w.text[np.cumsum(cover[:-1]) > 0], minlength=n)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(textscan.SPACES)]
    return len(lines) - len(set(lines))


def measures(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The counters of each row (SCHEMA). Null text counts as empty, whose ratios are null; nothing is shuffled."""
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        v = piece_vocabulary(vocabulary)
        for b in batches:
            texts = byte_rows(b.column(2))
            for a, z in slices(texts, 1 << 20):
                some = texts[a:z]
                w = textscan.words(some)
                bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in some])])
                leads = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80, dtype=np.int64)])
                chars = np.bincount(w.text, weights=leads[w.end] - leads[w.start], minlength=z - a).astype(np.int64)
                token_rows = []
                for t, ids in zip(some, v.encode([t.decode("utf-8", "replace") for t in some]), strict=True):
                    if not len(ids):
                        token_rows.append((0, None, None, None, None))
                        continue
                    used, counts = np.unique(ids, return_counts=True)
                    p = counts / len(ids)
                    lines = t.count(b"\n")
                    in_bytes = int(counts[v.is_byte[used]].sum()) - lines
                    letters = len(t.decode("utf-8", "replace"))
                    token_rows.append((len(ids), letters / len(ids), max(in_bytes, 0) / len(ids), float(-(p * np.log2(p)).sum()), float(p.max())))
                cols = list(zip(*token_rows, strict=True))
                whole = [w.per_text, chars, _per_text(table[w.data], bounds), np.array([_dup_lines(t) for t in some]), _repeat_words(w, z - a)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), *(pa.array(x.astype(np.int64)) for x in whole), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[1:])],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def verdicts(docs: DataFrame, vocabulary: str, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """measures() with base_failed and kept, one row per row of docs.

    base_failed: fewer than min_words words, or more than max_repeat_percent of them in repeated runs. kept: not base_failed
    and inside the bands of its class, at any length. A null language is a language of its own. A class of one document
    in a language of fewer than least_class keeps it. One row per language and length class is joined back. Empty table: no rows.
    """
    m = materialize(measures(docs, vocabulary, id_col, text_col, lang_col), "fertility")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    length = F.floor(2 * F.log2(F.greatest("n_tokens", F.lit(1))))
    m = m.withColumn("base_failed", failed).withColumn("key", F.concat_ws(" ", length.cast("string"), "lang"))
    m = m.withColumn("of_lang", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("n")))
    measured, shares = ("chars_per_token", "entropy", "byte_share", "top_share"), ("byte_share", "top_share")
    quartiles = lambda of, prefix: [F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10_000)).alias(f"{prefix}_{c}") for c in of]
    judged = ~F.col("base_failed") & (F.col("n_tokens") > 0)
    bands = materialize(m.where(judged).groupBy("key", "of_lang").agg(*quartiles(measured, "q"), F.count("*").alias("q_n")), "fertility-bands")
    whole = materialize(m.where(judged).groupBy("of_lang").agg(*quartiles(shares, "l"), F.count("*").alias("l_n")), "fertility-languages")
    bands = bands.join(whole, "of_lang")
    small = (F.col("q_n") < rules.least_class) & (F.col("l_n") >= rules.least_class)
    bands = bands.select("key", *(f"q_{c}" for c in measured if c not in shares), *(F.when(small, F.col(f"l_{c}")).otherwise(F.col(f"q_{c}")).alias(f"q_{c}") for c in shares))
    # languages times length classes: sent along where that is proven small, joined by key otherwise
    bands = F.broadcast(bands) if bands.limit(BANDS_SENT + 1).count() <= BANDS_SENT else bands

    def off(c: str, least, side: int):
        """Deviations below (side 0) or above (side 2) the median."""
        median, quartile = F.col(f"q_{c}")[1], F.col(f"q_{c}")[side]
        return (1 if side else -1) * (F.col(c) - median) / F.greatest(F.abs(quartile - median) / 0.6745, least, F.lit(1e-9))

    least = {c: rules.least_deviation * F.col(f"q_{c}")[1] for c in measured} | {"byte_share": F.lit(rules.least_byte_deviation), "top_share": rules.least_top_deviation / F.sqrt(F.greatest("n_tokens", F.lit(1)))}
    below = {c: off(c, least[c], 0) for c in measured}
    outside = (F.greatest(*below.values(), *(off(c, least[c], 2) for c in measured)) > rules.alone) | (below["chars_per_token"] + below["entropy"] > rules.together)
    return m.join(bands, "key", "left").withColumn("kept", ~F.col("base_failed") & ~F.coalesce(judged & outside, F.lit(False))).drop("key", "of_lang", *(f"q_{c}" for c in measured))
