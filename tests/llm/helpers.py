"""Small tables with every awkward case, and plain versions of what the operators compute."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(spark, extra: list[tuple] = ()):
    """Null text, empty text, blank text, one word, a very long text, exact copies, a repeated row, null id, null source."""
    rng = random.Random(4)
    base = [words(rng, rng.randint(20, 120)) for _ in range(40)]
    rows = [(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(base)]
    rows += [(100, None, "en", "s0", 0), (101, "", "en", "s1", 0), (102, " \n\t ", None, "s2", 4), (103, "word", "de", None, 4)]
    rows += [(104, words(rng, 30_000), "en", "s3", 0), (105, base[3], "en", "s0", 0), (3, base[3], "en", "s3", len(base[3])), (None, base[7], "en", "s1", 0)]
    return spark.createDataFrame([*rows, *extra], DOCS)


def clashing(df):
    """The table with columns named like those that operators make on the way."""
    from pyspark.sql import functions as F

    for c in ("id", "fp", "t", "key", "n", "h", "size", "score", "kept", "mix_size", "payload", "line", "p"):
        df = df.withColumn(c, F.lit("x"))
    return df


def components(keys: list, linked) -> dict:
    """key -> smallest key reachable, by comparing all pairs."""
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in keys:
        for b in keys:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}
