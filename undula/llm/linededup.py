"""Line deduplication over a corpus, exact and within one edit, by a deletion-neighbourhood join. DataFrame functions only.

Two lines are within one edit if both give the same string when the same place is deleted (one letter replaced), or if
one is what the other gives (one letter more). All variants of all lines would be as many rows as the corpus has
letters, so those are left out that provably meet no other: two lines within one edit share their first or their last
q letters (q a power of two, a quarter to a half of the line; none of a line of one letter), and they agree outside one of the line's segments. What
is left emits the variants of that segment, each hashed with what stands around it. Lines with equal variants are
compared by edit distance, and the earliest (by document, then line) stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.llm.common import materialize


def _lines(docs: DataFrame) -> DataFrame:
    """docs(d, th, text) -> a row (d, th, no, line) for each line with a word."""
    rows = docs.select("d", "th", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _end_keys(line: Column, length: Column) -> Column:
    """Hashes of the line's two ends of q letters; a length of a power of two also has those of one letter less."""
    bits = F.length(F.bin(length))
    q = F.shiftright(F.call_function("shiftleft", F.lit(1), (bits - 1).cast("int")), 1)
    less = F.when(F.bit_count(length) == 1, F.shiftright(q, 1)).otherwise(q)
    keys = [F.xxhash64(F.lit(side), n, F.left(line, n) if side == 0 else F.right(line, n)) for n in (q, less) for side in (0, 1)]
    return F.array_distinct(F.array(*keys))


def _near_links(candidates: DataFrame) -> DataFrame:
    """candidates(p, length, line), distinct lines -> (p, line, first): an earlier p within one edit, by equal variants."""
    m = candidates.select("p", "line", "length", F.explode(F.array(F.col("length"), F.col("length") - 1)).alias("m")).where("m > 0")
    count = F.ceil(F.sqrt(F.col("m"))).cast("int")
    seg = m.withColumn("w", F.ceil(F.col("m") / count).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / F.col("w")).cast("int") - 1)).alias("s"))
    a = F.col("s") * F.col("w")
    b = F.least(F.col("m"), a + F.col("w"))
    seg = seg.select("p", "length", a.alias("a"), b.alias("b"), "m", F.xxhash64("m", "s", F.left("line", a), F.right("line", F.col("m") - b)).alias("around"), F.substring("line", a + 1, F.col("length") - F.col("m") + b - a).alias("middle"))
    shared = seg.groupBy("around").agg(F.count("*").alias("n")).where("n > 1").select("around")
    middles = seg.join(shared, "around").select("p", "around", "middle")
    at = middles.select("p", "around", "middle", F.explode(F.sequence(F.lit(0), F.length("middle"))).alias("cut"))
    variant = F.when(F.col("cut") == 0, F.col("middle")).otherwise(F.concat(F.left("middle", F.col("cut") - 1), F.substring("middle", F.col("cut") + 1, F.length("middle"))))
    keyed = at.select("p", "cut", F.xxhash64("around", variant).alias("v"))
    # lines are distinct, so a variant has few of them: a letter for each place
    whole = F.min(F.when(F.col("cut") == 0, F.col("p"))).over(Window.partitionBy("v"))
    any_cut = F.min("p").over(Window.partitionBy("v"))
    same_cut = F.min("p").over(Window.partitionBy("v", "cut"))
    first = F.least(same_cut, whole, F.when(F.col("cut") == 0, any_cut))
    return keyed.select("p", first.alias("first")).where("first < p").distinct()


def dropped_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """docs(d, th, text) -> (d, th, no, near): the lines that an earlier one makes superfluous, near or exactly."""
    lines = _lines(docs).select("d", "th", "no", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), F.length("line").alias("length"))
    place = F.struct("d", "th", "no")
    keys = F.when(F.col("length") >= min_chars, _end_keys(F.col("line"), F.col("length")))
    slim = lines.select(place.alias("p"), "h", "h2", "length", keys.alias("keys"))
    distinct = slim.groupBy("h", "h2", "length").agg(F.min("p").alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    distinct = materialize(distinct, "lines")
    exact = slim.drop("keys").join(distinct.where("n > 1").select("h", "h2", "length", "first"), ["h", "h2", "length"]).where("p <> first").select("p.*", F.lit(False).alias("near"))
    keyed = distinct.select("first", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    wanted = keyed.join(shared, "key").select("first").distinct().groupBy("first.d", "first.th").agg(F.collect_set("first.no").alias("numbers"))
    # the whole documents go through one exchange, for these lines here and for the result
    texts = docs.join(wanted, ["d", "th"]).select("d", "th", F.split("text", "\n").alias("all"), F.explode("numbers").alias("no"))
    candidates = texts.select(place.alias("p"), F.element_at("all", F.col("no") + 1).alias("line")).withColumn("length", F.length("line")).distinct()
    links = _near_links(candidates)
    one, other = candidates.select("p", "line"), candidates.select(F.col("p").alias("first"), F.col("line").alias("earlier"))
    near = links.join(one, "p").join(other, "first").where(F.levenshtein("line", "earlier", 1) >= 0).select("p").distinct().select("p.*", F.lit(True).alias("near"))
    # a near line's own repetitions are exact ones of its first place
    return exact.union(near)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(id, n_lines, n_exact, n_near, text), one row per row of docs; text holds the kept lines in order.

    A line goes if an earlier line of the corpus is equal, or is within one edit, lines of any length alike; earlier means
    a smaller id, then a smaller hash of the text, then a smaller number; a null id is smallest. Lines without a word stay.
    min_chars is for callers who want shorter lines compared by equality alone. Repeated rows are one document and keep the same lines. Null text stays null and has no lines. Empty table: no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    own = own.select("id", F.coalesce("id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("th"), "text")
    whole = own.select("d", "th", "text")
    gone = dropped_lines(whole, min_chars).distinct().groupBy("d", "th").agg(F.collect_list(F.struct("no", "near")).alias("gone"))
    joined = whole.join(gone, ["d", "th"], "left")
    parts = F.split("text", "\n")
    numbers = F.coalesce(F.transform("gone", lambda x: x["no"]), F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(1), F.size(parts)), F.transform(numbers, lambda x: x + 1))
    text = F.when(F.size(numbers) == 0, F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(parts, i)), "\n"))
    near = F.coalesce(F.size(F.filter("gone", lambda x: x["near"])), F.lit(0))
    return joined.select(
        F.when(F.col("d") != -(1 << 63), F.col("d")).alias("id"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        (F.size(numbers) - near).cast("long").alias("n_exact"),
        near.cast("long").alias("n_near"),
        F.when(F.col("text").isNotNull(), text).alias("text"),
    )
