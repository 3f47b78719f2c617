"""Mixing sources to target weights by systematic sampling.

Targets: sources share the total size by weight, none above `cap` times its own size; what one can't take is reshared by
weight among the others. Sampling: within a source every document expects target / source size copies. Documents stand
in order of size, so that copies are spread over all sizes alike; the running sum of expected copies plus one random
offset crosses an integer for each copy to emit.

A source's order is cut into cells (by the leading bits of the size, then by a hash of the id), whose counts are summed
first. A row's place is its place in its cell plus the rows of earlier cells: no task holds a source's documents. Sizes
are counted once, into a table without texts; texts are met again only by who wants them, in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.llm.common import materialize, word_count

WEIGHTS, CAP, SEED = (5, 2, 1), 3, 17


def _size_class(size: Column) -> Column:
    """A number that grows with size: its bits and the four leading ones; about 8 classes to an octave."""
    bits = F.length(F.bin(size))
    return (bits * 16 + F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0)))).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources(key, source, source_size), one row each -> the same with target. Weights repeat over the sources in code
    point order, null last. A source of size 0 gets 0."""
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sources.withColumn("r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = ranked.withColumn("weight", F.element_at(cycle, (F.col("r") - 1) % len(weights) + 1)).withColumn("limit", cap * F.col("source_size"))
    # sources reach their limit in the order of limit / weight; `level` is what a unit of weight would get from there on
    order = Window.orderBy(F.col("limit") / F.col("weight"), "r")
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - (F.sum("limit").over(order) - F.col("limit"))
    filled = w.withColumn("level", left / (F.sum("weight").over(everything) - (F.sum("weight").over(order) - F.col("weight"))))
    full = F.col("limit") <= F.col("level") * F.col("weight")
    level = F.min(F.when(~full, F.struct(F.col("limit") / F.col("weight"), "r", "level"))).over(everything)["level"]
    return filled.select("key", "source", "source_size", F.when(full, F.col("limit").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def allot(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """(id, text_hash, key, size, source_size, target, copies, taken), one row per row of docs, without texts.

    A null source is a source of its own, null text has size 0. Repeated rows are documents of their own. Long texts are
    counted whole, once. Empty table: no rows. The offset depends on seed and source alone, so reruns agree.
    """
    id_, text_hash, key = _row_key(docs, id_col, text_col, source_col)
    # ids in a stride, or none, still fill all slots
    slot = F.conv(F.substring(F.md5(F.coalesce(docs[id_col].cast("string"), docs[text_col].cast("string"), F.lit("")).cast("binary")), 1, 2), 16, 10).cast("int")
    rows = docs.select(id_.alias("id"), text_hash.alias("text_hash"), key.alias("key"), word_count(docs[text_col]).alias("size"), slot.alias("slot"))
    rows = materialize(rows.withColumn("class", _size_class(F.col("size"))), "mix-sizes")
    cell = ["key", "class", "slot"]
    cells = rows.groupBy(*cell).agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    sources = cells.groupBy("key").agg(F.sum("s").alias("source_size")).select("key", F.when(F.col("key") != "n", F.substring("key", 2, 1 << 30)).alias("source"), "source_size")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    of_source = targets(sources, weights, cap).select("key", "source_size", "target", offset.alias("offset"))
    earlier = F.sum("n").over(Window.partitionBy("key").orderBy(F.col("class").desc(), "slot")) - F.col("n")
    placed = cells.select(*cell, earlier.alias("before")).join(of_source, "key")
    at = F.row_number().over(Window.partitionBy(*cell).orderBy(F.col("id").asc_nulls_first(), "size"))
    joined = rows.withColumn("at", at).join(placed, cell)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("before") + F.col("at")
    copies = (F.floor(rate * place + F.col("offset")) - F.floor(rate * (place - 1) + F.col("offset"))).cast("long")
    return joined.select("id", "text_hash", "key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _row_key(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[Column, Column, Column]:
    return docs[id_col].cast("long"), F.xxhash64(docs[text_col]), F.coalesce(F.concat(F.lit("s"), docs[source_col].cast("string")), F.lit("n"))


def _allotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(row: docs' columns as a struct, size, source_size, target, copies), one row per row of docs.

    Rows equal in id, text and source are numbered among themselves and share their copies, none getting two more than another.
    """
    same = ["id", "text_hash", "key"]
    of = materialize(allot(docs, id_col, text_col, source_col, **options), "mix-copies").groupBy(*same)
    of = of.agg(F.count("*").alias("rows"), F.sum("copies").alias("total"), *[F.first(c).alias(c) for c in ("size", "source_size", "target")])
    keys = _row_key(docs, id_col, text_col, source_col)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[k.alias(n) for k, n in zip(keys, same, strict=True)])
    number = F.lit(1)
    # equal rows apart, a row's place follows from its other columns, on any partitioning
    rows = rows.withColumn("whole", F.xxhash64(F.to_json("row")))
    if not of.where("rows > 1").isEmpty():
        number = F.row_number().over(Window.partitionBy(*same).orderBy("whole"))
    rows = rows.withColumn("number", number).drop("whole").withColumn("none", F.col("id").isNull()).withColumn("id", F.coalesce("id", F.lit(0).cast("long")))
    of = of.withColumn("none", F.col("id").isNull()).withColumn("id", F.coalesce("id", F.lit(0).cast("long")))
    each = F.floor(F.col("total") / F.col("rows"))
    copies = each + (F.col("number") <= F.col("total") - each * F.col("rows")).cast("long")
    return rows.join(of, [*same, "none"]).select("row", "size", "source_size", "target", copies.alias("copies"))


def plan(docs: DataFrame, **options) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_copies and mix_taken, as allot() has them; columns of these
    names are replaced, all others pass through. Nulls, repeats, long texts and empty tables: as in allot()."""
    new = {"mix_size": F.col("size"), "mix_source_size": F.col("source_size"), "mix_target": F.col("target"), "mix_copies": F.col("copies"), "mix_taken": F.col("copies") * F.col("size")}
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in new]
    return _allotted(docs, **options).select(*own, *[v.alias(k) for k, v in new.items()])


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it. Columns of any name pass through; all else as in allot()."""
    taken = _allotted(docs, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*[F.col("row")[c].alias(c) for c in docs.columns])
