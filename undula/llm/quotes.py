"""Quotation linking in conversations. DataFrame functions only.

A line's quote level is the number of `>` before it. Lines of one level in a row, up to a blank line, make a passage; it
is normalised (case, white space, and so any re-wrapping) and hashed. Passages of level 0 are what a message says
itself; quoted ones are joined to the messages that say the same: the last one before in the conversation, else the
first one anywhere. A message replies to the latest message of its conversation that it quotes at level 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.llm.common import materialize, sent_if_small

QUOTED = r"^[ \t]*>"
SENTENCE_END = r"(?<=[.!?])\s+|\n[ \t\r]*\n"
_PREFIX = r"^[ \t]*(?:>[ \t]?)+"
#: Runs are hashed modulo a prime whose products fit in 64 bits, with two bases and two hashes of a unit.
MODULUS = 2**31 - 1
BASES = (1_402_946_723, 1_911_520_717)


def _hashes(text: Column) -> Column:
    plain = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.when(plain != "", F.struct(F.xxhash64(plain).alias("a"), F.xxhash64(F.lit(1), plain).alias("b")))


def spoken(messages: DataFrame) -> DataFrame:
    """messages(conv, turn, text), distinct -> (conv, turn, level, said: the passage's lines), a row for each passage."""
    key = ["conv", "turn", "text"]
    plain = messages.where(~F.col("text").rlike(f"(?m){QUOTED}"))
    own = plain.select("conv", "turn", F.lit(0).alias("level"), F.explode(F.split("text", r"\n[ \t\r]*(?:\n[ \t\r]*)+")).alias("said"))
    lines = messages.where(F.col("text").rlike(f"(?m){QUOTED}")).select(*key, F.posexplode(F.split("text", "\n")).alias("i", "line"))
    prefix = F.regexp_extract("line", _PREFIX, 0)
    cut = lines.select(*key, "i", (F.length(prefix) - F.length(F.replace(prefix, F.lit(">"), F.lit("")))).alias("level"), F.substring("line", F.length(prefix) + 1, F.length("line")).alias("said"))
    # a message's lines are one row's text, so its window is as large as that row
    w = Window.partitionBy(*key).orderBy("i")
    blank = F.trim(F.regexp_replace("said", r"\s+", " ")) == ""
    opens = (F.col("level") != F.lag("level", 1, -1).over(w)) | blank
    marked = cut.withColumn("number", F.sum(opens.cast("int")).over(w)).where(~blank)
    joined = marked.groupBy(*key, "number", "level").agg(F.array_sort(F.collect_list(F.struct("i", "said"))).alias("of"))
    quoted = joined.select("conv", "turn", "level", F.array_join(F.transform("of", lambda x: x["said"]), "\n").alias("said"))
    return own.union(quoted)


def passages(messages: DataFrame) -> DataFrame:
    """As spoken, with a passage's two 64-bit hashes in place of its lines; those without a word are left out."""
    return spoken(messages).select("conv", "turn", "level", _hashes(F.col("said")).alias("passage")).where("passage is not null")


def _body(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(QUOTED)), "\n")


def _units(text: Column) -> Column:
    """The text's sentences (which end with a mark or a blank line) and its lines: two arrays of normalised, non-empty strings."""
    plain = lambda parts: F.filter(F.transform(parts, lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))), lambda x: x != "")
    return F.array(plain(F.split(text, SENTENCE_END)), plain(F.split(text, "\n")))


def _power(base: int, exponent: Column) -> Column:
    """base ** exponent modulo MODULUS for exponents under 2^32, from one table for each byte of the exponent."""
    out = F.lit(1).cast("long")
    for shift in range(0, 32, 8):
        table = ", ".join(f"{pow(base, byte << shift, MODULUS)}L" for byte in range(256))
        out = (out * F.expr(f"array({table})")[F.shiftright(exponent, shift).bitwiseAND(255)]) % MODULUS
    return out


def _residues(x: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), x), F.lit(MODULUS)) for seed in range(len(BASES))]


def _rolled(units: Column) -> Column:
    """For each base the sum of residue times base ** place, by Horner's rule from the last unit."""
    rule = lambda i, base: F.aggregate(F.reverse(units), F.lit(0).cast("long"), lambda acc, x: (acc * base + _residues(x)[i]) % MODULUS)
    return F.array(*[rule(i, base) for i, base in enumerate(BASES)])


def runs(messages: DataFrame) -> DataFrame:
    """messages(conv, turn, text), distinct -> (conv, turn, passage) of the runs of sentences or lines that are a
    quotation's.

    A run is hashed from the sums of its message's units up to its two ends, so a place and a length cost one row however
    long the run is; places meet the lengths of quotations that begin with their unit, and no pairs of messages are made.
    A run counts where kind, first unit (64 bits), length and both rolled residues (62 bits) are the quotation's.
    """
    kinds = F.posexplode(_units(F.col("said"))).alias("kind", "units")
    quotes = spoken(messages).where("level > 0").select("said").distinct().select(_hashes(F.col("said")).alias("passage"), kinds).where("size(units) > 0 and passage is not null")
    quotes = materialize(quotes.select("passage", "kind", F.xxhash64(F.col("units")[0]).alias("unit"), F.size("units").alias("k"), _rolled(F.col("units")).alias("rolled")).distinct(), "quotations")
    begins = sent_if_small(materialize(quotes.groupBy("kind", "unit").agg(F.collect_set("k").alias("lengths")), "quote-begins"), 100_000)

    of = ["conv", "turn", "th", "kind"]
    own = messages.select("conv", "turn", F.xxhash64("text").alias("th"), F.posexplode(_units(_body(F.col("text")))).alias("kind", "units"))
    at = own.select(*of, F.posexplode("units").alias("pos", "x"))
    hashed = at.select(*of, "pos", F.xxhash64("x").alias("unit"), *[r.alias(f"r{i}") for i, r in enumerate(_residues(F.col("x")))])
    # only the units of messages that a quotation begins in are shuffled
    begun = materialize(hashed.join(begins, ["kind", "unit"], "left_semi").select(*of).distinct(), "quote-starts")
    upto = Window.partitionBy(*of).orderBy("pos")
    weighed = hashed.join(sent_if_small(begun), of, "left_semi")
    for i, base in enumerate(BASES):
        weighed = weighed.withColumn(f"r{i}", (F.col(f"r{i}") * _power(base, F.col("pos"))) % MODULUS)
    sums = [F.sum(f"r{i}").over(upto).alias(f"upto{i}") for i in range(len(BASES))]
    sums = materialize(weighed.select(*of, "pos", "unit", *[f"r{i}" for i in range(len(BASES))], *sums), "quote-sums")
    starts = sums.join(begins, ["kind", "unit"]).select(*of, "pos", "unit", *[(F.col(f"upto{i}") - F.col(f"r{i}")).alias(f"before{i}") for i in range(len(BASES))], F.explode("lengths").alias("k"))
    ends = sums.select(*of, F.col("pos").alias("last"), *[f"upto{i}" for i in range(len(BASES))])
    spans = starts.withColumn("last", F.col("pos") + F.col("k") - 1).join(ends, [*of, "last"])
    shifted = [(F.pmod(F.col(f"upto{i}") - F.col(f"before{i}"), F.lit(MODULUS)) * _power(pow(base, -1, MODULUS), F.col("pos"))) % MODULUS for i, base in enumerate(BASES)]
    said = spans.select("conv", "turn", "kind", "unit", "k", F.array(*shifted).alias("rolled")).distinct()
    return said.join(sent_if_small(quotes, 100_000), ["kind", "unit", "k", "rolled"]).select("conv", "turn", "passage").distinct()


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, passage, from_conv, from_turn) for each distinct quoted passage; from_* null if nobody says it."""
    found = materialize(passages(messages).distinct(), "passages")
    quoted = found.where("level > 0")
    own = found.where("level = 0").drop("level").union(runs(messages)).distinct()
    said = own.join(quoted.select("passage").distinct(), "passage")
    # within the conversation: the last sayer before the quoting turn, by one sorted pass, without pairs
    both = said.select("conv", "passage", "turn", F.lit(0).alias("level"), F.col("turn").alias("origin")).unionByName(quoted.select("conv", "passage", "turn", "level", F.lit(None).cast("long").alias("origin")))
    before = Window.partitionBy("conv", "passage").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("from_turn", F.max("origin").over(before)).where("level > 0").drop("origin")
    first = said.groupBy("passage").agg(F.min(F.struct("conv", "turn")).alias("first"))
    linked = near.join(first, "passage", "left")
    same = F.col("from_turn").isNotNull()
    elsewhere = F.col("first").isNotNull() & ~F.col("first.conv").eqNullSafe(F.col("conv"))
    return linked.select("conv", "turn", "level", "passage", F.when(same, F.col("conv")).when(elsewhere, F.col("first.conv")).alias("from_conv"), F.when(same, F.col("from_turn")).when(elsewhere, F.col("first.turn")).alias("from_turn"))


def _threads(replies: DataFrame) -> DataFrame:
    """replies(conv, turn, reply_to) -> (conv, turn, thread, depth): the message that the chain of replies starts from, by
    pointer doubling: as many rounds as the longest chain has binary digits."""
    t = materialize(replies.select("conv", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = t.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("up"), F.col("depth").alias("more"))
        joined = t.join(up, (F.col("conv") == F.col("c")) & (F.col("thread") == F.col("t")), "left")
        if joined.where("up is not null").isEmpty():
            return t
        t = materialize(joined.select("conv", "turn", F.coalesce("up", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "threads")


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per row of messages: conv_id, turn, role, n_quotes, n_linked, reply_to_conv, reply_to_turn, thread_turn, depth,
    body. Reply order is (conv_id, thread_turn, turn): a thread's messages stand together, oldest first.

    n_quotes counts distinct quoted passages and levels, n_linked those with an origin: a message that says the passage, or
    its sentences or its lines in a row. Long texts are read whole. reply_to_* is the latest origin at
    level 1, in the own conversation if there is one, else elsewhere; threads follow replies within a conversation only. body is the text
    without quoted lines (null stays null). Rows with equal conversation and turn are one message to quote, and each gets
    the links of both; a null conversation or turn is never linked and is its own thread. Empty table: no rows.
    """
    m = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    links = materialize(link_quotes(m.where("conv is not null and turn is not null and text is not null").select("conv", "turn", "text").distinct()), "quote-links")
    direct = F.when((F.col("level") == 1) & F.col("from_turn").isNotNull(), F.struct((F.col("from_conv") == F.col("conv")).alias("own"), F.col("from_turn").alias("t"), (-F.col("from_conv")).alias("c")))
    per = links.groupBy("conv", "turn").agg(F.count("*").alias("n_quotes"), F.count("from_turn").alias("n_linked"), F.max(direct).alias("reply"))
    per = per.select("conv", "turn", "n_quotes", "n_linked", (-F.col("reply.c")).alias("reply_to_conv"), F.col("reply.t").alias("reply_to_turn"))
    threads = _threads(per.where("reply_to_conv = conv").select("conv", "turn", F.col("reply_to_turn").alias("reply_to")))
    known = per.join(threads, ["conv", "turn"], "left")
    body = F.when(F.col("text").isNotNull(), _body(F.col("text")))
    rows = m.withColumn("body", body).drop("text").join(known, ["conv", "turn"], "left")
    zero = F.lit(0).cast("long")
    return rows.select(F.col("conv").alias("conv_id"), "turn", "role", F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"), "reply_to_conv", "reply_to_turn", F.coalesce("thread", "turn").alias("thread_turn"), F.coalesce("depth", zero).alias("depth"), "body")
