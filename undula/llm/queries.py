"""The registered queries of this folder; each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm import bond, ctw, decontam, fertility, linededup, mixing, prefixtrie, quotes, simhash, tokencount, tokenfile, toxicity, warc
from undula.llm.common import materialize, scratch_path, table
from undula.llm.tokens import vocabulary_path


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_exact", "n_near", F.octet_length("text").cast("long").alias("kept_bytes"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op9_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fertility.verdicts(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "entropy", "top_share")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    read = warc.read_archives(spark, path)
    # of a response, length and digest are those of the payload that was read
    seen = F.when(F.col("record_type") == "response", F.sha1("payload"))
    records = materialize(read.select("page_id", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), seen.alias("sha1")), "warc-read")
    found = warc.resolve_revisits(records)
    digest = F.when(F.col("sha1").isNull(), F.col("payload_digest")).otherwise(warc.base32(F.col("sha1")))
    return found.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allot(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = tokenfile.write(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), vocabulary_path("word_bpe_49k.json"))
    return tokenfile.read(spark, file).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = materialize(prefixtrie.sequences(table(spark, sf_dir, "conversations")), "conversations")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return prefixtrie.trie(prefixtrie.spliced(convs, F.col("conv_id") - F.col("conv_id") % 100, head))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # a null doc_id counts as an empty one, which is held out
    learns = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0
    found = ctw.scores(docs, learns)
    return found.select(F.col("id").alias("doc_id"), (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_mixing": op2_mixing,
    "op3_quotation_links": op3_quotation_links,
    "op4_token_file": op4_token_file,
    "op5_decontamination": op5_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_fertility": op9_fertility,
    "op10_simhash": op10_simhash,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_language_model": op13_language_model,
}
ORACLE_SQL: dict[str, str] = {
    "op1_warc_revisits": """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as d, max(page_id) over (partition by coalesce(html, '')) as last
  from pages
), b as (
  select *, [('0x' || substr(d, 10 * k + 1, 10))::bigint for k in range(4)] as v from p
)
select page_id, payload_bytes::bigint as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((v[1 + i // 8] >> (35 - 5 * (i % 8))) & 31))::int, 1) for i in range(32)], '') as payload_digest,
  case when page_id is not distinct from last then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from last then last end as refers_to
from b""",
    "op3_quotation_links": r"""
with recursive m as (
  select distinct conv_id as conv, turn, text, regexp_matches(text, '(?m)^[ \t]*>') as quotes from conversations where conv_id is not null and turn is not null and text is not null
), lines as (
  select conv, turn, text, unnest(range(1, len(l) + 1)) as i, unnest(l) as line from (select *, string_split(text, chr(10)) as l from m where quotes)
), cut as (
  select conv, turn, text, i, len(p) - len(replace(p, '>', '')) as level, substr(line, len(p) + 1) as said from (select *, regexp_extract(line, '^[ \t]*(?:>[ \t]?)+') as p from lines)
), marked as (
  select *, trim(regexp_replace(said, '\s+', ' ', 'g')) = '' as blank from cut
), opened as (
  select *, (level <> lag(level, 1, -1) over (partition by conv, turn, text order by i) or blank)::int as opens from marked
), numbered as (
  select *, sum(opens) over (partition by conv, turn, text order by i) as number from opened
), spoken as (
  select conv, turn, 0 as level, unnest(regexp_split_to_array(text, '\n[ \t\r]*(?:\n[ \t\r]*)+')) as said from m where not quotes
  union all select conv, turn, level, string_agg(said, chr(10) order by i) from numbered where not blank group by conv, turn, text, number, level
), passages as (
  select distinct conv, turn, level, lower(trim(regexp_replace(said, '\s+', ' ', 'g'))) as passage from spoken
), quoted as (
  select * from passages where level > 0 and passage <> ''
), texts as (
  select conv, turn, 'own' as of, array_to_string([x for x in string_split(text, chr(10)) if not regexp_matches(x, '^[ \t]*>')], chr(10)) as said from m
  union all select distinct null, null, 'quotation', said from spoken where level > 0
), units as (
  select conv, turn, of, 0 as kind, string_split(regexp_replace(regexp_replace(said, '([.!?])\s+', '\1' || chr(1), 'g'), '\n[ \t\r]*\n', chr(1), 'g'), chr(1)) as u from texts
  union all select conv, turn, of, 1, string_split(said, chr(10)) from texts
), plain as (
  select conv, turn, of, kind, [lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) for x in u if trim(regexp_replace(x, '\s+', ' ', 'g')) <> ''] as u from units
), begins as (
  select distinct kind, u[1] as unit, len(u) as k from plain where of = 'quotation' and len(u) > 0
), runs as (
  select distinct conv, turn, array_to_string(u[pos : pos + k - 1], ' ') as passage from (select *, unnest(range(1, len(u) + 1)) as pos from plain where of = 'own') o
  join begins b on b.kind = o.kind and b.unit = o.u[o.pos] and pos + k - 1 <= len(u)
), said as (
  select conv, turn, passage from passages where level = 0 and passage in (select passage from quoted)
  union select conv, turn, passage from runs where passage in (select passage from quoted)
), origin as (
  select q.conv, q.turn, q.level, q.passage, max(s.turn) filter (where s.conv = q.conv and s.turn < q.turn) as near, min({'c': s.conv, 't': s.turn}) as first
  from quoted q left join said s on s.passage = q.passage group by all
), links as (
  select conv, turn, level, case when near is not null then conv when first.c <> conv then first.c end as from_conv, case when near is not null then near when first.c <> conv then first.t end as from_turn from origin
), per as (
  select conv, turn, count(*) as n_quotes, count(from_turn) as n_linked,
    max({'own': from_conv = conv, 't': from_turn, 'c': -from_conv}) filter (where level = 1 and from_turn is not null) as reply from links group by conv, turn
), replies as (
  select conv, turn, reply.t as up from per where -reply.c = conv
), chain as (
  select conv, turn, up as thread, 1 as depth from replies
  union all select c.conv, c.turn, r.up, c.depth + 1 from chain c join replies r on r.conv = c.conv and r.turn = c.thread
), roots as (
  select conv, turn, arg_max(thread, depth) as thread, max(depth) as depth from chain group by conv, turn
)
select c.conv_id, c.turn, c.role, coalesce(n_quotes, 0) as n_quotes, coalesce(n_linked, 0) as n_linked, -reply.c as reply_to_conv, reply.t as reply_to_turn,
  coalesce(roots.thread, c.turn) as thread_turn, coalesce(roots.depth, 0)::bigint as depth,
  case when c.text is not null then array_to_string([x for x in string_split(c.text, chr(10)) if not regexp_matches(x, '^[ \t]*>')], chr(10)) end as body
from conversations c left join per on per.conv = c.conv_id and per.turn = c.turn left join roots on roots.conv = c.conv_id and roots.turn = c.turn""",
    "op2_mixing": """
with d as (
  select doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents
), c as (
  select *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) as class from d
), s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as r from d group by source
), w as (
  select *, [5, 2, 1][(r - 1) % 3 + 1] as weight, 3 * source_size as cap from s
), f as (
  select *, (sum(source_size) over ()::double - (sum(cap) over o - cap)::double) / (sum(weight) over () - (sum(weight) over o - weight))::double as level
  from w window o as (order by cap::double / weight, r)
), t as (
  select source, source_size,
    case when cap <= level * weight then cap::double
      else weight * (select arg_min(level, cap::double / weight) from f where cap > level * weight) end as target,
    ('0x' || substr(md5('17:' || coalesce('s' || source, 'n')), 1, 8))::bigint / 4294967296.0::double as u
  from f
), n as (
  select c.*, row_number() over (partition by source order by class desc, ('0x' || substr(md5(coalesce(doc_id::varchar, text, '')), 1, 2))::int, doc_id nulls first, size) as place from c
), x as (
  select n.doc_id, n.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate, n.place, t.u
  from n join t on n.source is not distinct from t.source
)
select doc_id, size, source_size, target, ((floor(rate * place + u) - floor(rate * (place - 1) + u)) * size)::bigint as taken from x""",
    "op5_decontamination": r"""
with i as (
  select item_id, regexp_extract_all(lower(text), '[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+') as w from benchmark where text is not null
), n as (
  select item_id, w, least(5, len(w)) as k from i where len(w) > 0
), s as (
  select distinct item_id, k, unnest([array_to_string(w[a:a + k - 1], ' ') for a in range(1, len(w) - k + 2)]) as g from n
), d as (
  select doc_id, regexp_extract_all(lower(text), '[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+') as w from documents where text is not null
), x as (
  select distinct doc_id, k, unnest([array_to_string(w[a:a + k - 1], ' ') for a in range(1, len(w) - k + 2)]) as g from d, (select distinct k from n)
), c as (
  select doc_id, item_id, count(*) as shared from x join s using (k, g) group by all
)
select doc_id, item_id, size::int as item_shingles, shared::int as shared, shared / size as containment
from c join (select item_id, count(*) as size from s group by item_id) using (item_id) where shared >= 0.8::double * size""",
    "op11_hard_negatives": """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as q
  from embeddings where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as alike, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), p as (
  select anchor_id, id as positive_id, score as positive_score from s where alike qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select anchor_id, positive_id, (row_number() over w)::int as rank, id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not alike and 80 * positive_score <= 100 * score and score <= positive_score
window w as (partition by anchor_id, positive_id order by score desc, id) qualify row_number() over w <= 5""",
    "op12_prefix_trie": """
with t as (
  select conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest, turn, length(coalesce(text, '')) as chars from conversations where conv_id is not null
), own as (
  select conv_id, list({'d': digest, 'c': chars} order by turn nulls first, digest) as turns from t group by conv_id
), heads as (
  select *, conv_id::varchar as name, conv_id - conv_id % 100 as source from own
), coded as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, [ascii(x)::bigint for x in string_split(name, '')]),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)), 4294967295) % 6 as h
  from heads
), built as (
  select c.conv_id, list_concat(coalesce(b.turns, []), [])[1:c.h] || c.turns[c.h + 1:] as turns from coded c left join own b on b.conv_id = c.source
), members as (
  select conv_id, len(turns) as length, unnest(range(0, len(turns) + 1)) as depth, turns from built
), keyed as (
  select conv_id, length, depth, md5(array_to_string([x.d for x in turns[1:depth]], '')) as node, case when depth > 0 then md5(array_to_string([x.d for x in turns[1:depth - 1]], '')) end as up, case when depth > 0 then turns[depth].c else 0 end as chars from members
), nodes as (
  select depth, node, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(chars) as saved, max(length) = depth as leaf,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where length = depth), '')) as ends_sha256 from keyed group by depth, node
), below as (
  select k.depth, k.node, sum(n.saved) as saved_tokens, sum(n.leaf::int) as n_leaves from nodes n join (select distinct b.node as low, b.depth as low_depth, a.node, a.depth from keyed a join keyed b on a.conv_id = b.conv_id and a.depth <= b.depth) k on n.node = k.low and n.depth = k.low_depth group by all
), children as (
  select up as node, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by all
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children, b.n_leaves::bigint as n_leaves, b.saved_tokens::bigint as saved_tokens, n.ends_sha256
from nodes n join below b using (depth, node) left join children c on c.node = n.node and c.depth = n.depth left join nodes p on p.node = n.up and p.depth = n.depth - 1""",
}
