"""The registered queries of the signal operators, each with the SQL that must give the same rows.

Floating results are rounded to six digits, as sums in another order differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.functions import itr
from undula.functions.scalars import even_samples
from undula.operators import inject, montage, quality, reject, signal, stats
from undula.plans import sweep
from undula.sources import adapters
from undula.sources.adapters import FS, HOURS, events_recording

FLAGSHIP = "enova_epoch"
LEVELS, LOWCUT = 6, 0.5
THRESHOLDS = [round(0.01 * k, 2) for k in range(11)]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


# Common parts of the SQL side -------------------------------------------------------------------------------------

REC = """
cells as (select event_type as ch, date_diff('hour', timestamp '2024-01-01', ts) as i, avg(value) as v from events group by all),
rec as (select 'events' as rec, g.ch, h.i::bigint as i, coalesce(c.v, 0) as v from (select distinct ch from cells) g cross join range(720) h(i)
  left join cells c on c.ch = g.ch and c.i = h.i),
idx as (select ch, row_number() over (order by ch) - 1 as ch_idx from (select distinct ch from rec))
"""


def levels_sql(source: str, upto: int, name: str = "a") -> str:
    """The smooths by array arithmetic over whole channels: another way than the window form."""
    out = [f"{name}0 as (select rec, ch, list(v order by i) as x from {source} group by all)"]
    for j in range(1, upto + 1):
        k = 2 ** (j - 1)
        out.append(f"{name}{j} as (select rec, ch, [x[t + 1] / 2 + x[(t - {k} + 720) % 720 + 1] / 4 + x[(t + {k}) % 720 + 1] / 4 for t in range(720)] as x from {name}{j - 1})")
    return ",\n".join(out)


def flat_sql(name: str) -> str:
    return f"(select rec, ch, unnest(range(720)) as i, unnest(x) as v from {name})"


PARTS = REC + "," + levels_sql("rec", 1) + f", parts as (select r.rec, r.ch, r.i, a.v as clean, r.v - a.v as noise from rec r join {flat_sql('a1')} a using (rec, ch, i))"
TRIPLE = (
    REC
    + """, cor as (select rec, ch, i, v as ref, v + 20.0::double * (1 + 0.1::double * ch_idx) * sin(2 * pi() * 9 / 24 * i + ch_idx) as v from rec join idx using (ch)),
"""
    + levels_sql("cor", 1, "c")
    + f", triple as (select r.rec, r.ch, r.i, r.ref, r.v as cor, a.v as cln from cor r join {flat_sql('c1')} a using (rec, ch, i))"
)
SWEEP = """
sweep as (select l_returnflag as dataset, l_suppkey as subject, round(l_discount, 2) as thr, avg(l_quantity / 50) as ba_rej, avg(1 - l_tax * 5) as ba_rec,
  100 * (1 - round(l_discount, 2) * 5) as pct_retained from lineitem group by all)
"""
EPOCH = "select rec, i // 24 as epoch, case when var_pop(clean + noise) > 0 then var_pop(noise) / var_pop(clean + noise) else 0 end as enova from parts group by all"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal.smooth_levels(events_recording(spark, sf_dir), HOURS, 1)
    return s.select("rec", "ch", "i", F.col("a1").alias("clean"), (F.col("v") - F.col("a1")).alias("noise"))


def triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = adapters.with_index(events_recording(spark, sf_dir))
    cor = rec.select("rec", "ch", "i", F.col("v").alias("ref"), (F.col("v") + adapters.line_noise()).alias("v"))
    return signal.smooth_levels(cor, HOURS, 1).select("rec", "ch", "i", "ref", F.col("v").alias("cor"), F.col("a1").alias("cln"))


def enova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.enova_per_epoch(parts(spark, sf_dir), FS, HOURS)


# Shapes -----------------------------------------------------------------------------------------------------------


@register(f"with {REC} select rec, ch, i, round(v, 6) as v from rec")
def grid_events(spark, sf_dir):
    return events_recording(spark, sf_dir).select("rec", "ch", "i", *r6("v"))


@register(f"with {REC} select rec, ch, i, i // 50 as epoch, i % 50 as k, round(v, 6) as v from rec where i < 700")
def epoch_reshape(spark, sf_dir):
    e = signal.to_epochs(events_recording(spark, sf_dir), 50, drop_tail=True)
    return signal.from_epochs(e, 50).join(e.select("rec", "ch", "i", "epoch", "k"), ["rec", "ch", "i"]).select("rec", "ch", "i", "epoch", "k", *r6("v"))


@register(f"with {REC} select rec, ch, i, round(v, 6) as v from rec union all select rec, ch, 1439 - i, round(v, 6) from rec where i >= 690")
def even_epoch_pad(spark, sf_dir):
    return signal.mirror_pad(events_recording(spark, sf_dir), even_samples(2.08, FS)).select("rec", "ch", "i", *r6("v"))


@register("""with u as (select user_id as rec, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value as v from events),
n as (select min(m) as stop from (select max(i) as m from u group by rec)) select rec, i, round(v, 6) as v from u, n where i <= stop""")
def crop_common(spark, sf_dir):
    return signal.crop_common(adapters.user_recordings(spark, sf_dir)).select("rec", "i", *r6("v"))


@register(f"with {REC} select ch, count(*) as n, round(sum(v), 4) as total from rec where not contains(upper(ch), 'ERR') group by ch")
def channel_select(spark, sf_dir):
    return signal.select_channels(events_recording(spark, sf_dir), "err").groupBy("ch").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@register("select vec_id as trial, case label when 1 then 1 when 2 then 2 else 0 end as code from embeddings where label in (1, 2, 3) and code in (1, 2)")
def label_encode(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 2, 3))
    code = F.coalesce(F.element_at(F.create_map(F.lit(1), F.lit(1), F.lit(2), F.lit(2)), F.col("label")), F.lit(0))
    return e.select(F.col("vec_id").alias("trial"), code.alias("code")).where(F.col("code").isin(1, 2))


@register("""select vec_id as trial, label, row_number() over (partition by label order by (vec_id * 7919 + 42) % 10007, vec_id) <= 0.8::double * count(*) over (partition by label) as train
from embeddings""")
def strat_split(spark, sf_dir):
    from undula.operators.decode import stratified_split

    return stratified_split(adapters.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial"), "label"), 0.8)


# Reference --------------------------------------------------------------------------------------------------------


@register(f"with {REC} select rec, ch, i, round(v - sum(v) over (partition by rec, i) / (count(*) over (partition by rec, i) + 1), 6) as v from rec")
def avg_reference(spark, sf_dir):
    return signal.average_reference(events_recording(spark, sf_dir)).select("rec", "ch", "i", *r6("v"))


@register(f"""with {REC}, s as (select rec, i, abs(avg(v)) as a, abs(sum(v) / (count(*) + 1)) as b from rec group by all)
select rec, round(max(a), 6) as max_mean, round(max(b), 6) as max_ref, max(a) < 0.00001 or max(b) < 0.00001 as referenced from s group by rec""")
def avg_ref_check(spark, sf_dir):
    return signal.is_average_referenced(events_recording(spark, sf_dir)).select("rec", *r6("max_mean", "max_ref"), "referenced")


RBF = REC + """, pos as (select ch, cos(2 * pi() * ch_idx / count(*) over ()) as x, sin(2 * pi() * ch_idx / count(*) over ()) as y from idx),
pairs as (select p.ch as a, q.ch as b, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) as d from pos p, pos q),
rbf as (select a, b, exp(-(d ** 2) / (2 * (select median(d) from pairs where a <> b and d > 0) ** 2)) + case when a = b then 0.000001 else 0 end as g from pairs)"""


@register(f"with {RBF} select a, b, round(g, 6) as g from rbf")
def rbf_ref_cov(spark, sf_dir):
    return quality.rbf_covariance(adapters.ring_positions(events_recording(spark, sf_dir))).select("a", "b", *r6("g"))


@register(f"with {RBF} select a, b, round(0.95::double * g + case when a = b then 0.05::double * (select avg(g) from rbf where a = b) else 0 end, 6) as g from rbf")
def regularize_cov(spark, sf_dir):
    return quality.regularize(quality.rbf_covariance(adapters.ring_positions(events_recording(spark, sf_dir)))).select("a", "b", *r6("g"))


@register(f"with {REC} select p.rec, p.ch as a, q.ch as b, round(covar_samp(p.v, q.v), 6) as cov from rec p join rec q on p.rec = q.rec and p.i = q.i and p.ch <= q.ch group by all")
def channel_cov(spark, sf_dir):
    return quality.channel_covariance(events_recording(spark, sf_dir)).select("rec", "a", "b", *r6("cov"))


# Wavelets ---------------------------------------------------------------------------------------------------------

BANDS = REC + "," + levels_sql("rec", LEVELS) + ", bands as (" + " union all ".join(
    [f"select p.rec, p.ch, p.i, {j} as band, p.v - q.v as v from {flat_sql(f'a{j - 1}')} p join {flat_sql(f'a{j}')} q using (rec, ch, i)" for j in range(1, LEVELS + 1)]
    + [f"select rec, ch, i, {LEVELS + 1}, v from {flat_sql(f'a{LEVELS}')}"]
) + ")"


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.haar_bands(events_recording(spark, sf_dir), HOURS, LEVELS)


# the 1e-8 keeps values off the ties of rounding, which smooths of round numbers meet often
@register(f"with {BANDS} select rec, ch, i, band, round(v + 1e-8::double, 6) as v from bands")
def haar_band_k(spark, sf_dir):
    return bands(spark, sf_dir).select("rec", "ch", "i", "band", F.round(F.col("v") + 1e-8, 6).alias("v"))


@register(f"with {REC}, {levels_sql('rec', 5)} select r.rec, r.ch, r.i, round(r.v - a.v + 1e-8::double, 6) as v from rec r join {flat_sql('a5')} a using (rec, ch, i)")
def wavelet_highpass(spark, sf_dir):
    # bands 6 and 7 of seven end at or below 0.5
    return signal.wavelet_highpass(events_recording(spark, sf_dir), HOURS, FS, 0.4).select("rec", "ch", "i", F.round(F.col("v") + 1e-8, 6).alias("v"))


@register(f"with {BANDS} select rec, ch, band, round(var_pop(v), 6) as energy, round(12 / 2.0::double ** least(band - 1, 6), 6) as hi_hz from bands group by all")
def band_energy(spark, sf_dir):
    e = bands(spark, sf_dir).groupBy("rec", "ch", "band").agg(F.var_pop("v").alias("energy"))
    limits = signal.band_limits(e, FS, LEVELS).select((F.col("band") + 1).alias("band"), F.col("hi").alias("hi_hz"))
    return e.join(F.broadcast(limits), "band").select("rec", "ch", "band", *r6("energy", "hi_hz"))


# Noise share ------------------------------------------------------------------------------------------------------


@register(f"with {PARTS} select rec, epoch, round(enova, 6) as enova from ({EPOCH})")
def enova_epoch(spark, sf_dir):
    return enova(spark, sf_dir).select("rec", "epoch", *r6("enova"))


CHANNEL_ENOVA = "select rec, ch, avg(e) as enova from (select rec, ch, i // 24, case when var_pop(clean + noise) > 0 then var_pop(noise) / var_pop(clean + noise) else 0 end as e from parts group by all) group by all"


@register(f"with {PARTS} select rec, ch, round(enova, 6) as enova from ({CHANNEL_ENOVA})")
def enova_channel(spark, sf_dir):
    return signal.enova_per_channel(parts(spark, sf_dir), FS).select("rec", "ch", *r6("enova"))


@register(f"""with {BANDS}, e as (select b.rec, b.band, b.i // 24 as epoch, var_pop(b.v) as a, var_pop(r.v) as t from bands b join rec r using (rec, ch, i) group by all)
select rec, band, round(coalesce(avg(case when t > 0 then a / t end), 0), 6) as enova from e group by all""")
def enova_band(spark, sf_dir):
    s = signal.smooth_levels(events_recording(spark, sf_dir), HOURS, LEVELS)
    each = [F.struct(F.lit(j).alias("band"), (F.col(f"a{j - 1}") - F.col(f"a{j}")).alias("noise")) for j in range(1, LEVELS + 1)] + [F.struct(F.lit(LEVELS + 1).alias("band"), F.col(f"a{LEVELS}").alias("noise"))]
    b = s.select("rec", "ch", "i", "v", F.explode(F.array(*each)).alias("b")).select("rec", "ch", "i", "b.band", "b.noise", (F.col("v") - F.col("b.noise")).alias("clean"))
    return signal.enova_per_band(b, FS).select("rec", "band", *r6("enova"))


@register(f"""with {PARTS}, e as ({EPOCH}) select rec, round(avg(enova), 6) as mean, round(median(enova), 6) as median, round(stddev_pop(enova), 6) as std, round(min(enova), 6) as min,
round(max(enova), 6) as max, {', '.join(f'round(quantile_cont(enova, {p / 100}), 6) as p{p}' for p in (10, 25, 75, 90, 95))} from e group by rec""")
def enova_summary(spark, sf_dir):
    s = signal.summary(enova(spark, sf_dir), "enova", ["rec"])
    return s.select("rec", *r6(*[c for c in s.columns if c != "rec"]))


# Rejection --------------------------------------------------------------------------------------------------------

THR = 0.55


@register(f"""with {PARTS}, e as ({EPOCH}), k as (select r.*, row_number() over (partition by r.rec, r.ch order by i) - 1 as new_i from rec r left join e on r.rec = e.rec and r.i // 24 = e.epoch
where coalesce(round(enova, 9) <= {THR}::double, true)) select rec, ch, i, new_i, round(v, 6) as v from k""")
def reject_epochs(spark, sf_dir):
    e = enova(spark, sf_dir).withColumn("enova", F.round("enova", 9))
    return reject.reject_epochs(events_recording(spark, sf_dir), e, THR, FS).select("rec", "ch", "i", "new_i", *r6("v"))


@register(f"""with {PARTS}, e as ({EPOCH}), m as (select e.rec, 24 * epoch + k as i, (round(enova, 9) <= {THR}::double)::int as keep from e cross join range(24) t(k)),
d as (select *, keep - lag(keep, 1, 1) over (partition by rec order by i) as turn from m),
f as (select d.rec, d.i, d.keep, coalesce(min(c.i - 1 - d.i) filter (where c.turn = -1 and c.i > d.i and c.i <= d.i + 5), -1) as before,
  coalesce(min(d.i - c.i) filter (where c.turn = 1 and c.i <= d.i and c.i > d.i - 5), -1) as after from d join d c on c.rec = d.rec and c.i between d.i - 4 and d.i + 5 group by all)
select rec, i, keep, round(case when before >= 0 then (1 - cos(pi() * before / 4)) / 2 else 1 end * case when after >= 0 then (1 - cos(pi() * after / 4)) / 2 else 1 end, 6) as factor from f""")
def taper_edges(spark, sf_dir):
    e = enova(spark, sf_dir).withColumn("keep", (F.round("enova", 9) <= THR).cast("int"))
    samples = e.select("rec", "keep", F.explode(F.sequence(F.col("epoch") * FS, F.col("epoch") * FS + FS - 1)).alias("i"))
    return reject.taper_factors(samples, 5).select("rec", "i", "keep", *r6("factor"))


@register(f"with {REC}, d as (select rec, ch, v - lag(v) over (partition by rec, ch order by i) as d from rec) select rec, ch, round(stddev_pop(d), 6) as deviation, stddev_pop(d) < 0.0000001 as flat from d group by all")
def flat_channels(spark, sf_dir):
    return reject.flat_channels(events_recording(spark, sf_dir)).select("rec", "ch", *r6("deviation"), "flat")


BAD = f"{PARTS}, ce as ({CHANNEL_ENOVA}), bad as (select rec, ch, enova, round(enova, 9) > 0.5::double as bad from ce)"


def channel_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = signal.enova_per_channel(parts(spark, sf_dir), FS).withColumn("enova", F.round("enova", 9))
    return reject.bad_channels(e, reject.flat_channels(events_recording(spark, sf_dir)), 0.5)


@register(f"with {BAD} select rec, ch, round(enova, 6) as enova, false as flat, bad from bad")
def bad_channels(spark, sf_dir):
    return channel_verdicts(spark, sf_dir).select("rec", "ch", *r6("enova"), "flat", "bad")


@register(f"with {BAD} select rec, ch from bad where not bad")
def good_channels(spark, sf_dir):
    all_channels = events_recording(spark, sf_dir).select("rec", "ch").distinct()
    return reject.good_channels(all_channels, channel_verdicts(spark, sf_dir).where("bad"))


@register("""with p as (select distinct p_brand as name from part), t as (select n_nationkey as idx, 'Brand#' || n_nationkey as label from nation),
m as (select name, idx, label, row_number() over (partition by name order by (lower(name) <> lower(label))::int, idx) as r from p join t on contains(lower(name), lower(label)) or contains(lower(label), lower(name)))
select name, idx, label from m where r = 1""")
def channel_name_match(spark, sf_dir):
    names = adapters.table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    template = adapters.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), F.concat(F.lit("Brand#"), F.col("n_nationkey")).alias("label"))
    return reject.match_names(names, template)


# Windows ----------------------------------------------------------------------------------------------------------


@register(f"with {REC}, s as (select rec, ch, i, v, 1 as stream, i // 48 as epoch from rec union all select rec, ch, i, v, 2, (i - 24) // 48 from rec where i >= 24) select rec, stream, epoch, count(*) as n, round(avg(v) + 1e-8::double, 6) as mean from s group by all")
def half_shift_epochs(spark, sf_dir):
    return signal.half_shifted(events_recording(spark, sf_dir), 48).groupBy("rec", "stream", "epoch").agg(F.count("*").alias("n"), F.round(F.avg("v") + 1e-8, 6).alias("mean"))


@register(f"with {REC} select rec, ch, i, round(v, 6) as v, 1.0::double as weight from rec")
def overlap_add(spark, sf_dir):
    return signal.overlap_add(events_recording(spark, sf_dir), 48, HOURS).select("rec", "ch", "i", *r6("v", "weight"))


WINDOWED = f"{PARTS}, e as ({EPOCH}), w as (select e.rec, w as win, avg(enova) as x from e join range(11) t(w) on epoch between 2 * w and 2 * w + 4 - 1 where 2 * w + 4 <= 30 group by all)"


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.sliding_windows(enova(spark, sf_dir), 4, 24).groupBy("rec", "window").agg(F.avg("enova").alias("x"))


@register(f"with {WINDOWED} select rec, win as \"window\", round(x, 6) as x from w")
def sliding_windows(spark, sf_dir):
    return windowed(spark, sf_dir).select("rec", "window", *r6("x"))


@register(f"with {WINDOWED} select rec, win as \"window\", round((coalesce(lag(x) over o, 0) + x + coalesce(lead(x) over o, 0)) / 3, 6) as x from w window o as (partition by rec order by win)")
def smooth_thresholds(spark, sf_dir):
    w = windowed(spark, sf_dir)
    return w.select("rec", "window", F.round(signal.moving_average3(w, "x", ["rec"], "window"), 6).alias("x"))


@register(f"with {PARTS}, e as ({EPOCH}) select rec, epoch, round((enova + lead(enova) over (partition by rec order by epoch)) / 2, 6) as enova from e")
def stream2_thresholds(spark, sf_dir):
    return enova(spark, sf_dir).select("rec", "epoch", F.round(signal.between_neighbours("enova", ["rec"], "epoch"), 6).alias("enova"))


@register(f"""with {PARTS}, e as ({EPOCH}), s as (select rec, epoch, sum(enova) over (partition by rec order by epoch rows between 3 preceding and 2 following) / 6 as s from e),
g as (select rec, list(d order by epoch) as g from (select rec, epoch, lead(s) over (partition by rec order by epoch) - s as d from s) where d is not null group by rec),
k as (select rec, k, round(abs(list_avg(g[:k]) - list_avg(g[k + 1:])) * sqrt(k * (len(g) - k) / len(g)), 9) as score from g, range(2, 28) t(k) where k <= len(g) - 2)
select rec, arg_max(k, score - k * 1e-15)::int + 1 as split, round(max(score), 6) as score from k group by rec""")
def changepoint(spark, sf_dir):
    return signal.changepoint(enova(spark, sf_dir), ["rec"], "epoch", "enova").select("rec", F.col("split").cast("int").alias("split"), *r6("score"))


MARKED = "marked as (select distinct unnest(range(s // 24, least((s + ceil(value / 60)::bigint) // 24, 29) + 1)) as epoch from (select date_diff('hour', timestamp '2024-01-01', ts) as s, value from events where event_type = 'error' and event_id % 40 = 7))"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.table(spark, sf_dir, "events").where((F.col("event_type") == "error"))
    return reject.marker_windows(adapters.markers(spark, sf_dir), FS, HOURS // FS)


MARKED_ALL = MARKED.replace(" and event_id % 40 = 7", "")


@register(f"with {MARKED_ALL} select epoch from marked")
def marker_windows(spark, sf_dir):
    return marked(spark, sf_dir)


@register(f"""with {PARTS}, {MARKED_ALL}, e as ({EPOCH}), r as (select epoch from e where round(enova, 9) > {THR}::double),
c as (select count(*) filter (where epoch in (select epoch from marked)) as tp, count(*) filter (where epoch not in (select epoch from marked)) as fp, (select count(*) from marked where epoch not in (select epoch from r)) as fn from r)
select tp as n_true_positives, fp as n_false_positives, fn as n_missed, tp / greatest(tp + fp, 1) as rejection_precision, tp / greatest(tp + fn, 1) as rejection_recall, fp / greatest(30 - tp - fn, 1) as false_rejection_rate from c""")
def rejection_quality(spark, sf_dir):
    bad = enova(spark, sf_dir).where(F.round("enova", 9) > THR).select("epoch")
    return reject.rejection_quality(marked(spark, sf_dir), bad, HOURS // FS)


@register(f"with {PARTS}, e as ({EPOCH}) select rec, epoch // 3 as trial, count(*) filter (where round(enova, 9) > {THR}::double) as n_bad, count(*) as n, 2 * n_bad > count(*) as rejected from e group by rec, epoch // 3")
def majority_vote(spark, sf_dir):
    return reject.majority_vote(enova(spark, sf_dir).withColumn("enova", F.round("enova", 9)), THR, 3)


# Quality ----------------------------------------------------------------------------------------------------------


@register(f"""with {TRIPLE}, t as (select rec, var_pop(ref) as s, var_pop(cor - ref) as a, var_pop(cln - ref) as r, sqrt(avg((cln - ref) ** 2)) as rmse from triple group by rec)
select rec, round(10 * (log10(s / (r + 1e-12)) - log10(s / (a + 1e-12))), 6) as snr_improvement_db, round(rmse, 6) as rmse, round(r / (a + 1e-12), 6) as residual_power_ratio from t""")
def removal_quality(spark, sf_dir):
    return quality.removal(triple(spark, sf_dir)).select("rec", *r6("snr_improvement_db", "rmse", "residual_power_ratio"))


@register(f"with {TRIPLE}, c as (select rec, ch, case when var_pop(ref) > 0 and var_pop(cln) > 0 then corr(ref, cln) end as r from triple group by all) select rec, round(coalesce(avg(r), 0), 6) as correlation from c group by rec")
def pearson_ch(spark, sf_dir):
    return quality.mean_correlation(triple(spark, sf_dir)).select("rec", *r6("correlation"))


@register(f"with {TRIPLE} select rec, ch, round(corr(ref, cln), 6) as r from triple where ch in ('click', 'view') group by all having var_pop(ref) > 0")
def sensorimotor_corr(spark, sf_dir):
    m = quality.named_correlations(triple(spark, sf_dir), ["click", "view"])
    return m.select("rec", F.explode("by_channel").alias("ch", "r")).select("rec", "ch", *r6("r")).where("r is not null")


@register(f"with {TRIPLE}, c as (select rec, ch, kurtosis_pop(cor) as a, kurtosis_pop(cln) as b from triple group by all) select rec, round(avg(a) - avg(b), 6) as kurtosis_reduction from c group by rec")
def kurtosis_red(spark, sf_dir):
    return quality.kurtosis_reduction(triple(spark, sf_dir)).select("rec", *r6("kurtosis_reduction"))


@register(f"with {REC}, c as (select rec, i // 24 as epoch, ch, var_samp(v) as p from rec group by all) select rec, epoch, round(10 * log10(sum(p) + 1e-12), 6) as power_db from c group by all")
def epoch_power_db(spark, sf_dir):
    return quality.epoch_power_db(events_recording(spark, sf_dir), FS).select("rec", "epoch", *r6("power_db"))


@register(f"with {REC}, m as (select rec, median(v) as m from rec group by rec) select rec, round(least(200, greatest(5, 5 * median(abs(v - m)))), 6) as scale from rec join m using (rec) group by rec")
def mad_scale(spark, sf_dir):
    return quality.mad_scale(events_recording(spark, sf_dir)).select("rec", *r6("scale"))


@register(f"""with {TRIPLE}, c as (select p.ch as a, q.ch as b, covar_samp(p.ref, q.ref) as x, covar_samp(p.cln, q.cln) as y from triple p join triple q on p.rec = q.rec and p.i = q.i group by all)
select 'events' as rec, round(sqrt(sum((x - y) ** 2)) / (sqrt(sum(x ** 2)) + 1e-12), 6) as distance from c""")
def frobenius_dist(spark, sf_dir):
    t = triple(spark, sf_dir)
    one, other = (quality.channel_covariance(t.select("rec", "ch", "i", F.col(c).alias("v"))) for c in ("ref", "cln"))
    return quality.frobenius_distance(one, other).select("rec", *r6("distance"))


@register(f"with {PARTS}, e as ({EPOCH}) select rec, round(avg(enova) - sqrt(var_samp(enova) * -2 * ln(0.05::double)), 6) as lo, round(avg(enova) + sqrt(var_samp(enova) * -2 * ln(0.05::double)), 6) as hi from e group by rec")
def enova_extents(spark, sf_dir):
    return quality.extents(enova(spark, sf_dir), ["rec"], "enova").select("rec", *r6("lo", "hi"))


# Injection --------------------------------------------------------------------------------------------------------

EPOCHS = [2, 7, 11, 19]
IN_EPOCHS = "i // 24 in (2, 7, 11, 19)"
INDEXED = REC + ", r as (select rec.*, ch_idx from rec join idx using (ch))"


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.with_index(events_recording(spark, sf_dir))


def injected(df: DataFrame) -> DataFrame:
    # no negative zero
    return df.select("rec", "ch", "i", *[F.when(F.abs(F.round(c, 6)) < 5e-7, 0.0).otherwise(F.round(c, 6)).alias(c) for c in ("v", "artifact")])


def injection_sql(artifact: str) -> str:
    return f"with {INDEXED}, x as (select *, coalesce({artifact}, 0) as a from r) select rec, ch, i, case when abs(round(v + a, 6)) < 5e-7 then 0 else round(v + a, 6) end as v, case when abs(round(a, 6)) < 5e-7 then 0 else round(a, 6) end as artifact from x"


@register(injection_sql("20 * (0.5::double + (ch_idx * 0.37::double) % 1) * (sin(2 * pi() * 5 / 24 * i + ch_idx) + sin(2 * pi() * 10 / 24 * i + 2 * ch_idx) / 2)"))
def inject_line(spark, sf_dir):
    return injected(inject.line_noise(indexed(spark, sf_dir), FS, 5.0))


def uniform_sql(seed: int, key: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', {seed}, {key})), 1, 8))::bigint + 0.5::double) / 4294967296)"


def normal_sql(seed: int) -> str:
    u, v = (uniform_sql(seed + k, "rec, ch, i") for k in (0, 1))
    return f"sqrt(-2 * ln({u})) * cos(2 * pi() * {v})"


NOISY = ["click", "purchase", "signup"]


@register(injection_sql(f"case when {IN_EPOCHS} and ch in {tuple(NOISY)} then 40 * (0.5::double + 1.5::double * {uniform_sql(49, 'rec, ch, i // 24')}) * {normal_sql(47)} end"))
def inject_channel_noise(spark, sf_dir):
    return injected(inject.channel_noise(indexed(spark, sf_dir), NOISY, EPOCHS, FS))


@register(injection_sql(f"30 * i / 719 * {normal_sql(99)}"))
def inject_growing_noise(spark, sf_dir):
    return injected(inject.growing_noise(indexed(spark, sf_dir), HOURS, 30.0))


@register(injection_sql("50 * (0.3::double + (ch_idx * 0.61::double) % 1.2::double) * sin(2 * pi() * 0.1::double / 24 * i + ch_idx)"))
def inject_drift(spark, sf_dir):
    return injected(inject.drift(indexed(spark, sf_dir), FS))


@register(injection_sql(f"case when ch_idx = 0 and {IN_EPOCHS} and i % 24 >= 4 then 200 * exp(-(i % 24 - 4) / (0.1::double * 24)) end"))
def inject_pop(spark, sf_dir):
    return injected(inject.electrode_pop(indexed(spark, sf_dir), EPOCHS, FS, 4, FS))


BLINK = "exp(-(((i % 24 - 6) / 9 - 0.45::double) ** 2) / (2 * 0.15::double ** 2)) ** case when (i % 24 - 6) / 9 > 0.45::double then 1.5::double else 1 end"


@register(injection_sql(f"case when {IN_EPOCHS} and i % 24 between 6 and 15 then 150 * 0.1::double * {BLINK} end"))
def inject_blink(spark, sf_dir):
    return injected(inject.blink(indexed(spark, sf_dir), EPOCHS, FS, 6, 10))


@register(injection_sql(f"case when {IN_EPOCHS} and i % 24 between 5 and 10 then 80 * case when ch_idx % 2 = 0 then -0.8::double else 1 end * case when i % 24 - 5 < 2 then (i % 24 - 5) / 2 when i % 24 - 5 < 4 then 1 else 3 * (1 - (i % 24 - 5) / 6) end end"))
def inject_saccade(spark, sf_dir):
    return injected(inject.saccade(indexed(spark, sf_dir), EPOCHS, FS, 5, 6))


# Information transfer ---------------------------------------------------------------------------------------------

WOLPAW = "case when {p} <= 0.5 then 0 when {p} >= 1 then 1 else 1 + {p} * log2({p}) + (1 - {p}) * log2(1 - {p}) end"


@register(f"with {SWEEP} select dataset, subject, thr, round({WOLPAW.format(p='ba_rej')}, 6) as bits from sweep")
def wolpaw(spark, sf_dir):
    return adapters.sweep(spark, sf_dir).select("dataset", "subject", "thr", F.round(itr.wolpaw_bits(F.col("ba_rej"), F.lit(2)), 6).alias("bits"))


@register(f"""with {SWEEP}, b as (select dataset, subject, thr, 1 - pct_retained / 100 as r, ba_rej, ba_rec, {WOLPAW.format(p='ba_rej')} as bj, {WOLPAW.format(p='ba_rec')} as bc from sweep)
select dataset, subject, thr, round(r, 6) as rejection_rate, round(bj, 6) as bits_per_trial_reject, round(bc, 6) as bits_per_trial_reconstruct, round(bj * (1 - r), 6) as itr_effective_reject,
round(bc, 6) as itr_effective_reconstruct, round(bj * (1 - r) * 60 / 4, 6) as itr_bits_per_min_reject, round(bc * 60 / 4, 6) as itr_bits_per_min_reconstruct, round(bj * (1 - r) - bc, 6) as itr_delta_vs_reconstruct,
case when (1 - r) * ba_rej <= 0 then 'infinity'::double else round(((1 - r) * ba_rej + r + 2 * (1 - r) * (1 - ba_rej)) / ((1 - r) * ba_rej), 6) end as actions_per_letter_reject,
case when ba_rec <= 0 then 'infinity'::double else round((ba_rec + 2 * (1 - ba_rec)) / ba_rec, 6) end as actions_per_letter_reconstruct from b""")
def itr_bundle(spark, sf_dir):
    cols = itr.itr_columns(F.col("ba_rej"), F.col("ba_rec"), F.col("pct_retained"), F.lit(4.0), F.lit(2))
    s = adapters.sweep(spark, sf_dir).select("dataset", "subject", "thr", *cols)
    return s.select("dataset", "subject", "thr", *r6(*s.columns[3:]))


# Statistics -------------------------------------------------------------------------------------------------------


@register(f"with {SWEEP} select dataset, subject, {', '.join(f'round(avg(ba_rej) filter (where thr = {t}), 6) as t{round(100 * t):02d}' for t in THRESHOLDS)} from sweep group by all")
def ba_pivot(spark, sf_dir):
    p = stats.pivot(adapters.sweep(spark, sf_dir), "ba_rej", THRESHOLDS)
    return p.select("dataset", "subject", *r6(*p.columns[2:]))


@register(f"with {SWEEP} select dataset, thr, round(avg(ba_rej), 6) as ba_rej_mean, round(avg(ba_rec), 6) as ba_rec_mean, round(avg(pct_retained), 6) as pct_retained_mean, count(distinct (dataset, subject)) as n_subjects from sweep group by dataset, thr")
def thr_means(spark, sf_dir):
    m = stats.means(adapters.sweep(spark, sf_dir), ["dataset", "thr"], ["ba_rej", "ba_rec", "pct_retained"])
    return m.select("dataset", "thr", *r6("ba_rej_mean", "ba_rec_mean", "pct_retained_mean"), "n_subjects")


@register(f"""with {SWEEP}, t as (select thr, count(ba_rej) as n, avg(ba_rej) as mean, stddev_samp(ba_rej) as sd from sweep group by thr)
select thr, n, round(mean, 6) as mean, round(sd, 6) as sd, round(sd / sqrt(n), 6) as sem, round(mean - 1.96 * sd / sqrt(n), 6) as lo, round(mean + 1.96 * sd / sqrt(n), 6) as hi from t""")
def stats_table(spark, sf_dir):
    return stats.stats_table(adapters.sweep(spark, sf_dir), "ba_rej").select("thr", "n", *r6("mean", "sd", "sem", "lo", "hi"))


BEST = "row_number() over (partition by {by} order by round({m}, 9) desc, thr) = 1"


@register(f"with {SWEEP}, m as (select dataset, thr, avg(ba_rej) as m from sweep group by all) select dataset, thr as best, round(m, 6) as value from m qualify {BEST.format(by='dataset', m='m')}")
def best_thr(spark, sf_dir):
    m = stats.means(adapters.sweep(spark, sf_dir), ["dataset", "thr"], ["ba_rej"])
    return stats.best(m, ["dataset"], F.col("ba_rej_mean")).select("dataset", "best", *r6("value"))


@register(f"""with {SWEEP}, b as (select dataset, subject, thr as best, round(ba_rej, 9) as v from sweep qualify {BEST.format(by='dataset, subject', m='ba_rej')}), d as (select dataset, subject, ba_rej as base from sweep where thr = 0.09)
select round(median(best), 6) as median, min(best) as min, max(best) as max, count(*) filter (where v - base > 0.02) as n_gain, (select best from b group by best order by count(*) desc, best limit 1) as mode from b left join d using (dataset, subject)""")
def per_subject_best(spark, sf_dir):
    return stats.subject_optimum(adapters.sweep(spark, sf_dir), "ba_rej", 0.09).select(*r6("median"), "min", "max", "n_gain", "mode")


@register(f"""with {SWEEP}, b as (select dataset, subject, thr as best, ba_rej, pct_retained from sweep qualify {BEST.format(by='dataset, subject', m='ba_rej')})
select dataset, count(*) as n_flagged from b where pct_retained < 70 group by dataset""")
def bias_flags(spark, sf_dir):
    s = adapters.sweep(spark, sf_dir)
    top = stats.best(s, stats.SUBJECT, F.col("ba_rej")).select(*stats.SUBJECT, F.col("best").alias("thr"))
    return s.join(top, [*stats.SUBJECT, "thr"]).where("pct_retained < 70").groupBy("dataset").agg(F.count("*").alias("n_flagged"))


@register(f"with {SWEEP} select dataset, count(distinct subject) as n_subjects from sweep group by dataset having count(distinct subject) < 1001")
def small_n(spark, sf_dir):
    return stats.small_datasets(adapters.sweep(spark, sf_dir), 1001)


@register(f"""with {SWEEP}, b as (select thr, pct_retained, {WOLPAW.format(p='ba_rej')} as bj, {WOLPAW.format(p='ba_rec')} as bc from sweep)
select thr, 'reject' as method, round(avg(bj * pct_retained / 100), 6) as bits, round(avg(pct_retained), 6) as retained from b group by thr union all select null, 'reconstruct', round(avg(bc), 6), 100.0::double from b""")
def itr_table(spark, sf_dir):
    s = adapters.sweep(spark, sf_dir)
    kept = F.col("pct_retained") / 100
    rows = s.groupBy("thr").agg(F.round(F.avg(itr.wolpaw_bits(F.col("ba_rej"), F.lit(2)) * kept), 6).alias("bits"), F.round(F.avg("pct_retained"), 6).alias("retained")).select("thr", F.lit("reject").alias("method"), "bits", "retained")
    return rows.union(s.agg(F.round(F.avg(itr.wolpaw_bits(F.col("ba_rec"), F.lit(2))), 6).alias("bits")).select(F.lit(None).cast("double"), F.lit("reconstruct"), "bits", F.lit(100.0)))


@register(f"with {SWEEP}, m as (unpivot sweep on ba_rej, ba_rec, pct_retained into name metric value value) select metric, thr, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, count(*) as n from m group by all")
def melt_quality(spark, sf_dir):
    return stats.melt(adapters.sweep(spark, sf_dir), ["ba_rej", "ba_rec", "pct_retained"]).select("metric", "thr", *r6("mean", "sd"), "n")


DIFFS = f"{SWEEP}, diffs as (select a.thr as t1, b.thr as t2, dataset, subject, b.ba_rej - a.ba_rej as d from sweep a join sweep b using (dataset, subject) where a.thr < b.thr)"


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.sweep(spark, sf_dir)
    return stats.paired(s, "ba_rej", stats.threshold_pairs(s))


@register(f"with {DIFFS} select t1, t2, count(*) as n, round(avg(d) / stddev_samp(d), 6) as cohens_d, count(*) filter (where round(d, 9) > 0) as wins, count(*) filter (where round(d, 9) < 0) as losses, count(*) filter (where round(d, 9) = 0) as ties from diffs group by all")
def cohens_d(spark, sf_dir):
    d = diffs(spark, sf_dir).withColumn("d", F.round("d", 9))
    return stats.cohens_d(d, ["t1", "t2"]).select("t1", "t2", "n", *r6("cohens_d"), "wins", "losses", "ties")


@register(f"""with {DIFFS}, r as (select *, rank() over (partition by t1, t2 order by abs(round(d, 9))) + (count(*) over (partition by t1, t2, abs(round(d, 9))) - 1) / 2 as r from diffs where round(d, 9) <> 0)
select t1, t2, count(*) as n, sum(case when d > 0 then r else 0 end)::double as w_plus, sum(case when d < 0 then r else 0 end)::double as w_minus, least(w_plus, w_minus) as w from r group by all""")
def wilcoxon_w(spark, sf_dir):
    return stats.wilcoxon_w(diffs(spark, sf_dir), ["t1", "t2"])


@register(f"""with {SWEEP}, c as (select *, round(ba_rej, 9) as m, count(*) over (partition by dataset, subject) as own from sweep), k as (select count(distinct thr) as k from sweep),
r as (select thr, k, rank() over p + (count(*) over q - 1) / 2 as r, count(*) over q as tied from c, k where own = k window p as (partition by dataset, subject order by m), q as (partition by dataset, subject, m)),
s as (select thr, max(k) as k, sum(r)::double as s, count(*) as n, sum(tied * tied - 1)::double as tie from r group by thr)
select max(n) as n, max(k) as k, round((12 / (max(n) * max(k) * (max(k) + 1)) * sum(s * s) - 3 * max(n) * (max(k) + 1)) / (1 - sum(tie) / (max(n) * max(k) * (max(k) * max(k) - 1))), 6) as chi2 from s""")
def friedman_chi2(spark, sf_dir):
    return stats.friedman(adapters.sweep(spark, sf_dir), "ba_rej").select("n", "k", *r6("chi2"))


PVALUES = f"{SWEEP}, p as (select dataset || thr as key, least(1, abs(avg(ba_rej) - avg(ba_rec)) * 2) as p from sweep group by dataset, thr)"


@register(f"""with {PVALUES}, r as (select *, row_number() over (order by p, key) as r, count(*) over () as n from p)
select key, round(p, 6) as p, round(least(p * n, 1), 6) as p_bonferroni, round(least(min(p * n / r) over (order by r desc rows unbounded preceding), 1), 6) as p_bh from r""")
def corrected_p(spark, sf_dir):
    s = adapters.sweep(spark, sf_dir).groupBy("dataset", "thr").agg(F.least(F.lit(1.0), F.abs(F.avg("ba_rej") - F.avg("ba_rec")) * 2).alias("p"))
    keyed = s.select(F.concat("dataset", F.col("thr").cast("string")).alias("key"), "p")
    return stats.benjamini_hochberg(keyed).select("key", *r6("p", "p_bonferroni", "p_bh"))


@register("""with x as (select label, embedding[1]::double as v from embeddings), d as (select a.v, (select avg((a.v - b.v) ** 2) * count(*) / (count(*) - 1) from x b where b.label = 3) as i,
(select avg((a.v - b.v) ** 2) from x b where b.label <> 3) as o from x a where a.label = 3) select round(avg((o - i) / greatest(i, o)), 6) as silhouette from d""")
def silhouette_1d(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("v"))
    return stats.silhouette(e, "v", "label", 3).select(*r6("silhouette"))


@register("""with c as (select quality as t, toxic as g, count(*) as n from labels group by all), r as (select t, sum(n) as row, sum(n) filter (where t = g) as hit from c group by t), k as (select g as t, sum(n) as col from c group by g),
j as (select coalesce(row, 0) as row, coalesce(hit, 0) as hit, coalesce(col, 0) as col from r full join k using (t))
select round(avg(case when row > 0 then hit / row end), 6) as balanced_accuracy, round((sum(hit) / sum(row) - sum(row * col) / sum(row) ** 2) / (1 - sum(row * col) / sum(row) ** 2), 6) as kappa from j""")
def confusion_ba_kappa(spark, sf_dir):
    return stats.accuracy_kappa(adapters.table(spark, sf_dir, "labels"), "quality", "toxic").select(*r6("balanced_accuracy", "kappa"))


# Sweeps and montages ----------------------------------------------------------------------------------------------

CUTS = [0.45, 0.5, 0.55, 0.6, 0.65]


@register(f"""with {PARTS}, {MARKED_ALL}, e as (select rec, epoch, round(enova, 9) as enova, epoch in (select epoch from marked) as hit from ({EPOCH})), t as (select unnest({CUTS})::double as thr),
c as (select rec, thr, count(*) as n, count(*) filter (where enova > thr) as bad, avg(enova) as m, count(*) filter (where enova > thr and hit) as tp, count(*) filter (where enova > thr and not hit) as fp,
  count(*) filter (where enova <= thr and hit) as fn, count(*) filter (where not hit) as clean from e, t group by rec, thr)
select rec, thr as enova_threshold, n as n_1s_windows_total, bad as n_1s_windows_rejected, round(100 * (1 - bad / n), 6) as pct_retained, round(m, 6) as mean_enova, tp as n_true_positives, fp as n_false_positives,
fn as n_missed, clean as n_clean_windows, round(tp / greatest(tp + fp, 1), 6) as rejection_precision, round(tp / greatest(tp + fn, 1), 6) as rejection_recall, round(fp / greatest(clean, 1), 6) as false_rejection_rate from c""")
def threshold_sweep(spark, sf_dir):
    e = enova(spark, sf_dir).withColumn("enova", F.round("enova", 9))
    s = sweep.apply_thresholds(e, CUTS, marked(spark, sf_dir))
    rounded = {"pct_retained", "mean_enova", "rejection_precision", "rejection_recall", "false_rejection_rate"}
    return s.select(*[F.round(c, 6).alias(c) if c in rounded else c for c in s.columns])


@register()
def artifact_benchmark(spark, sf_dir):
    b = sweep.artifact_benchmark(indexed(spark, sf_dir), sweep.deterministic_injectors(FS, EPOCHS, FS), HOURS)
    return b.select("artifact_type", "rec", *r6("snr_improvement_db", "rmse", "residual_power_ratio", "correlation"))


@register(f"""with {SWEEP}, m as (select thr, round(avg(ba_rej), 9) as v, row_number() over (order by thr) as r, count(*) over () as n from sweep group by thr)
select (select thr from m order by v desc, thr limit 1) as peak, (select thr from m where r <= n // 2 order by v desc, thr limit 1) as first_half_peak""")
def two_peaks(spark, sf_dir):
    return sweep.two_peaks(adapters.sweep(spark, sf_dir).groupBy("thr").agg(F.avg("ba_rej").alias("v")), "thr", "v")


@register(f"""with {REC}, pos as (select ch, cos(2 * pi() * ch_idx / count(*) over ()) as x, sin(2 * pi() * ch_idx / count(*) over ()) as y from idx), bad as (select ch from idx where ch_idx = 1),
w as (select p.ch as t, q.ch as f, 1 / ((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + 1e-12) as w from pos p, pos q where p.ch in (from bad) and q.ch not in (from bad)
  qualify row_number() over (partition by p.ch order by (p.x - q.x) ** 2 + (p.y - q.y) ** 2, q.ch) <= 4)
select rec, ch, i, round(v + 1e-8::double, 6) as v from rec where ch not in (from bad) union all
select r.rec, w.t, r.i, round(sum(w.w * r.v) / sum(w.w) + 1e-8::double, 6) from rec r join w on r.ch = w.f group by all""")
def interpolate_bad(spark, sf_dir):
    rec = events_recording(spark, sf_dir)
    places = adapters.ring_positions(rec)
    out = montage.interpolate_channels(rec, places, places.where("ch_idx = 1"))
    return out.select("rec", "ch", "i", F.round(F.col("v") + 1e-8, 6).alias("v"))


@register("""with p as (select distinct 'brand#' || (n_nationkey + 11) as name, n_nationkey as idx from nation where n_nationkey < 5)
select a.name as a, b.name as b, round(1 / (1.0::double + abs(a.idx - b.idx)), 6) as g from p a, p b""")
def reference_gather(spark, sf_dir):
    n = adapters.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"))
    template = n.select("idx", F.concat(F.lit("Brand#"), F.col("idx") + 11).alias("label"))
    matrix = n.select(F.col("idx").alias("i")).join(F.broadcast(n.select(F.col("idx").alias("j"))), F.lit(True)).withColumn("g", 1 / (1.0 + F.abs(F.col("i") - F.col("j"))))
    names = template.where("idx < 5").select(F.lower("label").alias("name"))
    return montage.gather(matrix, template, names).select("a", "b", *r6("g"))


@register(f"""with {TRIPLE}, e as (select rec, i, avg(ref) as e from triple group by all), c as (select t.rec, ch, abs(corr(cor, e)) as a, abs(corr(cln, e)) as b from triple t join e using (rec, i) group by all)
select rec, round(avg(a) - avg(b), 6) as reduction from c group by rec""")
def eog_reduction(spark, sf_dir):
    t = triple(spark, sf_dir)
    return quality.eog_correlation_reduction(t, t.groupBy("rec", "i").agg(F.avg("ref").alias("e"))).select("rec", *r6("reduction"))


@register(f"""with {SWEEP}, d as (select thr, round(ba_rej - ba_rec, 9) as d from sweep), r as (select thr, d, rank() over (partition by thr order by abs(d)) + (count(*) over (partition by thr, abs(d)) - 1) / 2 as r from d where d <> 0)
select thr, count(*) as n, sum(case when d > 0 then r else 0 end)::double as w_plus, sum(case when d < 0 then r else 0 end)::double as w_minus, least(w_plus, w_minus) as w from r group by thr""")
def reject_vs_reconstruct(spark, sf_dir):
    s = adapters.sweep(spark, sf_dir)
    a, b = s.select(*stats.SUBJECT, "thr", F.col("ba_rej").alias("x")), s.select(*stats.SUBJECT, "thr", F.col("ba_rec").alias("y"))
    return stats.wilcoxon_w(a.join(b, [*stats.SUBJECT, "thr"]).select("thr", (F.col("x") - F.col("y")).alias("d")), ["thr"])
