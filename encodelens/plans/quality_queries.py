"""Queries over rate-quality curves and frame series."""

from __future__ import annotations

from pyspark.sql import functions as F

from encodelens.operators import curves, ladders, series
from encodelens.plans.registry import query

ASKED = """
with ask as (select p_partkey as rung, concat('clip', p_partkey % 5) as clip, case when p_type in ('ECONOMY', 'SMALL') then 'h264' when p_type in ('STANDARD', 'MEDIUM') then 'hevc' else 'av1' end as codec,
  case when p_size % 2 = 0 then 2160 else 1080 end as reference, case p_size % 4 when 0 then 432 when 1 then 720 when 2 then 1080 else 540 end as height, cast(floor(p_retailprice * 60) as int) % 5600 + 37 as kbps, p_brand as ladder from part)
"""


def asked(v):
    return v.part.selectExpr(
        "p_partkey as rung", "concat('clip', p_partkey % 5) as clip", "case when p_type in ('ECONOMY', 'SMALL') then 'h264' when p_type in ('STANDARD', 'MEDIUM') then 'hevc' else 'av1' end as codec",
        "case when p_size % 2 = 0 then 2160 else 1080 end as reference", "case p_size % 4 when 0 then 432 when 1 then 720 when 2 then 1080 else 540 end as height", "cast(floor(p_retailprice * 60) as int) % 5600 + 37 as kbps", "p_brand as ladder",
    )


ESTIMATE = ASKED + """
, own as (select a.*, c.kbps as pk, c.vmaf as pv, c.height = a.height as same from ask a left join (select clip, codec, reference, height, kbps, max(vmaf) as vmaf, min(vmaf) as low from curves group by all) c
   on a.clip = c.clip and a.codec = c.codec and a.reference = c.reference),
n as (select *, (select count(*) from curves c where c.clip = a.clip and c.codec = a.codec and c.reference = a.reference and c.height = a.height) as hn,
   (select count(*) from curves c where c.clip = a.clip and c.codec = a.codec and c.reference = a.reference and c.height = a.height and c.kbps = a.kbps) as hx from ask a),
use as (select n.rung, c.kbps as k, c.vmaf as w from n join curves c on c.clip = n.clip and c.codec = n.codec and c.reference = n.reference and (c.height = n.height or not (hn >= 2 or hn = 1 and hx = 1))),
lo as (select a.rung, max({'k': k, 'v': w}) as p from ask a join use u on a.rung = u.rung and u.k <= a.kbps group by a.rung),
hi as (select a.rung, min({'k': k, 'v': w}) as p from ask a join use u on a.rung = u.rung and u.k >= a.kbps group by a.rung),
est as (select a.*, round(case when lo.p is null then hi.p.v when hi.p is null then lo.p.v when lo.p.k = a.kbps then lo.p.v else lo.p.v + (hi.p.v - lo.p.v) * (a.kbps - lo.p.k) / (hi.p.k - lo.p.k) end, 4) as vmaf,
   (lo.p is null or hi.p is null) and not (lo.p is null and hi.p is null) as clamped from ask a left join lo using (rung) left join hi using (rung))
"""


def estimated(v):
    return curves.curve_estimate(asked(v), v.curves)


@query("O43_curve_estimate", ESTIMATE + "select * from est")
def _(v):
    return estimated(v)


@query("O44_csv_estimate", """
with t as (select codec, kbps / 1000 as m, max(vmaf) as w from curves group by all), a as (select p_partkey as rung, case p_size % 3 when 0 then 'h264' when 1 then 'hevc' else 'av1' end as codec, floor((p_retailprice / 200 - 1 + p_size / 40) * 1000) / 1000 as mbps from part)
select a.rung, a.codec, a.mbps, round(case when a.codec = 'av1' then null when lo.m is null then hi.w when hi.m is null or lo.m = hi.m then lo.w else lo.w + (hi.w - lo.w) * (a.mbps - lo.m) / (hi.m - lo.m) end, 4) as vmaf
from a left join lateral (select m, w from t where t.codec = a.codec and m <= a.mbps + 1e-6 order by m desc limit 1) lo on true left join lateral (select m, w from t where t.codec = a.codec and m >= a.mbps - 1e-6 order by m limit 1) hi on true""")
def _(v):
    a = v.part.selectExpr("p_partkey as rung", "case p_size % 3 when 0 then 'h264' when 1 then 'hevc' else 'av1' end as codec", "floor((p_retailprice / 200 - 1 + p_size / 40) * 1000) / 1000 as mbps")
    return curves.csv_estimate(a, v.curves.select("codec", (F.col("kbps") / 1000).alias("mbps"), "vmaf"))


@query("O50_vmaf_recombine", """
with p as (select job, codec, label, chunk, max({'f': frames, 'm': mean, 'h': harmonic, 'l': low, 'i': inv_sum}) as p from vmaf_parts group by all),
q as (select job, codec, label, p.m, p.h, p.l, p.i, p.f, greatest(p.f, 1) as w from p)
select job, codec, label, round(sum(m * w) / sum(w), 4) as mean, round(case when sum(i) > 0 then sum(w) / sum(i) else sum(h * w) / sum(w) end, 4) as harmonic, min(l) as low, sum(f)::bigint as frames from q group by all""")
def _(v):
    return curves.vmaf_recombine(v.vmaf_parts)


_POOLED = "select suppkey, mean, case when suppkey % 3 = 0 then null else mean - 1 end as harmonic, case when suppkey % 4 = 0 then null else mean - 9 end as low, case when suppkey % 5 = 0 then null else mean + 3 end as high"


@query("O51_frame_pool", f"""
with f as (select series, frame, case when series % 17 = 0 then 0 else score end as score from frames),
r as (select *, row_number() over (partition by series order by score) - 1 as i, count(*) over (partition by series) as n from f),
p as ({_POOLED} from (select s_suppkey * 3 as suppkey, abs(s_acctbal) / 101.7 as mean from supplier) x)
select series, count(*) as n, round(avg(score), 4) as mean, coalesce(round(count(*) / sum(case when score > 0 then 1 / score end), 4), 0) as harmonic, min(score) as low, min({{'s': score, 'f': frame}}).f as low_frame,
       max(score) filter (where i = least(n - 1, floor(n * 0.01))) as p1, max(score) as high, round(stddev_pop(score), 4) as deviation, round(100 * avg((score < 10)::int), 4) as under_10_pct, round(100 * avg((score < 50)::int), 4) as under_50_pct
from r group by series
union all select suppkey, 0, round(mean, 4), round(coalesce(harmonic, mean), 4), coalesce(low, mean), -1, coalesce(low, mean), coalesce(high, mean), 0, 0, 0 from p where suppkey not in (select series from frames)""")
def _(v):
    """Frames of all series, some of which have no positive score, and suppliers as logs that have their pooled figures alone."""
    f = v.frames.withColumn("score", F.when(F.col("series") % 17 == 0, 0.0).otherwise(F.col("score")))
    x = v.supplier.select((F.col("s_suppkey") * 3).alias("suppkey"), (F.abs("s_acctbal") / 101.7).alias("mean"))
    return curves.frame_pool(f, v.spark.sql(_POOLED + " from {x}", x=x).withColumnRenamed("suppkey", "series"))


def verdicts(v):
    return curves.ladder_verdict(estimated(v).select("ladder", "codec", F.col("rung").alias("pos"), "kbps", "vmaf", "clamped"))


@query("O78_ladder_verdict", ESTIMATE + """
, l as (select ladder, codec, rung as pos, kbps, vmaf, vmaf is not null and not clamped as known, lag(vmaf) over o as bv, lag(kbps) over o as bk, lag(vmaf is not null and not clamped) over o as b from est window o as (partition by ladder, codec order by rung))
select ladder, codec, pos, kbps, vmaf, round(case when known and b then vmaf - bv end, 4) as gain, case when known and b then kbps - bk end as more_kbps,
       case when not known then null when vmaf >= 96 then 'saturated' when b and vmaf - bv < 2 then 'redundant' when b and vmaf - bv > 9 then 'wide-gap' else 'ok' end as verdict from l""")
def _(v):
    return verdicts(v)


@query("O79_hull_delta", """
with c as (select clip, codec, reference, height, kbps, max(vmaf) as vmaf from curves group by all),
l as (select *, lag(kbps) over o as lk, lag(vmaf) over o as lv, lead(kbps) over o as hk, lead(vmaf) over o as hv from c window o as (partition by clip, codec, reference, height order by kbps)),
d as (select *, vmaf - (lv + (hv - lv) * (kbps - lk) / (hk - lk)) as x from l)
select clip, codec, reference, height, kbps, vmaf, round(x, 9) as hull_delta, round((vmaf - lv) / ((kbps - lk) / 1000), 9) as eff, round(kbps / (height * height * 16 / 9 / 1e6), 4) as kbps_mp,
       case when x < 0 then 'dominated' when x < 0.5 then 'borderline' when x is not null then 'ok' end as hull from d""")
def _(v):
    c = v.curves.groupBy("clip", "codec", "reference", "height", "kbps").agg(F.max("vmaf").alias("vmaf"))
    return curves.hull_delta(c, ["clip", "codec", "reference", "height"])


@query("O80_bd_rate", """
with c0 as (select clip, reference, height, codec, kbps, max(vmaf) as vmaf from curves group by all),
c as (select *, ln(kbps) as l from (select *, max(vmaf) over (partition by clip, reference, height, codec order by kbps rows between unbounded preceding and 1 preceding) as b from c0) where b is null or vmaf > b),
e as (select clip, reference, height, codec, min(vmaf) as lo, max(vmaf) as hi from c group by all),
p as (select e.clip, e.reference, e.height, e.codec as other, greatest(e.lo, a.lo) as f, least(e.hi, a.hi) as t from e join e a on a.clip = e.clip and a.reference = e.reference and a.height = e.height and a.codec = 'h264' where e.codec <> 'h264' and least(e.hi, a.hi) > greatest(e.lo, a.lo)),
v as (select distinct clip, reference, height, other, x from (select p.clip, p.reference, p.height, p.other, c.vmaf as x from p join c on c.clip = p.clip and c.reference = p.reference and c.height = p.height and c.codec in (p.other, 'h264') and c.vmaf between p.f and p.t
   union all select clip, reference, height, other, f from p union all select clip, reference, height, other, t from p)),
r as (select v.*, s.codec, (select max({'v': c.vmaf, 'l': c.l}) from c where c.clip = v.clip and c.reference = v.reference and c.height = v.height and c.codec = s.codec and c.vmaf <= v.x) as lo,
   (select min({'v': c.vmaf, 'l': c.l}) from c where c.clip = v.clip and c.reference = v.reference and c.height = v.height and c.codec = s.codec and c.vmaf >= v.x) as hi
   from v, (values ('h264'), ('hevc'), ('av1')) s(codec) where s.codec = 'h264' or s.codec = v.other),
k as (select clip, reference, height, other, x, codec, case when lo.v = hi.v then lo.l else lo.l + (hi.l - lo.l) * (x - lo.v) / (hi.v - lo.v) end as l from r),
d as (select clip, reference, height, other, x, max(l) filter (where codec = other) - max(l) filter (where codec = 'h264') as d from k group by all),
g as (select *, lead(d) over o as nd, lead(x) over o as nx from d window o as (partition by clip, reference, height, other order by x))
select clip, reference, height, other as codec, round(100 * (exp(sum((nd + d) / 2 * (nx - x)) / sum(nx - x)) - 1), 4) as bd_rate_pct, round(min(x), 4) as from_vmaf, round(max(x), 4) as to_vmaf from g group by all""")
def _(v):
    c = v.curves.groupBy("clip", "reference", "height", "codec", "kbps").agg(F.max("vmaf").alias("vmaf"))
    return curves.bd_rate(c, ["clip", "reference", "height"], "h264")


@query("O80_anchor_rates", """
with c as (select clip, reference, height, codec, kbps, max(vmaf) as vmaf from curves group by all),
g as (select clip, reference, height, codec, anchor, max({'v': vmaf, 'k': kbps}) filter (where vmaf < anchor) as lo, min({'v': vmaf, 'k': kbps}) filter (where vmaf >= anchor) as hi, max(vmaf) as top
  from c, (values (20.0::double), (40.0), (60.0)) t(anchor) group by all)
select clip, reference, height, codec, anchor, round(exp(ln(lo.k) + (ln(hi.k) - ln(lo.k)) * (anchor - lo.v) / (hi.v - lo.v)), 4) as kbps from g where lo is not null and hi is not null and anchor < top""")
def _(v):
    c = v.curves.groupBy("clip", "reference", "height", "codec", "kbps").agg(F.max("vmaf").alias("vmaf"))
    return curves.anchor_rates(c, ["clip", "reference", "height"], (20.0, 40.0, 60.0))


@query("O103_audit_tree", """
with o as (select output, name, source, case output % 4 when 0 then 'h264' when 1 then 'hevc' when 2 then 'av1' else 'vp9' end as codec, gone as burnin, mtime from outputs), s as (select distinct source from outputs where output % 20 < 15),
r as (select o.*, case when burnin then 'burn-in' when codec = 'vp9' then 'unknown codec' when s.source is null then 'no source' end as why from o left join s using (source))
select output, name, source, codec, burnin, mtime, case when why is null and row_number() over (partition by codec, why is null order by mtime desc, output desc) > 1 then 'older' else why end as reason from r""")
def _(v):
    o = v.outputs.selectExpr("output", "name", "source", "case output % 4 when 0 then 'h264' when 1 then 'hevc' when 2 then 'av1' else 'vp9' end as codec", "gone as burnin", "mtime")
    return curves.audit_tree(o, v.outputs.where("output % 20 < 15").select("source").distinct(), latest=True)


@query("O133_vmaf_estimates_map", ESTIMATE + """
, l as (select ladder, concat(codec, '/', rung) as k, concat(printf('%.1f', vmaf), case when clamped then ' clamped' else '' end) as w from est where vmaf is not null)
select ladder, count(*) as n, min(k) as first, arg_min(w, k) as first_value from l group by ladder""")
def _(v):
    m = curves.vmaf_estimates(estimated(v).withColumn("label", F.col("rung").cast("string")))
    k = F.array_min(F.map_keys("estimates"))
    return m.select("ladder", F.size("estimates").cast("long").alias("n"), k.alias("first"), F.element_at("estimates", k).alias("first_value"))


@query("O132_encode_meta_rows", ESTIMATE + """
, r as (select ladder as profile, codec, string_agg(concat(height, '@', kbps, '=', case when vmaf is null then 'none' else printf('%.4f', vmaf) end), ' ' order by rung) as rungs, count(vmaf) as scored, count(*) as n from est group by all),
o as (select output, case when output % 2 = 0 then 'Brand#11' else concat('Brand#', 10 * (output % 5 + 1) + output % 7) end as profile, case output % 4 when 0 then 'h264' when 1 then 'hevc' when 2 then 'av1' else 'vp9' end as codec,
  source, bytes as source_size, mtime as source_modified from outputs)
select output, o.profile, o.codec, source, source_size, source_modified, rungs, coalesce(scored, 0) as scored, case when coalesce(scored, 0) = 0 then 'none' when scored < n then 'partial' else 'scored' end as vmaf_state
from o left join r on r.profile = o.profile and r.codec = o.codec""")
def _(v):
    o = v.outputs.selectExpr("output", "case when output % 2 = 0 then 'Brand#11' else concat('Brand#', 10 * (output % 5 + 1) + output % 7) end as profile", "case output % 4 when 0 then 'h264' when 1 then 'hevc' when 2 then 'av1' else 'vp9' end as codec", "source", "bytes as source_size", "mtime as source_modified")
    return curves.encode_meta(o, estimated(v).withColumnRenamed("rung", "pos"))


# ---- frame series


@query("O97_detrend", """
with s as (select *, avg(score) over (partition by series order by frame rows between 4 preceding and 4 following) as m, count(*) over (partition by series) as n, avg(score) over (partition by series) as g from frames)
select series, frame, round(score - case when n <= 9 then g else m end, 6) as residual from s""")
def _(v):
    return series.detrend(v.frames, 9, block=50).select("series", "frame", F.round("residual", 6).alias("residual"))


ACF = """
with d as (select series, frame, score - avg(score) over (partition by series) as d from frames),
n as (select series, sum(d * d) as den, count(*) as n from d group by series),
acf as (select a.series, l.lag::int as lag, round(case when any_value(den) > 0 then sum(a.d * b.d) / any_value(den) else 0 end, 6) as r
   from d a, (select unnest(range(0, 13)) as lag) l, d b, n where b.series = a.series and b.frame = a.frame + l.lag and n.series = a.series and l.lag < n.n group by a.series, l.lag)
"""


@query("O98_autocorrelation", ACF + "select series, lag, r from acf")
def _(v):
    return series.autocorrelation(v.frames, 12, "score")


@query("O99_fundamental_period", ACF.replace("range(0, 13)", "range(0, 25)") + """
, w as (select *, lag(r) over o as b, lead(r) over o as a, count(*) over (partition by series) as lags from acf window o as (partition by series order by lag)),
p0 as (select series, lag, lags, r, (select x.r from w x where x.series = w.series and x.lag < w.lag and (x.lag <= 1 or x.b > x.r) order by x.lag desc limit 1) as lo,
   (select x.r from w x where x.series = w.series and x.lag > w.lag and (x.a is null or x.a > x.r) order by x.lag limit 1) as hi from w where lag >= 2 and r > b and r >= a and r > 0),
p as (select *, round(r - greatest(lo, hi), 6) as prominence from p0),
best as (select series, -(max({'p': prominence, 'l': -lag}).l) as best, max(prominence) as prominence from p group by series),
c as (select p.series, min(p.lag) as sub from p join best using (series) where p.lag < best and p.prominence >= 0.5 * best.prominence and round_even(best / p.lag, 0) >= 2
   and abs(best - round_even(best / p.lag, 0) * p.lag) <= 2 and 2 * p.lag < lags and exists (select 1 from p q where q.series = p.series and abs(q.lag - 2 * p.lag) <= 2) group by p.series)
select s.series, coalesce(sub, best) as period, prominence from (select distinct series from acf) s left join best using (series) left join c using (series)""")
def _(v):
    return series.fundamental_period(series.autocorrelation(v.frames, 24, "score"))


@query("O100_fold", "select series, (frame % 7)::int as phase, round(avg(score), 4) as mean from frames group by all")
def _(v):
    return series.fold(v.frames, 7).withColumn("mean", F.round("mean", 4))


FOLD = """
with f as (select series, floor((frame::double - floor(frame / 7.5) * 7.5) * 6 / 7.5)::int as bucket, avg(score) as m from frames group by all),
w as (select *, count(*) over (partition by series) as n from f)
"""


@query("O100_fold_fraction", FOLD + "select series, bucket, round(m, 4) as mean from w where n = 6")
def _(v):
    return series.fold_fraction(v.frames, 7.5, 6).withColumn("mean", F.round("mean", 4))


@query("O96_pulse_diagnose", FOLD + """
, m as (select series, bucket, m as mean from w where n = 6),
a as (select series, avg(mean) as al, max(mean) filter (where bucket = 0) as idr, avg(mean) filter (where bucket = 1) as after, avg(mean) filter (where bucket >= 4) as late, max(mean) - min(mean) as amp from m group by series)
select series, round(amp, 6) as amplitude, round(idr - al, 6) as idr_delta, round(late - after, 6) as recovery,
       case when idr > al and after < al and late > after then 'VBV starvation' when idr > al and after > al and late < after then 'normal drift'
            when idr < al and late > al then 'starved key frame' when idr < al then 'low IDR' else 'no clear shape' end as verdict from a""")
def _(v):
    return series.pulse_diagnose(series.fold_fraction(v.frames, 7.5, 6), 6)


@query("O101_permutation_significance")
def _(v):
    """Shuffles by hash, so without a twin; tests hold noise and a planted period apart."""
    return series.permutation_significance(v.frames, 8, trials=10)


@query("O102_series_summary", """
with f as (select series, frame % 12 as p, avg(score) as m from frames group by all), a as (select series, max(m) - min(m) as amp from f group by series)
select series, count(*) as n, 12 as gop, round(avg(score), 4) as mean, min(score) as low, round(stddev_pop(score), 4) as deviation, round(any_value(amp), 4) as amplitude, round(avg(score) - (select avg(score) from frames), 4) as from_mean
from frames join a using (series) group by series""")
def _(v):
    return series.series_summary(v.frames, 12)
