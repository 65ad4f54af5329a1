"""Coupling, recurrence, geometry and statistics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandemlab.functions import scalars as sc
from tandemlab.operators import alignment as al
from tandemlab.operators import grouped, joins
from tandemlab.operators import series as ts
from tandemlab.operators import stats as st
from tandemlab.plans.basics import AREA_SQL, ONE_SQL, SERIES, STEP_SQL, TRIAL, S, trials, unique_times
from tandemlab.plans.registry import query
from tandemlab.sources.adapters import read, samples

#: Long series: one per user, in time order.
USER_SQL = "v as (select user_id, cast(row_number() over w - 1 as int) as i, round(bpm, 6) as v, count(*) over (partition by user_id) as n from s window w as (partition by user_id order by trial, t, event_id))"


def users(spark, sf_dir) -> DataFrame:
    return ts.indexed(samples(spark, sf_dir), ["user_id"], ["trial", "t", "event_id"], F.round("bpm", 6))


#: The two members of a dyad by ordinal.
PAIR_SQL = f"{USER_SQL}, q as (select a.user_id // 2 as dyad, a.i, a.v as a, b.v as b, least(a.n, b.n) as n from v a join v b on b.user_id = a.user_id + 1 and a.i = b.i where a.user_id % 2 = 0)"


def pairs(spark, sf_dir) -> DataFrame:
    rows = users(spark, sf_dir).withColumn("dyad", F.expr("user_id div 2"))
    one, two = rows.where("user_id % 2 = 0"), rows.where("user_id % 2 = 1")
    left = one.select("dyad", "i", F.col("v").alias("a"), F.col("n").alias("_n"))
    right = two.select("dyad", "i", F.col("v").alias("b"), F.col("n").alias("_m"))
    return left.join(right, ["dyad", "i"]).select("dyad", "i", "a", "b", F.least("_n", "_m").alias("n"))


@query(S + """, g as (select dyad, trial, role, unnest(range(a, b + 1, 21600000)) as t from (select dyad, trial, role, min(t) as a, max(t) as b from s group by all)),
u as (select dyad, trial, role, t, min(bpm) as v from s group by all),
p as (select g.*, b.t as t0, b.v as v0 from g asof join u b on g.dyad = b.dyad and g.trial = b.trial and g.role = b.role and g.t >= b.t),
f as (select p.*, a.t as t1, a.v as v1 from p asof join u a on p.dyad = a.dyad and p.trial = a.trial and p.role = a.role and p.t <= a.t)
select dyad, trial, role, t, round(case when t1 = t0 then v0 else v0 + (t - t0) * 1.0 / (t1 - t0) * (v1 - v0) end, 5) as v from f""")
def ts_grid_interp(spark, sf_dir):
    rows = unique_times(spark, sf_dir).select(*SERIES, "t", "bpm")
    return ts.on_grid(rows, SERIES, "t", "bpm", F.min("t"), F.max("t"), 21600000).withColumn("v", F.round("v", 5))


@query(S + f""", {USER_SQL}, r as (select *, 60000 / v as rr, 60000 / v - lag(60000 / v) over (partition by user_id order by i) as d from v)
select user_id, round(avg(rr), 5) as mean_rr, round(stddev_samp(rr), 5) as sdnn, round(sqrt(avg(d * d)), 5) as rmssd, round(ln(sqrt(avg(d * d))), 5) as ln_rmssd, count(*) filter (abs(d) > 50) as nn50,
  round(count(*) filter (abs(d) > 50) * 100.0 / count(d), 5) as pnn50, round(stddev_samp(d), 5) as sdsd from r group by user_id""")
def ts_hrv_time(spark, sf_dir):
    d = F.col("rr") - F.lag("rr").over(Window.partitionBy("user_id").orderBy("i"))
    rows = users(spark, sf_dir).withColumn("rr", sc.ibi(F.col("v"))).withColumn("d", d)
    rmssd, nn50 = F.sqrt(F.avg(F.col("d") * F.col("d"))), F.count(F.when(F.abs("d") > 50, 1))
    return rows.groupBy("user_id").agg(
        F.round(F.avg("rr"), 5).alias("mean_rr"), F.round(F.stddev_samp("rr"), 5).alias("sdnn"), F.round(rmssd, 5).alias("rmssd"), F.round(F.ln(rmssd), 5).alias("ln_rmssd"),
        nn50.alias("nn50"), F.round(nn50 * 100.0 / F.count("d"), 5).alias("pnn50"), F.round(F.stddev_samp("d"), 5).alias("sdsd"),
    )


@query(S + f""", {USER_SQL}, r as (select user_id, 60000 / v as rr, lead(60000 / v) over (partition by user_id order by i) as nx from v)
select user_id, round(stddev_samp(nx - rr) / sqrt(2.0), 5) as sd1, round(stddev_samp(nx + rr) / sqrt(2.0), 5) as sd2, round(stddev_samp(nx - rr) / stddev_samp(nx + rr), 5) as ratio from r where nx is not null group by user_id""")
def ts_poincare(spark, sf_dir):
    nx = F.lead("rr").over(Window.partitionBy("user_id").orderBy("i"))
    rows = users(spark, sf_dir).withColumn("rr", sc.ibi(F.col("v"))).withColumn("nx", nx).where("nx is not null")
    one, two = F.stddev_samp(F.col("nx") - F.col("rr")), F.stddev_samp(F.col("nx") + F.col("rr"))
    return rows.groupBy("user_id").agg(F.round(one / F.sqrt(F.lit(2.0)), 5).alias("sd1"), F.round(two / F.sqrt(F.lit(2.0)), 5).alias("sd2"), F.round(F.try_divide(one, two), 5).alias("ratio"))


@query(S + f""", {USER_SQL}, e as (select user_id, i, n, v, lead(v, 1) over w as v1, lead(v, 2) over w as v2, 0.2 * stddev_samp(v) over (partition by user_id) as r from v window w as (partition by user_id order by i)),
p as (select a.user_id, count(*) as m2, count(*) filter (b.i < b.n - 3 and abs(a.v2 - b.v2) <= a.r) as m3 from e a join e b on a.user_id = b.user_id and a.i < b.i and abs(a.v - b.v) <= a.r and abs(a.v1 - b.v1) <= a.r
  where b.i < b.n - 2 and a.r > 0 and a.n >= 4 group by a.user_id)
select user_id, round(case when m2 > 0 and m3 > 0 then -ln(m3 * 1.0 / m2) end, 6) as sampen from (select distinct user_id from v) left join p using (user_id)""")
def ts_sampen(spark, sf_dir):
    return ts.sample_entropy(users(spark, sf_dir), ["user_id"])


@query(S + f""", {USER_SQL}, y as (select user_id, i, n, sum(d) over (partition by user_id order by i) as y from (select *, v - avg(v) over (partition by user_id) as d from v where n >= 18)),
z as (select *, i // scale as seg from y, (select unnest(range(4, 17)) as scale) where scale < least(17, n // 2) and i // scale < n // scale),
g as (select user_id, scale, seg, sqrt(greatest(var_pop(y) - pow(covar_pop(y, i), 2) / var_pop(i), 0)) as rms from z group by all), f as (select user_id, scale, avg(rms) as f from g group by all having avg(rms) > 0)
select user_id, round(regr_slope(ln(f), ln(scale)), 5) as alpha1 from f group by user_id""")
def ts_dfa(spark, sf_dir):
    return ts.dfa_alpha(users(spark, sf_dir), ["user_id"])


def line_sql(key: str) -> str:
    """Metrics of edges e(key, i, j) with sizes z(key, cells)."""
    part = """{0}l as (select {1}, n, count(*) as c from (select {1}, count(*) as n from (select {1}, {2} as l, i - row_number() over (partition by {1}, {2} order by i) as g from e) group by {1}, l, g having count(*) >= 2) group by {1}, n),
{0}m as (select {1}, sum(n * c) as s, sum(n * c) * 1.0 / sum(c) as m, max(n) as x, sum(h) as h from (select *, -(c * 1.0 / sum(c) over (partition by {1})) * ln(c * 1.0 / sum(c) over (partition by {1})) as h from {0}l) group by {1})"""
    return f"""{part.format("d", key, "i - j")}, {part.format("w", key, "j")}, k as (select {key}, count(*) as e from e group by {key})
select {key}, round(coalesce(e * 1.0 / cells, 0), 6) as rr, round(coalesce(dm.s * 1.0 / e, 0), 6) as det, round(coalesce(dm.m, 0), 6) as mean_diag, cast(coalesce(dm.x, 0) as bigint) as max_diag, round(coalesce(dm.h, 0), 6) as entropy,
  round(coalesce(wm.s * 1.0 / e, 0), 6) as lam, round(coalesce(wm.m, 0), 6) as trapping_time, cast(coalesce(wm.x, 0) as bigint) as max_vert,
  round(coalesce(1.0 / dm.x, 0), 6) as div, round(coalesce(wm.h, 0), 6) as entropy_vert
from z left join k using ({key}) left join dm using ({key}) left join wm using ({key})"""


EMBED_SQL = "b as (select user_id, i, v, lead(v) over (partition by user_id order by i) as w, n, stddev_samp(v) over (partition by user_id) as sd from v)"


@query(S + f""", {USER_SQL}, {EMBED_SQL}, c as (select * from b where w is not null and n >= 10), z as (select user_id, count(*) * (count(*) - 1) as cells from c group by user_id),
e as (select x.user_id, x.i, y.i as j from c x join c y on x.user_id = y.user_id and x.i <> y.i and sqrt(pow(x.v - y.v, 2) + pow(x.w - y.w, 2)) <= greatest(0.1 * x.sd, 0.01)), {line_sql("user_id")}""")
def ts_rqa_auto(spark, sf_dir):
    rows = ts.embedded(users(spark, sf_dir).where("n >= 10"), ["user_id"])
    sizes = rows.groupBy("user_id").agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)).alias("cells"))
    edges = ts.recurrences(rows, rows, ["user_id"], ["v", "w"], F.greatest(F.col("a.sd") * 0.1, F.lit(0.01)), 1)
    return ts.line_metrics(edges, sizes, ["user_id"])


@query(S + f""", {USER_SQL}, c as (select user_id // 2 as dyad, user_id % 2 as side, i, v from v where n >= 10), r as (select dyad, 0.1 * sqrt((var_samp(v) filter (side = 0) + var_samp(v) filter (side = 1)) / 2) as r from c group by dyad),
z as (select dyad, count(*) filter (side = 0) * count(*) filter (side = 1) as cells from c group by dyad having count(distinct side) = 2),
e as (select x.dyad, x.i, y.i as j from c x join c y on x.dyad = y.dyad and x.side = 0 and y.side = 1 join r on r.dyad = x.dyad where abs(x.v - y.v) <= greatest(r.r, 0.01)), {line_sql("dyad")}""")
def ts_crqa(spark, sf_dir):
    rows = users(spark, sf_dir).where("n >= 10").withColumn("dyad", F.expr("user_id div 2"))
    one, two = F.when(F.col("user_id") % 2 == 0, F.col("v")), F.when(F.col("user_id") % 2 == 1, F.col("v"))
    pooled = rows.groupBy("dyad").agg((F.sqrt((F.var_samp(one) + F.var_samp(two)) / 2) * 0.1).alias("r"), (F.count(one) * F.count(two)).alias("cells")).where("cells > 0")
    left = rows.where("user_id % 2 = 0").join(pooled, "dyad")
    edges = ts.recurrences(left, rows.where("user_id % 2 = 1"), ["dyad"], ["v"], F.greatest(F.col("a.r"), F.lit(0.01)), 0)
    return ts.line_metrics(edges, pooled.select("dyad", "cells"), ["dyad"])


MD_SQL = f"""{PAIR_SQL}, y as (select dyad, i, (a - avg(a) over w) / stddev_samp(a) over w as v, (b - avg(b) over w) / stddev_samp(b) over w as w from q window w as (partition by dyad)),
d as (select x.dyad, x.i, o.i as j, sqrt(pow(x.v - o.v, 2) + pow(x.w - o.w, 2)) as d from y x join y o on x.dyad = o.dyad and x.i <> o.i),
t as (select dyad, greatest(quantile_cont(d, 0.05), 0.01) as eps from d where i < j group by dyad),
z as (select dyad, count(*) * (count(*) - 1) as cells from y group by dyad), e as (select d.dyad, i, j from d join t on t.dyad = d.dyad where d <= eps + 1e-9)"""


@query(S + f", {MD_SQL}, {line_sql('dyad')}")
def ts_mdrqa(spark, sf_dir):
    w = Window.partitionBy("dyad")
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / F.stddev_samp(c).over(w)
    rows = pairs(spark, sf_dir).select("dyad", "i", z("a").alias("v"), z("b").alias("w"))
    sizes = rows.groupBy("dyad").agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)).alias("cells"))
    x, o = rows.alias("x"), rows.alias("o")
    apart = F.sqrt(F.pow(F.col("x.v") - F.col("o.v"), 2) + F.pow(F.col("x.w") - F.col("o.w"), 2))
    far = x.join(o, (F.col("x.dyad") == F.col("o.dyad")) & (F.col("x.i") < F.col("o.i"))).select("x.dyad", F.col("x.i").alias("i"), F.col("o.i").alias("j"), apart.alias("d"))
    # the 5th percentile stands between two ranks: pairs are made and sorted once
    ranked = far.withColumn("k", F.row_number().over(w.orderBy("d"))).withColumn("at", (F.count(F.lit(1)).over(w) - 1) * 0.05)
    low, part = F.floor("at"), F.col("at") - F.floor("at")
    value = lambda k: F.max(F.when(F.col("k") == k, F.col("d"))).over(w)
    ranked = ranked.withColumn("eps", F.greatest(value(low + 1) * (1 - part) + F.coalesce(value(low + 2), F.lit(0.0)) * part, F.lit(0.01)))
    near = ranked.where("d <= eps + 1e-9")
    edges = near.select("dyad", "i", "j").unionAll(near.select("dyad", F.col("j").alias("i"), F.col("i").alias("j")))
    return ts.line_metrics(edges, sizes, ["dyad"])


#: The two series cut to one length, of ten points or more, and the radius over both together.
BOTH_SQL = """t as (select * from q where n >= 10), r as (select dyad, case when stddev_samp(v) > 0 then greatest(0.1 * stddev_samp(v), 0.01) else 0.1 end as r, any_value(n) as n from (select dyad, a as v, n from t union all select dyad, b, n from t) group by dyad)"""


def both_radius(rows: DataFrame) -> DataFrame:
    """(dyad, r, m): radius of pairs rows by the SD of both series together."""
    sd = F.stddev_samp("v")
    long = rows.select("dyad", "n", F.explode(F.array("a", "b")).alias("v"))
    return long.groupBy("dyad").agg(F.when(sd > 0, F.greatest(sd * 0.1, F.lit(0.01))).otherwise(0.1).alias("r"), F.max("n").alias("m"))


@query(S + f""", {PAIR_SQL}, {BOTH_SQL},
p as (select x.dyad, y.i - x.i as lag, avg(case when abs(x.a - y.b) <= r.r then 1.0 else 0.0 end) as rr from t x join t y on x.dyad = y.dyad and abs(y.i - x.i) <= 20 join r on r.dyad = x.dyad group by all),
k as (select dyad, max(rr) as peak, arg_min(lag, (-round(rr, 9), lag)) as lag, coalesce(max(rr) filter (lag = 0), 0) as los from p group by dyad)
select dyad, round(any_value(peak), 6) as peak, any_value(case when peak > 0 then k.lag else -20 end) as lag, any_value(case when peak > 0 then w else 40 end) as width, round(any_value(los), 6) as los
from k join (select p.dyad, max(p.lag) - min(p.lag) as w from p join k on k.dyad = p.dyad where p.rr >= k.peak / 2 group by p.dyad) using (dyad) group by dyad""")
def ts_dcrp(spark, sf_dir):
    """Share of recurrence by lag from -20 to 20: peak, its lag (the least on
    ties), width at half its height, and the line of synchrony."""
    rows = pairs(spark, sf_dir).where("n >= 10")
    left = rows.join(both_radius(rows), "dyad").withColumn("lag", F.explode(F.sequence(F.lit(-20), F.lit(20)))).select("dyad", (F.col("i") + F.col("lag")).alias("i"), "lag", "a", "r")
    hit = F.when(F.abs(F.col("a") - F.col("b")) <= F.col("r"), 1.0).otherwise(0.0)
    lags = left.join(rows.select("dyad", "i", "b"), ["dyad", "i"]).groupBy("dyad", "lag").agg(F.avg(hit).alias("rr")).withColumn("peak", F.max("rr").over(Window.partitionBy("dyad")))
    high = F.when(F.col("rr") >= F.col("peak") / 2, F.col("lag"))
    found = lags.groupBy("dyad").agg(
        F.max("peak").alias("peak"), F.min_by("lag", F.struct(-F.round("rr", 9), F.col("lag"))).alias("lag"), (F.max(high) - F.min(high)).alias("width"), F.coalesce(F.max(F.when(F.col("lag") == 0, F.col("rr"))), F.lit(0.0)).alias("los")
    )
    # lags beyond the series have a share of 0, which counts where the peak is 0 as well
    there = F.col("peak") > 0
    return found.select("dyad", F.round("peak", 6).alias("peak"), F.when(there, F.col("lag")).otherwise(-20).alias("lag"), F.when(there, F.col("width")).otherwise(40).alias("width"), F.round("los", 6).alias("los"))


WIN_SQL = "o as (select dyad, win, a, b from (select *, unnest(range(greatest(0, cast(ceil((i - 29) / 10.0) as bigint)), least(i // 10, (n - 30) // 10) + 1)) as win from q where n >= 30))"


@query(S + f""", {PAIR_SQL}, {WIN_SQL}, c as (select dyad, win, covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) as r from o group by dyad, win having stddev_pop(a) > 1e-6 and stddev_pop(b) > 1e-6)
select dyad, count(*) as windows, round(avg(r), 6) as mean, round(max(r), 6) as hi, round(min(r), 6) as lo, round(stddev_pop(r), 6) as sd, round(avg(case when r > 0 then 1.0 else 0.0 end), 6) as positive from c group by dyad""")
def ts_wcc(spark, sf_dir):
    windows = ts.windowed(pairs(spark, sf_dir), ["dyad"], 30, 10).groupBy("dyad", "win").agg(sc.corr("a", "b").alias("r")).where("r is not null")
    r = F.col("r")
    return windows.groupBy("dyad").agg(
        F.count(F.lit(1)).alias("windows"), F.round(F.avg(r), 6).alias("mean"), F.round(F.max(r), 6).alias("hi"), F.round(F.min(r), 6).alias("lo"), F.round(F.stddev_pop(r), 6).alias("sd"), F.round(F.avg(F.when(r > 0, 1.0).otherwise(0.0)), 6).alias("positive")
    )


def te_sql(name: str, source: str, target: str) -> str:
    return f"""{name}s as (select dyad, i, case when {source} > lag({source}) over w then 1 else 0 end as s, case when {target} > lag({target}) over w then 1 else 0 end as t from q window w as (partition by dyad order by i)),
{name}x as (select dyad, s, t, lead(t) over (partition by dyad order by i) as nx from {name}s where i > 0),
{name}j as (select dyad, nx, t, s, count(*) as c from {name}x where nx is not null group by all),
{name} as (select dyad, round(sum(h), 6) + 0.0 as te from (select dyad, c * 1.0 / sum(c) over (partition by dyad) * log2(c * sum(c) over (partition by dyad, t) * 1.0 / (sum(c) over (partition by dyad, t, s) * sum(c) over (partition by dyad, nx, t))) as h from {name}j) group by dyad)"""


@query(S + f""", {PAIR_SQL}, {te_sql("ab", "a", "b")}, {te_sql("ba", "b", "a")} select dyad, ab.te as d2m, ba.te as m2d, round(ab.te - ba.te, 5) + 0.0 as asymmetry from ab join ba using (dyad)""")
def ts_te(spark, sf_dir):
    both = pairs(spark, sf_dir)
    joined = ts.transfer_entropy(both, ["dyad"], "a", "b", "d2m").join(ts.transfer_entropy(both, ["dyad"], "b", "a", "m2d"), "dyad")
    return joined.select("dyad", (F.col("d2m") + 0.0).alias("d2m"), (F.col("m2d") + 0.0).alias("m2d"), (F.round(F.col("d2m") - F.col("m2d"), 5) + 0.0).alias("asymmetry"))


def trend_sql(c: str) -> str:
    return f"round(case when count(*) > 1 then regr_slope({c}, win) else 0 end, 9) + 0.0 as {c}_trend"


@query(f"""select dyad, round(avg(rr), 9) as rr_mean, round(stddev_pop(rr), 5) as rr_sd, {trend_sql("rr")}, round(avg(det), 9) as det_mean, round(stddev_pop(det), 5) as det_sd, {trend_sql("det")}, count(*) as n_windows from (
{S}, {PAIR_SQL}, {WIN_SQL.replace("dyad, win, a, b from (", "dyad, win, i, a, b from (")}, r as (select dyad, win, greatest(0.1 * sqrt((var_samp(a) + var_samp(b)) / 2), 0.01) as r from o group by dyad, win), z as (select dyad, win, count(*) * count(*) as cells from o group by dyad, win),
e as (select x.dyad, x.win, x.i, y.i as j from o x join o y on x.dyad = y.dyad and x.win = y.win join r on r.dyad = x.dyad and r.win = x.win where abs(x.a - y.b) <= r.r), {line_sql("dyad, win")}) group by dyad""")
def ts_wcrqa(spark, sf_dir):
    """Cross-recurrence in windows of 30 points, 10 apart: rate and determinism over time."""
    o = ts.windowed(pairs(spark, sf_dir), ["dyad"], 30, 10)
    keys = ["dyad", "win"]
    sizes = o.groupBy(*keys).agg(F.greatest(F.sqrt((F.var_samp("a") + F.var_samp("b")) / 2) * 0.1, F.lit(0.01)).alias("r"), (F.count(F.lit(1)) * F.count(F.lit(1))).alias("cells"))
    left = o.select(*keys, "i", F.col("a").alias("v")).join(sizes.select(*keys, "r"), keys)
    edges = ts.recurrences(left, o.select(*keys, "i", F.col("b").alias("v")), keys, ["v"], F.col("a.r"), 0)
    found = ts.line_metrics(edges, sizes.select(*keys, "cells"), keys).withColumn("win", F.col("win").cast("double"))
    trend = lambda c: (F.round(F.coalesce(sc.slope(F.col(c), F.col("win")), F.lit(0.0)), 9) + 0.0).alias(f"{c}_trend")
    each = [x for c in ("rr", "det") for x in (F.round(F.avg(c), 9).alias(f"{c}_mean"), F.round(F.stddev_pop(c), 5).alias(f"{c}_sd"), trend(c))]
    return found.groupBy("dyad").agg(*each, F.count(F.lit(1)).alias("n_windows"))


@query(f"""select dyad, max(rr) filter (k = 0) as rr, max(det) filter (k = 0) as det, round(avg(rr) filter (k > 0), 6) as null_rr, round(avg(det) filter (k > 0), 9) as null_det, round(stddev_pop(det) filter (k > 0), 5) as null_det_sd,
  round(case when stddev_pop(det) filter (k > 0) > 1e-9 then (max(det) filter (k = 0) - avg(det) filter (k > 0)) / stddev_pop(det) filter (k > 0) else 0 end, 3) + 0.0 as z from (
{S}, {PAIR_SQL}, t as (select * from q where n >= 10), c as (select dyad, greatest(0.1 * sqrt((var_samp(a) + var_samp(b)) / 2), 0.01) as r, any_value(n) as n from t group by dyad), turns as (select unnest(range(0, 21)) as k),
z as (select dyad, k, n * n as cells from c, turns), e as (select x.dyad, k, x.i, (y.i + case when k = 0 then 0 else c.n // 4 + (k - 1) * (c.n // 2) // 20 end) % c.n as j from t x join t y on x.dyad = y.dyad join c on c.dyad = x.dyad, turns where abs(x.a - y.b) <= c.r), {line_sql("dyad, k")}) group by dyad""")
def ts_surrogate(spark, sf_dir):
    """Cross-recurrence against 20 circular shifts of the second series, spaced
    evenly over [N/4, 3N/4). A shift moves the recurrent cells, so they are found
    once; their rate stays, their lines change."""
    rows = pairs(spark, sf_dir).where("n >= 10")
    sizes = rows.groupBy("dyad").agg(F.greatest(F.sqrt((F.var_samp("a") + F.var_samp("b")) / 2) * 0.1, F.lit(0.01)).alias("r"), F.max("n").alias("m"))
    left = rows.select("dyad", "i", F.col("a").alias("v")).join(sizes, "dyad")
    edges = ts.recurrences(left, rows.select("dyad", "i", F.col("b").alias("v")), ["dyad"], ["v"], F.col("a.r"), 0)
    every = F.explode(F.sequence(F.lit(0), F.lit(20)))
    shift = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.expr("m div 4 + (k - 1) * (m div 2) div 20"))
    moved = edges.join(sizes.select("dyad", "m"), "dyad").withColumn("k", every).withColumn("j", ((F.col("j") + shift) % F.col("m")).cast("int"))
    cells = sizes.select("dyad", (F.col("m") * F.col("m")).alias("cells"), every.alias("k"))
    found = ts.line_metrics(moved.select("dyad", "k", "i", "j"), cells, ["dyad", "k"])
    real, null = lambda c: F.max(F.when(F.col("k") == 0, F.col(c))), lambda c: F.when(F.col("k") > 0, F.col(c))
    mean, sd = F.avg(null("det")), F.stddev_pop(null("det"))
    return found.groupBy("dyad").agg(
        real("rr").alias("rr"), real("det").alias("det"), F.round(F.avg(null("rr")), 6).alias("null_rr"), F.round(mean, 9).alias("null_det"), F.round(sd, 5).alias("null_det_sd"),
        (F.round(F.when(sd > 1e-9, (real("det") - mean) / sd).otherwise(0.0), 3) + 0.0).alias("z"),
    )


CONVERGENCE_SQL = """m as (select dyad, role, cast(trial as bigint) * 500000000 + t as t, min(x) as x, min(y) as y from s where x between 0 and 651 and y between 0 and 900 group by all),
b as (select dyad, max(a) as a, min(b) as b from (select dyad, role, min(t) as a, max(t) as b from m group by all having count(*) >= 10) group by dyad having count(*) = 2),
g as (select dyad, unnest(range(a, b, 21600000)) as t from b), p as (select g.*, role from g, (values ('director'), ('matcher')) r(role)),
l as (select p.*, m.t as t0, m.x as x0, m.y as y0 from p asof join m on p.dyad = m.dyad and p.role = m.role and p.t >= m.t),
f as (select l.*, m.t as t1, m.x as x1, m.y as y1 from l asof join m on l.dyad = m.dyad and l.role = m.role and l.t <= m.t),
w as (select dyad, t, max(x) filter (role = 'director') as dx, max(y) filter (role = 'director') as dy, max(x) filter (role = 'matcher') as mx, max(y) filter (role = 'matcher') as my from
  (select dyad, role, t, case when t1 = t0 then x0 else x0 + (t - t0) * 1.0 / (t1 - t0) * (x1 - x0) end as x, case when t1 = t0 then y0 else y0 + (t - t0) * 1.0 / (t1 - t0) * (y1 - y0) end as y from f) group by all),
d as (select dyad, sqrt(pow(dx - mx, 2) + pow(dy - my, 2)) as d, row_number() over (partition by dyad order by t) as i from w)"""


@query(S + f""", {CONVERGENCE_SQL} select dyad, round(avg(d), 5) as mean, round(median(d), 5) as med, round(stddev_pop(d), 5) as sd, round(min(d), 5) as lo, round(max(d), 5) as hi, round(avg(case when d < 50 then 1.0 else 0.0 end), 6) as within50,
  round(avg(case when d < 100 then 1.0 else 0.0 end), 6) as within100, round(avg(case when d < 150 then 1.0 else 0.0 end), 6) as within150, round(case when count(*) > 2 then regr_slope(d, i) end, 5) + 0.0 as trend from d group by dyad having count(*) >= 10""")
def ts_convergence(spark, sf_dir):
    """Distance of both gazes on the map, on one grid of time over their overlap."""
    rows = samples(spark, sf_dir).where("x between 0 and 651 and y between 0 and 900")
    rows = rows.groupBy("dyad", "role", (F.col("trial").cast("long") * 500000000 + F.col("t")).alias("t")).agg(F.min("x").alias("x"), F.min("y").alias("y"))
    ends = rows.groupBy("dyad", "role").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n")).where("n >= 10")
    ends = ends.groupBy("dyad").agg(F.max("a").alias("_from"), F.min("b").alias("_to"), F.count(F.lit(1)).alias("_k")).where("_k = 2")
    both = rows.join(ends, "dyad")
    grid = lambda c: ts.on_grid(both, ["dyad", "role"], "t", c, F.max("_from"), F.max("_to"), 21600000, inclusive=False).withColumnRenamed("v", c)
    placed = grid("x").join(grid("y"), ["dyad", "role", "t"])
    side = lambda c, role: F.max(F.when(F.col("role") == role, F.col(c)))
    apart = F.sqrt(F.pow(side("x", "director") - side("x", "matcher"), F.lit(2)) + F.pow(side("y", "director") - side("y", "matcher"), F.lit(2)))
    d = placed.groupBy("dyad", "t").agg(apart.alias("d")).withColumn("i", F.row_number().over(Window.partitionBy("dyad").orderBy("t")).cast("double"))
    within = [F.round(F.avg(F.when(F.col("d") < k, 1.0).otherwise(0.0)), 6).alias(f"within{k}") for k in (50, 100, 150)]
    found = d.groupBy("dyad").agg(
        F.round(F.avg("d"), 5).alias("mean"), F.round(F.median("d"), 5).alias("med"), F.round(F.stddev_pop("d"), 5).alias("sd"), F.round(F.min("d"), 5).alias("lo"), F.round(F.max("d"), 5).alias("hi"), *within,
        (F.round(sc.slope(F.col("d"), F.col("i")), 5) + 0.0).alias("trend"), F.count(F.lit(1)).alias("_n"),
    )
    return found.where("_n >= 10").drop("_n")


@query(S + f""", {PAIR_SQL}, c as (select x.dyad, y.i - x.i as lag, covar_pop(x.a, y.b) / (stddev_pop(x.a) * stddev_pop(y.b)) as r from q x join q y on x.dyad = y.dyad and abs(y.i - x.i) <= 10 group by all having count(*) >= 10 and stddev_pop(x.a) > 1e-12 and stddev_pop(y.b) > 1e-12)
select dyad, round(max(r), 6) as peak, arg_min(lag, (-round(r, 6), lag)) as lag, case when arg_min(lag, (-round(r, 6), lag)) > 0 then 'director' when arg_min(lag, (-round(r, 6), lag)) < 0 then 'matcher' else 'none' end as leader from c group by dyad""")
def ts_coupling_lag(spark, sf_dir):
    profile = ts.lag_profile(pairs(spark, sf_dir), ["dyad"], 10, 10)
    lag = F.min_by("lag", F.struct(-F.round("r", 6), F.col("lag")))
    best = profile.groupBy("dyad").agg(F.round(F.max("r"), 6).alias("peak"), lag.alias("lag"))
    return best.withColumn("leader", F.when(F.col("lag") > 0, "director").when(F.col("lag") < 0, "matcher").otherwise("none"))


@query(S + f""", {ONE_SQL}, w as (select f.event_id, m.t, m.x, m.t between f.t + 100 and f.t + 150000000 as tight, count(*) filter (m.t between f.t + 100 and f.t + 150000000) over (partition by f.event_id) as k
  from u f join u m on f.dyad = m.dyad and f.trial = m.trial and f.role = m.role and m.t between f.t - 200000000 and f.t + 200000000),
r as (select event_id, t, lag(t) over v as before, (x - lag(x) over v) / (t - lag(t) over v) as rate, count(*) over (partition by event_id) as n from w where k < 3 or tight window v as (partition by event_id order by t))
select event_id, arg_min(before, (rate, t)) as onset from r where n >= 4 and rate < 0 group by event_id""")
def ts_flash_onset(spark, sf_dir):
    """The sample before the steepest fall after each sample."""
    rows = unique_times(spark, sf_dir)
    return al.flash_onset(rows.select(*SERIES, "t", "x"), rows.select(*SERIES, "event_id", F.col("t").alias("flash")), SERIES, "event_id", (100, 150000000), 200000000, 3, 4)


OFFSET_SQL = """f as (select dyad, trial, count(*) filter (event_type = 'view') as flashes, list(t order by t) filter (event_type = 'view') as views, list(t order by t) filter (event_type = 'signup') as edges,
  cast(trunc(avg(x - 60) filter (event_type = 'click')) as bigint) as lsl, arg_min(x, t) filter (event_type = 'error') as manual, list(x order by x) filter (event_type = 'view') as pupil, cast(trunc(avg(y - x) filter (event_type = 'purchase')) as bigint) as coarse from s group by dyad, trial),
o as (select *, case when flashes > 0 and coalesce(len(edges), 0) >= flashes * 2 // 3 and len(edges) > 0 then cast(trunc((list_sum(edges[1:least(len(edges), flashes)]) - list_sum(views[1:least(len(edges), flashes)])) / least(len(edges), flashes)) as bigint) end as ttl from f)"""


@query(S + f""", {OFFSET_SQL} select dyad, trial, case when lsl is not null and flashes > 0 then 'lsl' when ttl is not null then 'ttl' when manual is not null then 'manual' when flashes > 0 then 'pupil' when coarse is not null then 'coarse' else 'none' end as method,
  round(case when lsl is not null and flashes > 0 then lsl when ttl is not null then ttl when manual is not null then manual when flashes > 0 then pupil[len(pupil) // 2 + 1] - 250 when coarse is not null then coarse - 250 else 0 end, 6) as shift from o""")
def ts_offset_pick(spark, sf_dir):
    """Five sources of the clock offset; event types stand for them."""
    rows = samples(spark, sf_dir)
    kind = lambda k: F.col("event_type") == k
    flashes = rows.where(kind("view")).select(*TRIAL, F.col("t").alias("flash"))
    edges = rows.where(kind("signup")).select(*TRIAL, F.col("t").alias("edge"))
    pupil = rows.where(kind("view")).select(*TRIAL, F.col("x").alias("offset"))
    # means are cut to whole numbers: running sums in the order of events don't depend on how rows are dealt
    order = Window.partitionBy(*TRIAL).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    parts = {"lsl": F.when(kind("click"), F.col("x") - 60), "coarse": F.when(kind("purchase"), F.col("y") - F.col("x"))}
    summed = rows.select(*TRIAL, "event_id", "event_type", "t", "x", *(v.alias(c) for c, v in parts.items()), *(F.sum(v).over(order).alias(f"_{c}") for c, v in parts.items()))
    mean = lambda c: F.try_divide(F.max_by(f"_{c}", "event_id"), F.count(c)).alias(c)
    single = summed.groupBy(*TRIAL).agg(mean("lsl"), F.min_by("x", F.when(kind("error"), F.struct("t", "event_id"))).alias("manual"), mean("coarse"))
    found = al.offset_choice(single, flashes, edges, pupil, TRIAL)
    return found.select(*TRIAL, "method", F.round("shift", 6).alias("shift"))


COARSE_SQL = """a as (select dyad, cast(trial as bigint) * 500000000 + t as t, min(x) as p from s where role = 'director' and x > 0 group by all), f as (select dyad, cast(trial as bigint) * 500000000 + t as flash, row_number() over (partition by dyad order by trial, t) - 1 as k, count(*) over (partition by dyad) as n from (select distinct dyad, trial, t from s where event_type = 'purchase')),
d as (select dyad, t, p - avg(p) over w as drop, count(*) over w as later from a window w as (partition by dyad order by t range between 43200000 following and 172800000 following)),
z as (select dyad, any_value(n) as n, min(flash) as first from f group by dyad having count(*) >= 3),
e as (select d.dyad, d.t, z.n, row_number() over (partition by d.dyad order by drop desc, d.t) as r, count(*) over (partition by d.dyad) as all_drops from d join z using (dyad) where later >= 2 and drop > 20),
c as (select dyad, t, n from e where all_drops >= n and r <= 5 * n),
h as (select c.dyad, c.t as cand, f.k, any_value(f.flash) as flash, any_value(c.n) as n, case when f.k = 0 then c.t else min(o.t) end as hit from c join z using (dyad) join f on f.dyad = c.dyad left join c o on o.dyad = c.dyad and abs(o.t - (c.t + f.flash - z.first)) <= 86400000 group by c.dyad, c.t, f.k),
g as (select dyad, cand, any_value(n) as n, count(hit) as score, avg(hit - flash) as raw from h group by dyad, cand)
select dyad, arg_max(score, (score, -cand)) as score, cast(trunc(arg_max(raw, (score, -cand))) as bigint) as coarse from g group by dyad having max(score) >= greatest(3, any_value(n) * 2 // 3)"""


@query(S + f", {COARSE_SQL}")
def ts_coarse_offset(spark, sf_dir):
    """The director's x over all trials stands for the pupil, purchases for flashes."""
    at = (F.col("trial").cast("long") * 500000000 + F.col("t")).alias("t")
    rows = samples(spark, sf_dir)
    series = rows.where("role = 'director' and x > 0").select("dyad", at, "x").groupBy("dyad", "t").agg(F.min("x").alias("p"))
    flashes = rows.where("event_type = 'purchase'").select("dyad", at.alias("flash")).distinct()
    return al.coarse_offset(series, flashes, ["dyad"], (43200000, 172800000), 20.0, 86400000)


# ---- geometry


@query(S + f""", {STEP_SQL} select dyad, trial, role, round(sum(sqrt(dx * dx + dy * dy)), 4) as length, round(sqrt(pow(arg_max(x, (t, event_id)) - arg_min(x, (t, event_id)), 2) + pow(arg_max(y, (t, event_id)) - arg_min(y, (t, event_id)), 2)), 4) as displacement,
  round(quantile_cont(sqrt(dx * dx + dy * dy), 0.75), 5) as p75, round((max(x) - min(x)) * (max(y) - min(y)), 3) as box from d group by dyad, trial, role having count(*) > 1""")
def geo_stroke_kinematics(spark, sf_dir):
    from tandemlab.plans.basics import steps

    way, order = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), F.struct("t", "event_id")
    ends = [F.pow(F.max_by(c, order) - F.min_by(c, order), F.lit(2)) for c in ("x", "y")]
    rows = steps(spark, sf_dir).withColumn("way", way).groupBy(*SERIES).agg(
        F.round(F.sum("way"), 4).alias("length"), F.round(F.sqrt(ends[0] + ends[1]), 4).alias("displacement"), F.round(F.percentile("way", F.lit(0.75)), 5).alias("p75"),
        F.round((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")), 3).alias("box"), F.count(F.lit(1)).alias("_n"),
    )
    return rows.where("_n > 1").drop("_n")


PIXEL_SQL = "p as (select distinct dyad, trial, role, cast(floor(x / 20) as bigint) as px, cast(floor(y / 20) as bigint) as py from s where event_type <> 'error')"


def pixels(spark, sf_dir) -> DataFrame:
    return samples(spark, sf_dir).where("event_type <> 'error'").select(*SERIES, F.floor(F.col("x") / 20).alias("px"), F.floor(F.col("y") / 20).alias("py")).distinct()


@query(S + f""", {PIXEL_SQL}, c as (select dyad, trial, px, py, count(*) filter (role = 'director') as a, count(*) filter (role = 'matcher') as b from p group by all),
n as (select dyad, trial, sum(a) as na, sum(b) as nb, sum(a * b) as tp from c group by all)
select dyad, trial, round(tp * 1.0 / (na + nb - tp), 6) as iou, round(coalesce(tp * 1.0 / nullif(nb, 0), 0), 6) as precision, round(coalesce(tp * 1.0 / nullif(na, 0), 0), 6) as recall, round(2.0 * tp / (na + nb), 6) as f1 from n""")
def geo_pixel_metrics(spark, sf_dir):
    rows = pixels(spark, sf_dir).groupBy(*TRIAL, "px", "py").agg(F.count(F.when(F.col("role") == "director", 1)).alias("a"), F.count(F.when(F.col("role") == "matcher", 1)).alias("b"))
    n = rows.groupBy(*TRIAL).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(F.col("a") * F.col("b")).alias("tp"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, na, nb = F.col("tp"), F.col("na"), F.col("nb")
    return n.select(*TRIAL, share(tp, na + nb - tp).alias("iou"), share(tp, nb).alias("precision"), share(tp, na).alias("recall"), share(tp * 2, na + nb).alias("f1"))


NN_SQL = f"""{PIXEL_SQL}, n as (select a.dyad, a.trial, a.role, a.px, a.py, min(sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2))) as d from p a join p b on a.dyad = b.dyad and a.trial = b.trial and a.role <> b.role group by all)"""


@query(S + f""", {NN_SQL} select dyad, trial, round((avg(d) filter (role = 'director') + avg(d) filter (role = 'matcher')) / 2, 6) as chamfer, round(max(d), 6) as hausdorff from n group by dyad, trial""")
def geo_chamfer_hausdorff(spark, sf_dir):
    return grouped.mask_distances(pixels(spark, sf_dir), TRIAL, "dyad long, trial int", "role", ("director", "matcher"))


@query(S + f""", {PIXEL_SQL}, e as (select p.*, (select count(*) from p o where o.dyad = p.dyad and o.trial = p.trial and o.role = p.role and abs(o.px - p.px) <= 1 and abs(o.py - p.py) <= 1) < 9 as edge from p),
n as (select a.dyad, a.trial, a.role, a.px, a.py, bool_or(coalesce(sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) <= 2, false)) as hit from (select * from e where edge) a left join (select * from e where edge) b on a.dyad = b.dyad and a.trial = b.trial and a.role <> b.role group by all),
f as (select dyad, trial, coalesce(avg(hit::int) filter (role = 'matcher'), 0) as p, coalesce(avg(hit::int) filter (role = 'director'), 0) as r from n group by dyad, trial)
select dyad, trial, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as boundary_f from f""")
def geo_boundary_f(spark, sf_dir):
    p = pixels(spark, sf_dir)
    step = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    around = p.withColumn("s", F.explode(step)).select(*SERIES, (F.col("px") + F.col("s.a")).alias("px"), (F.col("py") + F.col("s.b")).alias("py"))
    edge = p.join(around.groupBy(*SERIES, "px", "py").agg(F.count(F.lit(1)).alias("n")), [*SERIES, "px", "py"]).where("n < 9").drop("n")
    # cells within 2 of a boundary cell, by offsets instead of pairs
    disc = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4))
    other = F.when(F.col("role") == "director", "matcher").otherwise("director")
    reach = edge.withColumn("s", F.explode(disc)).select(*TRIAL, other.alias("role"), (F.col("px") + F.col("s.a")).alias("px"), (F.col("py") + F.col("s.b")).alias("py")).distinct().withColumn("hit", F.lit(1.0))
    hits = edge.join(reach, [*SERIES, "px", "py"], "left").withColumn("hit", F.coalesce("hit", F.lit(0.0)))
    side = lambda role: F.coalesce(F.avg(F.when(F.col("role") == role, F.col("hit"))), F.lit(0.0))
    pr = hits.groupBy(*TRIAL).agg(side("matcher").alias("p"), side("director").alias("r"))
    return pr.select(*TRIAL, F.round(F.coalesce(F.try_divide(F.col("p") * F.col("r") * 2, F.col("p") + F.col("r")), F.lit(0.0)), 6).alias("boundary_f"))


@query(S + """, c as (select a.dyad, a.trial, sum(sign(a.x - b.x) * sign(a.t - b.t)) as s, count(*) as n, count(*) filter (a.x = b.x) as tx, count(*) filter (a.t = b.t) as tt from s a join s b on a.dyad = b.dyad and a.trial = b.trial and a.event_id < b.event_id group by all)
select dyad, trial, round(s / sqrt((n - tx) * 1.0 * (n - tt)), 6) + 0.0 as tau from c where tx < n and tt < n""")
def geo_kendall(spark, sf_dir):
    rows = samples(spark, sf_dir).select(*TRIAL, "t", "x")
    return grouped.rank_correlations(rows, TRIAL, "dyad long, trial int", "x", "t").where("tau is not null")


@query(S + """, d as (select a.dyad, a.trial, a.event_id, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) as d from s a join s b on a.dyad = b.dyad and a.trial = b.trial and a.event_id <> b.event_id group by all),
g as (select dyad, trial, (max(x) - min(x)) * (max(y) - min(y)) as area, count(*) as n from s group by all)
select dyad, trial, round(avg(d) / nullif(0.5 * sqrt(area / n), 0), 6) as nni from d join g using (dyad, trial) group by dyad, trial, area, n""")
def geo_scanpath_nni(spark, sf_dir):
    rows = samples(spark, sf_dir).select(*TRIAL, "event_id", "x", "y")
    near = joins.nearest_other(rows, TRIAL, "event_id").groupBy(*TRIAL).agg(F.avg("d").alias("d"))
    area = rows.groupBy(*TRIAL).agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"), F.count(F.lit(1)).alias("n"))
    return near.join(area, TRIAL).select(*TRIAL, F.round(F.try_divide(F.col("d"), 0.5 * F.sqrt(F.col("area") / F.col("n"))), 6).alias("nni"))


@query(S + f""", {STEP_SQL} select dyad, trial, role, round(sum(sqrt(dx * dx + dy * dy)), 4) as length, max(t) - min(t) as duration, round(case when max(t) > min(t) then sum(sqrt(dx * dx + dy * dy)) / ((max(t) - min(t)) / 1000.0) else 0 end, 8) as velocity
from d group by dyad, trial, role having count(*) > 1""")
def geo_scanpath(spark, sf_dir):
    from tandemlab.plans.basics import steps

    way = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    found = steps(spark, sf_dir).groupBy(*SERIES).agg(F.sum(way).alias("length"), (F.max("t") - F.min("t")).alias("duration"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    velocity = F.when(F.col("duration") > 0, F.col("length") / (F.col("duration") / 1000.0)).otherwise(0.0)
    return found.select(*SERIES, F.round("length", 4).alias("length"), "duration", F.round(velocity, 8).alias("velocity"))


# ---- statistics: outcome = the label's quality, score = n_chars, group = source

SCORE_SQL = "with o as (select d.doc_id, d.source, d.lang, d.n_chars as score, l.quality as label, l.toxic from documents d join labels l using (doc_id))\n"


def scored(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("n_chars").alias("score"))
    return docs.join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), "toxic"), "doc_id")


@query(SCORE_SQL + "select lang, round(count(*) filter (p.score > n.score) * 1.0 / count(*) + 0.5 * count(*) filter (p.score = n.score) / count(*), 8) as auc from o p join o n using (lang) where p.label = 1 and n.label = 0 group by lang")
def st_auc(spark, sf_dir):
    return st.roc_auc(scored(spark, sf_dir), "score", "label", ["lang"]).where("auc is not null")


@query(SCORE_SQL + """, c as (select score, count(*) as c, sum(label) as p from o group by score), r as (select *, sum(p) over (order by score desc) as tp, sum(c) over (order by score desc) as al, sum(p) over () as pos from c)
select round(sum(p * 1.0 / pos * tp / al), 8) as ap from r""")
def st_ap(spark, sf_dir):
    return st.average_precision(scored(spark, sf_dir), "score", "label")


@query(SCORE_SQL + "select lang, round(avg(pow(label - least(score / 5000.0, 1.0), 2)), 6) as brier, round(1 - sum(pow(label - least(score / 5000.0, 1.0), 2)) / nullif(sum(pow(label - m, 2)), 0), 6) as r2 from (select *, avg(label) over (partition by lang) as m from o) group by lang")
def st_brier(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("e", F.pow(F.col("label") - F.least(F.col("score") / 5000.0, F.lit(1.0)), F.lit(2)))
    mean = F.avg("label").over(Window.partitionBy("lang"))
    rows = rows.withColumn("s", F.pow(F.col("label") - mean, F.lit(2)))
    return rows.groupBy("lang").agg(F.round(F.avg("e"), 6).alias("brier"), F.round(1 - F.try_divide(F.sum("e"), F.sum("s")), 6).alias("r2"))


@query(SCORE_SQL + """, m as (select avg(score) filter (label = 1) as a, avg(score) filter (label = 0) as b, count(*) filter (label = 1) as n, count(*) filter (label = 0) as k, var_samp(score) filter (label = 1) as v, var_samp(score) filter (label = 0) as w,
  var_pop(score) filter (label = 1) as v0, var_pop(score) filter (label = 0) as w0 from o) select round((a - b) / sqrt(((n - 1) * v + (k - 1) * w) / (n + k - 2)), 6) as pooled, round((a - b) / sqrt((v + w) / 2), 6) as mean1, round((a - b) / sqrt((v0 + w0) / 2), 6) as mean0 from m""")
def st_cohen_d(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("_all", F.lit(1))
    each = [st.cohen_d(rows, "score", "label", ["_all"], v).withColumnRenamed("d", v) for v in ("pooled", "mean1", "mean0")]
    return each[0].join(each[1], "_all").join(each[2], "_all").drop("_all")


@query(SCORE_SQL + """, r as (select lang, score, label, rank() over (partition by lang order by score) + (count(*) over (partition by lang, score) - 1) / 2.0 as k, count(*) over (partition by lang, score) as c from o),
u as (select lang, sum(k) filter (label = 1) - count(*) filter (label = 1) * (count(*) filter (label = 1) + 1) / 2.0 as u, count(*) filter (label = 1) as n1, count(*) filter (label = 0) as n0, sum(c * c - 1.0) as ties from r group by lang),
z as (select lang, u, round(sign(u - n1 * n0 / 2.0) * greatest(abs(u - n1 * n0 / 2.0) - 0.5, 0) / nullif(sqrt(n1 * n0 / 12.0 * ((n1 + n0 + 1) - ties / nullif((n1 + n0) * (n1 + n0 - 1.0), 0))), 0), 6) as z from u),
p as (select *, 1 / (1 + 0.2316419 * abs(z)) as t from z), q as (select lang, u, z, round(2 * exp(-z * z / 2) / sqrt(2 * pi()) * ((((1.330274429 * t - 1.821255978) * t + 1.781477937) * t - 0.356563782) * t + 0.319381530) * t, 6) as p from p)
select *, case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else '' end as stars from q""")
def st_mwu(spark, sf_dir):
    found = st.mann_whitney(scored(spark, sf_dir), "score", "label", ["lang"]).withColumn("p", F.round(st.two_sided_p(F.col("z")), 6))
    return found.withColumn("stars", st.stars(F.col("p")))


@query(SCORE_SQL + """, w as (select source, count(*) as n, avg(label * 1.0) as p from o group by source), m as (select *, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) as c, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n) as h from w)
select source, n, round(p, 6) as p, round(greatest(c - h, 0), 6) as low, round(least(c + h, 1), 6) as high from m""")
def st_wilson(spark, sf_dir):
    return st.wilson(scored(spark, sf_dir), "label", ["source"])


@query(SCORE_SQL + "select distinct source, round((avg(score) over (partition by source) - avg(score) over ()) / stddev_samp(score) over (), 6) as z, round(avg(label) over (partition by source) - avg(label) over (), 6) + 0.0 as delta from o")
def st_signature(spark, sf_dir):
    rows = scored(spark, sf_dir)
    every = rows.agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("s"), F.avg("label").alias("l"))
    own = rows.groupBy("source").agg(F.avg("score").alias("a"), F.avg("label").alias("b"))
    return own.join(F.broadcast(every)).select("source", F.round((F.col("a") - F.col("m")) / F.col("s"), 6).alias("z"), (F.round(F.col("b") - F.col("l"), 6) + 0.0).alias("delta"))


@query(SCORE_SQL + """, c as (select cast(substr(source, 4) as int) % 4 as cluster, count(*) as n, avg(score) as hr, avg(toxic) as load from o group by 1),
a as (select cluster from c order by n, cluster limit 1), b as (select cluster from c where cluster not in (from a) order by hr, cluster limit 1), d as (select cluster from c where cluster not in (from a) and cluster not in (from b) order by load desc, cluster limit 1)
select cluster, case when cluster in (from a) then 'calm' when cluster in (from b) then 'matcher-disengaged' when cluster in (from d) then 'overloaded' else 'disengaged' end as name from c""")
def st_cluster_names(spark, sf_dir):
    """Names by rule, one pick after the other, over four rows."""
    cluster = F.regexp_extract("source", "([0-9]+)", 1).cast("int") % 4
    c = scored(spark, sf_dir).groupBy(cluster.alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("hr"), F.avg("toxic").alias("load")).withColumn("name", F.lit(None).cast("string"))
    open_first = F.col("name").isNotNull()
    for name, key in (("calm", F.col("n")), ("matcher-disengaged", F.col("hr")), ("overloaded", -F.col("load"))):
        nth = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(open_first, key, "cluster"))
        c = c.withColumn("_k", nth).withColumn("name", F.when((F.col("_k") == 1) & F.col("name").isNull(), name).otherwise(F.col("name")))
    return c.select("cluster", F.coalesce("name", F.lit("disengaged")).alias("name"))


VEC_SQL = "with e as (select vec_id, label, i as feature, round(cast(embedding[i] as double), 6) as v from embeddings, (select unnest(range(1, 65)) as i))\n"


def vectors(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("feature", "v"))
    return rows.select("vec_id", "label", (F.col("feature") + 1).cast("long").alias("feature"), F.round(F.col("v").cast("double"), 6).alias("v"))


@query(VEC_SQL + """, g as (select feature, label < 5 as c, count(*) as n, avg(v) as m, var_pop(v) as q from e group by all), t as (select *, sum(n * m) over (partition by feature) / sum(n) over (partition by feature) as mean from g)
select feature, round(sum(n * pow(m - mean, 2)) / (sum(n * q) / (sum(n) - 2)), 5) as f from t group by feature""")
def st_anova_f(spark, sf_dir):
    return st.anova_f(vectors(spark, sf_dir).withColumn("c", F.col("label") < 5), "feature", "v", "c")


@query(VEC_SQL + "select a.feature as a, b.feature as b, round(corr(a.v, b.v), 5) + 0.0 as r from e a join e b on a.vec_id = b.vec_id and a.feature < b.feature group by 1, 2")
def st_corr_pairs(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    both = rows.select("vec_id", F.col("feature").alias("a"), F.col("v").alias("x")).join(rows.select("vec_id", F.col("feature").alias("b"), F.col("v").alias("y")), "vec_id").where("a < b")
    return both.groupBy("a", "b").agg((F.round(sc.corr("x", "y"), 5) + 0.0).alias("r"))


@query("""with k as (select vec_id, label % 3 as c, embedding as v from embeddings), d as (select a.vec_id, a.c, b.c as o, avg(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(cast(z[1] as double) - cast(z[2] as double), 2))))) as m from k a join k b on a.vec_id <> b.vec_id group by all),
s as (select vec_id, max(m) filter (c = o) as a, min(m) filter (c <> o) as b from d group by vec_id) select round(avg((b - a) / greatest(a, b)), 5) as silhouette, count(*) as n from s""")
def st_silhouette(spark, sf_dir):
    """Euclidean silhouette of given clusters."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).alias("c"), "embedding")
    s = grouped.silhouettes(rows, "vec_id", "c", "embedding")
    return s.agg(F.round(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")), 5).alias("silhouette"), F.count(F.lit(1)).alias("n"))


@query(S + """, l as (select trial as seed, dyad as item, cast(floor(avg(x) / 20) as bigint) as c from s group by all) select a.item as a, b.item as b, round(count(*) * 1.0 / (select count(distinct seed) from l), 6) as share from l a join l b on a.seed = b.seed and a.c = b.c and a.item < b.item group by 1, 2""")
def st_coassign(spark, sf_dir):
    labels = samples(spark, sf_dir).groupBy(F.col("trial").alias("seed"), F.col("dyad").alias("item")).agg(F.floor(F.avg("x") / 20).alias("c"))
    return st.co_assignment(labels, "seed", "item", "c")


STABLE_SQL = """l as (select trial as seed, dyad as item, cast(floor(avg(x) / 20) as bigint) as c from s group by all), ref as (select item, c from l where seed = 3),
h as (select a.item as a, b.item as b, round(count(*) * 1.0 / (select count(distinct seed) from l), 6) as share from l a join l b on a.seed = b.seed and a.c = b.c and a.item < b.item group by 1, 2),
p as (select x.item as a, y.item as b, x.c = y.c as same from ref x join ref y on x.item < y.item)"""


@query(S + f", {STABLE_SQL} select round(coalesce(avg(coalesce(share, 0)) filter (same), 0), 6) as within, round(coalesce(avg(coalesce(share, 0)) filter (not same), 0), 6) as between from p left join h using (a, b)")
def st_stability(spark, sf_dir):
    """Clusters of dyads in six trials, the first of which is the reference."""
    labels = samples(spark, sf_dir).groupBy(F.col("trial").alias("seed"), F.col("dyad").alias("item")).agg(F.floor(F.avg("x") / 20).alias("cluster"))
    return st.class_stability(labels, "seed", "item", "cluster", 3)


@query(VEC_SQL + """, i as (select feature, ['drawing', 'gaze', 'hr', 'speech'][cast(feature % 4 + 1 as int)] as modality, round(abs(avg(v)), 6) as importance from e group by feature)
select modality, round(sum(importance), 5) as total, count(*) as n_features, arg_min(feature, (-importance, feature)) as max_feature, max(importance) as max_importance from i group by modality""")
def st_modality_importance(spark, sf_dir):
    """Importances (here the size of a dimension's mean) by modality."""
    names = F.array(*map(F.lit, ["drawing", "gaze", "hr", "speech"]))
    rows = vectors(spark, sf_dir).groupBy("feature").agg(F.round(F.abs(F.avg("v")), 6).alias("importance"))
    rows = rows.withColumn("modality", F.element_at(names, (F.col("feature") % 4 + 1).cast("int")))
    best = F.struct(-F.col("importance"), F.col("feature"))
    return rows.groupBy("modality").agg(F.round(F.sum("importance"), 5).alias("total"), F.count(F.lit(1)).alias("n_features"), F.min_by("feature", best).alias("max_feature"), F.max("importance").alias("max_importance"))


@query(SCORE_SQL + """, p as (select perm, o.source, o.doc_id, row_number() over (partition by perm, source order by doc_id) as a, row_number() over (partition by perm, source order by md5('7:' || perm || ':' || doc_id), doc_id) as b, label, score from o, (select unnest(range(0, 200)) as perm)),
m as (select x.perm, x.score, y.label from p x join p y on x.perm = y.perm and x.source = y.source and x.a = y.b),
r as (select perm, label, rank() over (partition by perm order by score) + (count(*) over (partition by perm, score) - 1) / 2.0 as k from m)
select cast(perm as int) as perm, round((sum(k) filter (label = 1) - count(*) filter (label = 1) * (count(*) filter (label = 1) + 1) / 2.0) / (count(*) filter (label = 1) * count(*) filter (label = 0)), 8) as auc from r group by perm""")
def st_perm_null(spark, sf_dir):
    rows = scored(spark, sf_dir)
    dealt = st.shuffled_within(rows.select("doc_id", "source", "label"), "source", "doc_id", "label", 200, 7)
    return st.roc_auc(dealt.join(rows.select("doc_id", "score"), "doc_id"), "score", "label", ["perm"])


@query(S + """, l as (select trial, t // 86400000 as win, case when event_type in ('click', 'view') then 1 else 0 end as label, x from s), g as (select trial, win, avg(x) filter (label = 1) as a, avg(x) filter (label = 0) as b, var_samp(x) filter (label = 1) as v, var_samp(x) filter (label = 0) as w, count(*) filter (label = 1) as n, count(*) filter (label = 0) as k from l group by all)
select trial, win, round(case when n < 5 or k < 5 then 0 else (a - b) / sqrt((v + w) / 2) end, 6) + 0.0 as d from g""")
def st_time_resolved_d(spark, sf_dir):
    rows = samples(spark, sf_dir).select("trial", F.expr("t div 86400000").alias("win"), F.col("event_type").isin("click", "view").cast("int").alias("label"), "x")
    sizes = rows.groupBy("trial", "win").agg(F.count(F.when(F.col("label") == 1, 1)).alias("n"), F.count(F.when(F.col("label") == 0, 1)).alias("k"))
    d = st.cohen_d(rows, "x", "label", ["trial", "win"], "mean1")
    return d.join(sizes, ["trial", "win"]).select("trial", "win", (F.when((F.col("n") < 5) | (F.col("k") < 5), 0.0).otherwise(F.col("d")) + 0.0).alias("d"))


# ---- dialogue

ACTS = "case when ends_with(trim(text), '?') then 'QUESTION' when length(text) < 40 then 'ACK' when role = 'system' then 'OTHER' else 'INFORM' end"


@query(f"with a as (select conv_id, {ACTS} as act, count(*) as c from conversations group by all) select conv_id, act, round(c * 1.0 / sum(c) over (partition by conv_id), 6) as share from a")
def txt_act_dist(spark, sf_dir):
    act = F.when(F.trim("text").endswith("?"), "QUESTION").when(F.length("text") < 40, "ACK").when(F.col("role") == "system", "OTHER").otherwise("INFORM")
    counts = read(spark, sf_dir, "conversations").groupBy("conv_id", act.alias("act")).agg(F.count(F.lit(1)).alias("c"))
    return counts.select("conv_id", "act", F.round(F.col("c") / F.sum("c").over(Window.partitionBy("conv_id")), 6).alias("share"))


@query("select event_id, case when k % 2 = 0 then k * 1.0 else k / 2.0 end as rating, round((k + case when k % 3 = 0 then 0 else k end) / (case when k % 3 = 0 then 1.0 else 2.0 end), 6) as conv from (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events)")
def txt_rating_flatten(spark, sf_dir):
    """Ratings that are numbers or {score}; the mean of the numeric conv_* fields."""
    k = sc.safe_long(F.get_json_object("props", "$.k"))
    rows = read(spark, sf_dir, "events").select("event_id", k.alias("k"))
    rating = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"r": '), F.col("k"), F.lit("}"))).otherwise(F.concat(F.lit('{"r": {"score": '), F.col("k") / 2.0, F.lit("}}")))
    conv = F.concat(F.lit('{"conv_a": '), F.col("k"), F.lit(', "conv_b": '), F.when(F.col("k") % 3 == 0, F.lit('"n/a"')).otherwise(F.col("k").cast("string")), F.lit("}"))
    v, c = F.parse_json(rating), F.parse_json(conv)
    number = lambda j, path: F.try_variant_get(j, path, "double")
    return rows.select(
        "event_id", F.coalesce(number(v, "$.r"), number(v, "$.r.score")).alias("rating"),
        F.round(F.coalesce(F.try_divide(F.coalesce(number(c, "$.conv_a"), F.lit(0.0)) + F.coalesce(number(c, "$.conv_b"), F.lit(0.0)), number(c, "$.conv_a").isNotNull().cast("int") + number(c, "$.conv_b").isNotNull().cast("int")), F.lit(0.0)), 6).alias("conv"),
    )
