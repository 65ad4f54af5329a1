"""Drawings in time, motion and space, routes, pupils, clocks, and grids with gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandemlab.functions import scalars as sc
from tandemlab.operators import features as ft
from tandemlab.operators import grouped, joins, series
from tandemlab.plans.basics import ROUTE_SQL, SERIES, STEP_SQL, TRIAL, S, unique_times
from tandemlab.plans.registry import query
from tandemlab.sources.adapters import read, samples

DAY, DURATION = 86_400_000, 432_000_000

STROKE_SQL = f"g as (select dyad, trial, t // {DAY} as stroke, min(t) as a, max(t) as b from s group by all), h as (select *, a - lag(b) over (partition by dyad, trial order by a, b) as gap from g)"


def strokes(spark, sf_dir) -> DataFrame:
    """A day of a trial stands for a stroke: (TRIAL, stroke, a, b)."""
    return samples(spark, sf_dir).groupBy(*TRIAL, F.expr(f"t div {DAY}").alias("stroke")).agg(F.min("t").alias("a"), F.max("t").alias("b"))


@query(S + f""", {STROKE_SQL} select dyad, trial, cast(coalesce(sum(b - a) filter (b > a), 0) as bigint) as active, round(coalesce(sum(b - a) filter (b > a), 0) * 1.0 / {DURATION}, 8) as duty, round(avg(b - a) filter (b > a), 4) as dur_mean, median(b - a) filter (b > a) as dur_median,
  round(coalesce(stddev_samp(b - a) filter (b > a), case when count(*) filter (b > a) = 1 then 0 end), 4) as dur_sd, round(avg(gap) filter (gap > 0), 4) as gap_mean, max(gap) filter (gap > 0) as gap_max, count(*) filter (gap > 43200000) as hesitations, cast(coalesce(sum(gap) filter (gap > 43200000), 0) as bigint) as hesitation_ms
from h group by dyad, trial""")
def geo_drawing_time(spark, sf_dir):
    gap = F.col("a") - F.lag("b").over(Window.partitionBy(*TRIAL).orderBy("a", "b"))
    rows = strokes(spark, sf_dir).withColumn("gap", gap)
    dur = F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a"))
    wait, long = F.when(F.col("gap") > 0, F.col("gap")), F.when(F.col("gap") > 43200000, F.col("gap"))
    total = F.coalesce(F.sum(dur), F.lit(0))
    return rows.groupBy(*TRIAL).agg(
        total.alias("active"), F.round(total / DURATION, 8).alias("duty"), F.round(F.avg(dur), 4).alias("dur_mean"), F.median(dur).alias("dur_median"),
        F.round(F.coalesce(F.stddev_samp(dur), F.when(F.count(dur) == 1, 0.0)), 4).alias("dur_sd"), F.round(F.avg(wait), 4).alias("gap_mean"), F.max(wait).alias("gap_max"),
        F.count(long).alias("hesitations"), F.coalesce(F.sum(long), F.lit(0)).alias("hesitation_ms"),
    )


KIN_SQL = """v as (select *, case when dt > 1 then sqrt(dx * dx + dy * dy) / dt * 3600000 end as speed, dt / 3600000.0 as hours, lag(dx) over w as px, lag(dy) over w as py from d window w as (partition by dyad, trial, role order by t, event_id)),
c as (select dyad, trial, role, abs(px * (dy - py) - py * (dx - px)) / greatest(pow(px * px + py * py, 1.5), 1e-8) as curve from v where px is not null),
f as (select dyad, trial, role, (lead(speed) over (partition by dyad, trial, role order by t, event_id) - speed) / hours as accel from v where speed is not null),
q as (select dyad, trial, role, quantile_cont(curve, 0.99) as top from c group by all),
k as (select dyad, trial, role, avg(curve) as curve_mean, median(curve) as curve_median, max(curve) as curve_max from c join q using (dyad, trial, role) where curve < top group by all),
m as (select dyad, trial, role, quantile_cont(speed, 0.25) as speed_p25, median(speed) as speed_median, quantile_cont(speed, 0.75) as speed_p75, stddev_samp(speed) as speed_sd from v group by all having count(speed) > 0),
n as (select dyad, trial, role, avg(accel) as accel_mean, stddev_pop(accel) as accel_sd, max(abs(accel)) as accel_max from f group by all)"""


@query(S + f""", {STEP_SQL}, {KIN_SQL} select dyad, trial, role, round(speed_p25, 4) as speed_p25, round(speed_median, 4) as speed_median, round(speed_p75, 4) as speed_p75, round(speed_sd, 4) as speed_sd, round(accel_mean, 4) + 0.0 as accel_mean, round(accel_sd, 3) as accel_sd, round(accel_max, 4) as accel_max,
  round(curve_mean, 5) as curve_mean, round(curve_median, 6) as curve_median, round(curve_max, 5) as curve_max from m left join n using (dyad, trial, role) left join k using (dyad, trial, role)""")
def geo_kinematics(spark, sf_dir):
    """Speed (an hour), acceleration and curvature; curvatures of the top percent are left out."""
    rows = ft.kinematics(samples(spark, sf_dir).select(*SERIES, "event_id", "t", "x", "y"), SERIES, ["t", "event_id"])
    rows = rows.withColumn("v", F.col("speed") * 3600000).withColumn("g", F.col("acceleration") * 3600000 * 3600000)
    top = rows.groupBy(*SERIES).agg(F.percentile("curvature", F.lit(0.99)).alias("_top"))
    curve = F.when(F.col("curvature") < F.col("_top"), F.col("curvature"))
    pct = lambda p: F.round(F.percentile("v", F.lit(p)), 4)
    found = rows.join(top, SERIES).groupBy(*SERIES).agg(
        pct(0.25).alias("speed_p25"), pct(0.5).alias("speed_median"), pct(0.75).alias("speed_p75"), F.round(F.stddev_samp("v"), 4).alias("speed_sd"), (F.round(F.avg("g"), 4) + 0.0).alias("accel_mean"), F.round(F.stddev_pop("g"), 3).alias("accel_sd"),
        F.round(F.max(F.abs("g")), 4).alias("accel_max"), F.round(F.avg(curve), 5).alias("curve_mean"), F.round(F.median(curve), 6).alias("curve_median"), F.round(F.max(curve), 5).alias("curve_max"),
    )
    return found.where("speed_median is not null")


@query(S + f""", {STEP_SQL}, l as (select dyad, trial, sum(sqrt(dx * dx + dy * dy)) as length from d where event_type <> 'error' group by all), n as (select dyad, trial, count(*) as points, count(*) filter (event_type = 'error') as erase_points, count(distinct event_type) as widths, avg(length(event_type)) as width_mean, count(distinct role) as strokes from s group by all)
select dyad, trial, points - erase_points as draw_points, erase_points, round(case when length > 0 then strokes / length else 0 end, 8) as fragmentation, widths, round(width_mean, 6) as width_mean from n left join l using (dyad, trial)""".replace(
    "d as (select dyad, trial, role, event_id, t, x, y,", "d as (select dyad, trial, role, event_id, event_type, t, x, y,"
))
def geo_behaviour_more(spark, sf_dir):
    """Points, fragmentation (strokes a length; a role's samples are one) and pen widths (a type's name length)."""
    w = Window.partitionBy(*SERIES).orderBy("t", "event_id")
    rows = samples(spark, sf_dir).withColumn("way", F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), F.lit(2)) + F.pow(F.col("y") - F.lag("y").over(w), F.lit(2))))
    erase = F.col("event_type") == "error"
    found = rows.groupBy(*TRIAL).agg(
        F.count(F.when(~erase, 1)).alias("draw_points"), F.count(F.when(erase, 1)).alias("erase_points"), F.sum(F.when(~erase, F.col("way"))).alias("_l"), F.countDistinct("role").alias("_n"),
        F.countDistinct("event_type").alias("widths"), F.round(F.avg(F.length("event_type")), 6).alias("width_mean"),
    )
    fragments = F.when(F.col("_l") > 0, F.col("_n") / F.col("_l")).otherwise(0.0)
    return found.select(*TRIAL, "draw_points", "erase_points", F.round(fragments, 8).alias("fragmentation"), "widths", "width_mean")


@query(S + f""", {STEP_SQL}, e as (select dyad, trial, least(floor((degrees(atan2(dy, dx)) + 180) / 45), 7) as bin, count(*) as c from d where dx is not null group by all), p as (select dyad, trial, c * 1.0 / sum(c) over (partition by dyad, trial) as p from e),
h as (select dyad, trial, -sum(p * log2(p + 1e-12)) as entropy from p group by all), a as (select dyad, trial, count(distinct (cast(least(floor(x / 65.1), 9) as int), cast(least(floor(y / 90.0), 9) as int))) as cells, avg(x) as cx, avg(y) as cy, coalesce(stddev_samp(x), 0) as sx, coalesce(stddev_samp(y), 0) as sy, (max(x) - min(x)) * (max(y) - min(y)) as box from s group by all)
select dyad, trial, round(cx, 6) as centroid_x, round(cy, 6) as centroid_y, round(sx, 5) as spread_x, round(sy, 5) as spread_y, round(box, 3) as box, round(box / (651 * 900), 8) as coverage, round(cells / 100.0, 4) as grid_coverage, round(entropy, 6) + 0.0 as direction_entropy from a left join h using (dyad, trial)""")
def geo_space(spark, sf_dir):
    from tandemlab.plans.basics import steps

    place = F.least(F.floor((sc.heading(F.col("dx"), F.col("dy")) + 180) / 45), F.lit(7))
    bins = steps(spark, sf_dir).where("dx is not null").groupBy(*TRIAL, place.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    entropy = bins.withColumn("h", -sc.plog2(F.col("c") / F.sum("c").over(Window.partitionBy(*TRIAL)))).groupBy(*TRIAL).agg(F.sum("h").alias("h"))
    cell = F.struct(F.least(F.floor(F.col("x") / 65.1), F.lit(9)), F.least(F.floor(F.col("y") / 90.0), F.lit(9)))
    zero = lambda c: F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 5)
    box = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    found = samples(spark, sf_dir).groupBy(*TRIAL).agg(
        F.round(F.avg("x"), 6).alias("centroid_x"), F.round(F.avg("y"), 6).alias("centroid_y"), zero("x").alias("spread_x"), zero("y").alias("spread_y"), F.round(box, 3).alias("box"), F.round(box / (651 * 900), 8).alias("coverage"),
        F.round(F.countDistinct(cell) / 100.0, 4).alias("grid_coverage"),
    )
    return found.join(entropy, TRIAL, "left").select(*found.columns, (F.round("h", 6) + 0.0).alias("direction_entropy"))


def route(spark) -> DataFrame:
    return spark.range(50).select(F.col("id").cast("int").alias("place"), (F.col("id") * 10.0).alias("x"), F.abs(450.0 - F.col("id") * 18.0).alias("y"))


@query(S + f""", {ROUTE_SQL}, z as (select event_id, dyad, trial, role, t, min(round(sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry)), 6)) as d, arg_min(place, (round(sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry)), 6), place)) as place from s, r group by all),
n as (select *, row_number() over (partition by dyad, trial, role order by t, event_id) - 1 as i, count(*) over (partition by dyad, trial, role) as n from z)
select dyad, trial, role, round(avg(d), 5) as mean, round(median(d), 5) as med, round(stddev_pop(d), 5) as sd, round(avg(case when d < 30 then 1.0 else 0.0 end), 6) as on_route, round(case when stddev_pop(place) > 0 then corr(i, place) end, 5) + 0.0 as progress_r, case when stddev_pop(place) > 0 then (round(corr(i, place), 5) > 0.7)::int end as monotonic
from n where n >= 10 group by dyad, trial, role""")
def geo_route(spark, sf_dir):
    """Distance of gaze to the route, and whether it moves along it in time."""
    rows = samples(spark, sf_dir).select(*SERIES, "event_id", "t", "x", "y")
    w = Window.partitionBy(*SERIES)
    rows = rows.withColumn("i", F.row_number().over(w.orderBy("t", "event_id")).cast("double")).withColumn("n", F.count(F.lit(1)).over(w)).where("n >= 10")
    near = joins.nearest(rows, route(spark), "event_id", "place", 6)
    found = rows.join(near, "event_id").groupBy(*SERIES).agg(
        F.round(F.avg("distance"), 5).alias("mean"), F.round(F.median("distance"), 5).alias("med"), F.round(F.stddev_pop("distance"), 5).alias("sd"), F.round(F.avg(F.when(F.col("distance") < 30, 1.0).otherwise(0.0)), 6).alias("on_route"),
        (F.round(sc.corr("i", "place"), 5) + 0.0).alias("progress_r"),
    )
    return found.withColumn("monotonic", (F.col("progress_r") > 0.7).cast("int"))


ORDER_SQL = """k as (select dyad, trial, t // 86400000 as stroke, avg(x) as mx, avg(y) as my, min(t) as a from s group by all),
l as (select dyad, trial, t // 86400000 as stroke, sum(case when same then sqrt(dx * dx + dy * dy) else 0 end) as length from (select dyad, trial, t, x - lag(x) over w as dx, y - lag(y) over w as dy, lag(t // 86400000) over w = t // 86400000 as same from s window w as (partition by dyad, trial order by t, event_id)) group by all),
p as (select dyad, trial, stroke, a, arg_min(place, (round(sqrt((mx - rx) * (mx - rx) + (my - ry) * (my - ry)), 6), place)) as place from k, r group by all),
o as (select p.*, row_number() over w as i, lag(place) over w as before, sum(length) over (partition by dyad, trial order by a, stroke) as total from p join l using (dyad, trial, stroke) window w as (partition by dyad, trial order by a, stroke)),
c as (select x.dyad, x.trial, sum(sign(y.place - x.place)) as s, count(*) as n, count(*) filter (x.place = y.place) as ties from o x join o y on x.dyad = y.dyad and x.trial = y.trial and x.i < y.i group by all)"""


@query(S + f""", {ROUTE_SQL}, {ORDER_SQL} select dyad, trial, count(*) as strokes, round(max(total), 4) as length, round(case when stddev_pop(total) > 1e-9 then corr(i, total) end, 5) as growth_r, round(coalesce(any_value(s / nullif(sqrt(n * 1.0 * (n - ties)), 0)), 0), 6) + 0.0 as order_tau,
  round(count(*) filter (place > before) * 1.0 / (count(*) - 1), 6) as monotonic_pct from o left join c using (dyad, trial) group by dyad, trial having count(*) >= 2""")
def geo_progression(spark, sf_dir):
    """Strokes in order: how evenly their length grows, and whether the route
    points nearest to their middles come in the route's order."""
    rows = samples(spark, sf_dir).withColumn("stroke", F.expr(f"t div {DAY}"))
    w = Window.partitionBy(*TRIAL, "stroke").orderBy("t", "event_id")
    way = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), F.lit(2)) + F.pow(F.col("y") - F.lag("y").over(w), F.lit(2)))
    each = rows.withColumn("way", way).groupBy(*TRIAL, "stroke").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.min("t").alias("a"), F.coalesce(F.sum("way"), F.lit(0.0)).alias("length"))
    each = each.withColumn("ident", F.xxhash64(*TRIAL, "stroke"))
    order = Window.partitionBy(*TRIAL).orderBy("a", "stroke")
    placed = each.join(joins.nearest(each, route(spark), "ident", "place", 6), "ident").withColumn("i", F.row_number().over(order).cast("double"))
    placed = placed.withColumn("before", F.lag("place").over(order)).withColumn("total", F.sum("length").over(order))
    up = F.count(F.when(F.col("place") > F.col("before"), 1))
    found = placed.groupBy(*TRIAL).agg(
        F.count(F.lit(1)).alias("strokes"), F.round(F.max("total"), 4).alias("length"), F.round(F.when(F.stddev_pop("total") > 1e-9, sc.corr("i", "total")), 5).alias("growth_r"), F.round(F.try_divide(up, F.count(F.lit(1)) - 1), 6).alias("monotonic_pct")
    )
    tau = grouped.rank_correlations(placed.select(*TRIAL, F.col("place").cast("double").alias("place"), "i"), TRIAL, "dyad long, trial int", "place", "i")
    return found.where("strokes >= 2").join(tau, TRIAL, "left").select(*TRIAL, "strokes", "length", "growth_r", F.coalesce("tau", F.lit(0.0)).alias("order_tau"), "monotonic_pct")


@query(S + """, p as (select *, case when x > 0 and y > 0 then (x + y) / 2 when x > 0 then x when y > 0 then y end as p from s), b as (select dyad, role, avg(p) as base from p where trial = 3 group by all),
e as (select dyad, trial, role, avg(p) as m, coalesce(stddev_samp(p), 0) as sd, median(p) as med, count(p) * 1.0 / count(*) as valid, avg(x) filter (x > 0) as l, avg(y) filter (y > 0) as r, max(p) as hi from p group by all)
select dyad, trial, role, round(sd, 5) as sd, round(med, 6) as med, round(valid, 6) as valid, round(l, 6) as left_mean, round(r, 6) as right_mean, round(abs(l - r), 6) as asymmetry, round(base, 6) as base, round(m - base, 6) + 0.0 as corrected, round(hi - base, 6) + 0.0 as tepr from e left join b using (dyad, role)""")
def geo_pupil_baseline(spark, sf_dir):
    """Pupils of both eyes and their change against the person's first trial (3)."""
    rows = samples(spark, sf_dir).withColumn("p", sc.mean_pupil(F.col("x"), F.col("y")))
    base = rows.where("trial = 3").groupBy("dyad", "role").agg(F.avg("p").alias("base"))
    eye = lambda c: F.avg(F.when(F.col(c) > 0, F.col(c)))
    found = rows.groupBy(*SERIES).agg(
        F.avg("p").alias("m"), F.coalesce(F.stddev_samp("p"), F.lit(0.0)).alias("sd"), F.median("p").alias("med"), (F.count("p") / F.count(F.lit(1))).alias("valid"), eye("x").alias("l"), eye("y").alias("r"), F.max("p").alias("hi")
    )
    rounded = {"sd": F.round("sd", 5), "med": F.round("med", 6), "valid": F.round("valid", 6), "left_mean": F.round("l", 6), "right_mean": F.round("r", 6), "asymmetry": F.round(F.abs(F.col("l") - F.col("r")), 6), "base": F.round("base", 6)}
    return found.join(base, ["dyad", "role"], "left").select(*SERIES, *(c.alias(n) for n, c in rounded.items()), (F.round(F.col("m") - F.col("base"), 6) + 0.0).alias("corrected"), (F.round(F.col("hi") - F.col("base"), 6) + 0.0).alias("tepr"))


@query(S + """, m as (select dyad, (event_id % 2) as scope, role, case when event_id % 5 = 0 then role when role = 'director' then 'matcher' else 'director' end as peer, event_id % 4 as samples, x from s where event_type in ('signup', 'purchase') and (dyad % 2 = 0 or event_id % 2 = 1)),
o as (select dyad, scope, case when role = 'matcher' and peer = 'director' then x when role = 'director' and peer = 'matcher' then -x end as o from m where samples > 0), f as (select dyad, o from o join (select dyad, min(scope) as scope from o where o is not null group by dyad) using (dyad, scope) where o is not null),
l as (select dyad, list(o order by o) as l from f group by dyad) select dyad, round(coalesce(l[len(l) // 2 + 1], 0), 6) as "offset" from (select distinct dyad from m) left join l using (dyad)""")
def ts_clock_offset(spark, sf_dir):
    """Signups and purchases stand for measurements, even ids for the session's file."""
    rows = samples(spark, sf_dir).where("event_type in ('signup', 'purchase') and (dyad % 2 = 0 or event_id % 2 = 1)")
    other = F.when(F.col("role") == "director", "matcher").otherwise("director")
    measured = rows.select("dyad", (F.col("event_id") % 2).alias("scope"), "role", F.when(F.col("event_id") % 5 == 0, F.col("role")).otherwise(other).alias("peer"), (F.col("event_id") % 4).alias("samples"), F.col("x").alias("offset"))
    return ft.clock_offset(measured, ["dyad"]).withColumn("offset", F.round("offset", 6))


@query(S + """, b as (select dyad, min(x * 1000) filter (dyad % 3 = 0 and event_type = 'click' and x > 60) as hr, max(t) filter (event_type in ('purchase', 'signup')) as last from s group by dyad),
w as (select dyad, cast(trunc(coalesce(hr - 3600000, last - 14400000)) as bigint) as a, cast(trunc(coalesce(hr + 10800000, last + 3600000)) as bigint) as z from b) select dyad, a as start, z as "end", count(*) filter (t between a and z) as inside from s join w using (dyad) group by all""")
def clean_session_bounds(spark, sf_dir):
    """Every third dyad has heart-rate times, the others fall back to authoritative events."""
    rows = samples(spark, sf_dir)
    hr = F.when((F.col("dyad") % 3 == 0) & (F.col("event_type") == "click") & (F.col("x") > 60), F.col("x") * 1000)
    bounds = ft.session_bounds(rows, ["dyad"], hr, F.col("event_type").isin("purchase", "signup"))
    bounds = bounds.select("dyad", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    inside = F.count(F.when(F.col("t").between(F.col("start"), F.col("end")), 1))
    return rows.join(bounds, "dyad").groupBy("dyad", "start", "end").agg(inside.alias("inside"))


@query(S + """, u as (select dyad, trial, role, t, min(bpm) as v from s group by all), g as (select dyad, trial, role, unnest(range(0, 432000000, 43200000)) as t from (select distinct dyad, trial, role from s)),
l as (select g.*, u.t as t0, u.v as v0 from g asof left join u on g.dyad = u.dyad and g.trial = u.trial and g.role = u.role and g.t >= u.t), f as (select l.*, u.t as t1, u.v as v1 from l asof left join u on l.dyad = u.dyad and l.trial = u.trial and l.role = u.role and l.t <= u.t)
select dyad, trial, role, t, round(case when t1 = t0 then v0 else v0 + (t - t0) * 1.0 / (t1 - t0) * (v1 - v0) end, 5) as v from f""")
def ts_resample_gaps(spark, sf_dir):
    """One fixed grid for all recordings, null where a recording has not begun or has ended."""
    rows = unique_times(spark, sf_dir).select(*SERIES, "t", "bpm")
    return series.on_fixed_grid(rows, SERIES, "t", "bpm", 0, 432000000, 43200000).withColumn("v", F.round("v", 5))


@query(S + """, g as (select dyad % 4 as cluster, dyad, trial, role, unnest(range(0, 432000000, 43200000)) as t from (select distinct dyad, trial, role from s)), u as (select dyad, trial, role, t, min(bpm) as v from s group by all),
l as (select g.*, u.t as t0, u.v as v0 from g asof left join u on g.dyad = u.dyad and g.trial = u.trial and g.role = u.role and g.t >= u.t), f as (select l.*, u.t as t1, u.v as v1 from l asof left join u on l.dyad = u.dyad and l.trial = u.trial and l.role = u.role and l.t <= u.t),
i as (select cluster, t, case when t1 = t0 then v0 else v0 + (t - t0) * 1.0 / (t1 - t0) * (v1 - v0) end as v from f) select cluster, t, count(v) as n, round(avg(v), 5) as mean, round(coalesce(stddev_samp(v), 0), 4) as sd from i group by all having count(v) > 0""")
def st_mean_trace_grid(spark, sf_dir):
    rows = unique_times(spark, sf_dir).select(*SERIES, "t", "bpm")
    grid = series.on_fixed_grid(rows, SERIES, "t", "bpm", 0, 432000000, 43200000).where("v is not null")
    return grid.groupBy((F.col("dyad") % 4).alias("cluster"), "t").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 5).alias("mean"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 4).alias("sd"))


@query("""with t as (select conv_id, max(case when role = 'user' then trim(text) else '' end) as a, max(case when role = 'assistant' then trim(text) else '' end) as b from conversations group by conv_id)
select conv_id, case when a = '' and b = '' then 'empty_transcripts' end as eval_error, case when a <> '' or b <> '' then length(a) * 1.0::double end as n_director, case when (a <> '' or b <> '') and conv_id % 3 <> 0 then 'ok' end as tone, case when (a <> '' or b <> '') and conv_id % 3 = 0 then left(repeat(b, 3), 200) end as quality_error from t""")
def txt_scalars(spark, sf_dir):
    """Replies of an annotator as JSON: scalar fields stay, lists and objects go,
    errors are cut to 200 characters, empty transcripts aren't sent."""
    from tandemlab.operators import replies

    said = lambda role: F.max(F.when(F.col("role") == role, F.trim("text")).otherwise(""))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(said("user").alias("a"), said("assistant").alias("b"))
    reply = F.to_json(F.struct(F.length("a").alias("n_director"), F.lit("ok").alias("tone"), F.array(F.lit(1)).alias("acts"), F.struct(F.lit(1).alias("x")).alias("detail")))
    failed = F.col("conv_id") % 3 == 0
    asked = rows.select("conv_id", "a", "b", F.when(failed, F.to_json(F.struct(F.length("a").alias("n_director")))).otherwise(reply).alias("reply"), F.when(failed, F.repeat("b", F.lit(3))).alias("error"))
    found = replies.scalar_fields(asked, "reply", "error", {"n_director": "double", "tone": "string", "acts": "string", "detail": "string"}, "quality_error", (F.col("a") == "") & (F.col("b") == ""))
    return found.select("conv_id", "eval_error", "n_director", "tone", "quality_error")


@query("select event_id, cast(trunc((k / 8.0 + 1700000000.25) * 1000) as bigint) as received_ms from (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events)")
def str_receiver_clock(spark, sf_dir):
    """Stamps of the sender's stream clock as epoch times of the receiver."""
    from tandemlab.streaming import markers

    k = sc.safe_long(F.get_json_object("props", "$.k"))
    rows = read(spark, sf_dir, "events").select("event_id", (k / 8.0).alias("stamp"))
    return rows.select("event_id", markers.received_ms(F.col("stamp"), F.lit(1700000500.25), F.lit(500.0)).alias("received_ms"))
