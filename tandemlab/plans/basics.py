"""Cleaning, joins, aggregates, windows and islands over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandemlab.functions import scalars as sc
from tandemlab.operators import joins
from tandemlab.plans.registry import query
from tandemlab.sources.adapters import SAMPLE_AREAS, SAMPLES_SQL, read, samples

S = "with " + SAMPLES_SQL + "\n"
TRIAL = ["dyad", "trial"]
SERIES = ["dyad", "trial", "role"]

RAW_SQL = """raw as (select event_id, case when k % 5 = 0 then '' when k % 5 = 1 then 'n/a' when k % 5 = 2 then cast(k as varchar)
  when k % 5 = 3 then '-' || cast(k as varchar) || '.75' else 'inf' end as raw, k from (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events))"""


def raw_values(spark, sf_dir) -> DataFrame:
    k = sc.safe_long(F.get_json_object("props", "$.k"))
    text = k.cast("string")
    raw = F.when(k % 5 == 0, "").when(k % 5 == 1, "n/a").when(k % 5 == 2, text).when(k % 5 == 3, F.concat(F.lit("-"), text, F.lit(".75"))).otherwise("inf")
    return read(spark, sf_dir, "events").select("event_id", raw.alias("raw"), k.alias("k"))


@query(f"""with {RAW_SQL}
select event_id, case when isfinite(try_cast(raw as double)) then try_cast(raw as double) end as d,
  case when isfinite(try_cast(raw as double)) then cast(trunc(try_cast(raw as double)) as bigint) end as l from raw""")
def clean_safe_cast(spark, sf_dir):
    return raw_values(spark, sf_dir).select("event_id", sc.safe_double(F.col("raw")).alias("d"), sc.safe_long(F.col("raw")).alias("l"))


@query("""select event_id, case when k % 7 in (0, 2, 4) then 1 when k % 7 in (1, 3, 5) then 0 end as flag
from (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events)""")
def clean_to_bool(spark, sf_dir):
    words = F.array(*map(F.lit, ["True", "false", " yes", "No ", "1", "0", "maybe"]))
    return raw_values(spark, sf_dir).select("event_id", sc.to_bool(F.element_at(words, (F.col("k") % 7 + 1).cast("int"))).alias("flag"))


@query(f"""with {RAW_SQL} select event_id, case when k % 3 < 2 then cast(k as varchar) else 'warm-up' end as trial,
  'dyad_' || cast(k as varchar) || '_b' as dyad from raw""")
def clean_trial_norm(spark, sf_dir):
    k = F.col("k").cast("string")
    label = F.when(F.col("k") % 3 == 0, F.concat(F.lit("T0"), k)).when(F.col("k") % 3 == 1, k).otherwise("warm-up")
    ident = F.concat(F.lit(" Dyad "), k, F.lit("-B"))
    return raw_values(spark, sf_dir).select("event_id", sc.trial_label(label).alias("trial"), sc.normal_id(ident).alias("dyad"))


@query(S + """select dyad, trial, count(*) as n, case when trial not between 3 and 7 then 'trial out of range' when count(*) < 20 then 'too few samples' else 'kept' end as reason
from s group by dyad, trial""")
def clean_exclusion_log(spark, sf_dir):
    rows = samples(spark, sf_dir).groupBy(*TRIAL).agg(F.count(F.lit(1)).alias("n"))
    reason = F.when(~F.col("trial").between(3, 7), "trial out of range").when(F.col("n") < 20, "too few samples").otherwise("kept")
    return rows.withColumn("reason", reason)


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, cast(json_extract(props, '$.absent') as bigint) as absent from events")
def clean_json_props(spark, sf_dir):
    v = F.try_parse_json("props")
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.absent", "bigint").alias("absent"))


AREA_SQL = """case when x between 0 and 120 and y between 0 and 120 then 'timer' when role = 'matcher' then case when x between 80 and 280 and y between 100 and 700 then 'map' when x between 280 and 440 and y between 0 and 900 then 'toolbar' else 'other' end
  when x between 100 and 300 and y between 100 and 700 then 'map' when x between 280 and 420 and y between 0 and 900 then 'toolbar' else 'other' end"""


@query(S + f"select event_id, {AREA_SQL} as aoi from s")
def clean_aoi(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", sc.area_of(F.col("x"), F.col("y"), F.col("role"), SAMPLE_AREAS).alias("aoi"))


@query(S + """select event_id, round(u, 5) as u, round(v, 5) as v, round(x, 5) as x from
(select event_id, x, (x - 100) * 651 / 200.0 as u, (y - 100) * 900 / 600.0 as v from s) where u between 0 and 651 and v between 0 and 900""")
def clean_map_coords(spark, sf_dir):
    u, v = sc.to_map(F.col("x"), F.col("y"))
    rows = samples(spark, sf_dir).select("event_id", u.alias("u"), v.alias("v")).where("u between 0 and 651 and v between 0 and 900")
    x, _ = sc.from_map(F.col("u"), F.col("v"))
    return rows.select("event_id", F.round("u", 5).alias("u"), F.round("v", 5).alias("v"), F.round(x, 5).alias("x"))


@query(S + "select event_id, strftime(make_timestamp(t * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as iso, (t * 10000 + event_id * 7919 % 10000 + 116444736000000000) // 10000 - 11644473600000 as ms from s")
def clean_iso_time(spark, sf_dir):
    ticks = F.col("t") * 10000 + F.col("event_id") * 7919 % 10000 + 116444736000000000
    return samples(spark, sf_dir).select("event_id", sc.iso_time(F.col("t")).alias("iso"), sc.filetime_ms(ticks).alias("ms"))


@query(S + "select event_id, case when dyad % 3 = 0 then t else cast(round_even(t + (dyad % 3) * 1.25::double, 0) as bigint) end as t from (select event_id, dyad, t * 1 as t from s)")
def clean_clock_shift(spark, sf_dir):
    """Heart-rate times moved by their dyad's offset, halves to the even side."""
    return samples(spark, sf_dir).select("event_id", sc.shifted(F.col("t"), F.col("dyad") % 3 * 1.25).alias("t"))


# ---- joins


def spans(rows: DataFrame) -> DataFrame:
    """Per dyad: one closed span per purchase, two hours either way."""
    return rows.where("event_type = 'purchase'").select("dyad", (F.col("trial").cast("long") * 500000000 + F.col("t") - 7200000).alias("start"), (F.col("trial").cast("long") * 500000000 + F.col("t") + 7200000).alias("end"), F.concat(F.lit("p"), F.col("event_id")).alias("label"))


SPANS_SQL = """p as (select dyad, cast(trial as bigint) * 500000000 + t - 7200000 as start, cast(trial as bigint) * 500000000 + t + 7200000 as "end", 'p' || event_id as label from s where event_type = 'purchase'),
g as (select *, cast(trial as bigint) * 500000000 + t as at from s)"""


def timed(spark, sf_dir):
    return samples(spark, sf_dir).withColumn("at", F.col("trial").cast("long") * 500000000 + F.col("t"))


@query(S + f""", {SPANS_SQL}
select event_id, coalesce((select label from p where p.dyad = g.dyad and g.at between start and "end" order by start, label limit 1), 'none') as label from g""")
def join_trial_interval(spark, sf_dir):
    rows = timed(spark, sf_dir)
    return joins.first_interval(rows.select("event_id", "dyad", "at"), spans(rows), ["dyad"], "at", "start", "end", "label", 14400000, "event_id")


@query(S + f""", {SPANS_SQL} select label, count(*) as n, round(avg(x), 7) as mean_x from g join p on p.dyad = g.dyad and g.at between start and "end" group by label""")
def join_words_range(spark, sf_dir):
    rows = timed(spark, sf_dir)
    joined = joins.interval_join(rows.select("event_id", "dyad", "at", "x"), spans(rows), ["dyad"], "at", "start", "end", 14400000)
    return joined.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 7).alias("mean_x"))


ONE_SQL = "u as (select dyad, trial, role, t, min(x) as x, min(event_id) as event_id from s group by dyad, trial, role, t)"


def unique_times(spark, sf_dir) -> DataFrame:
    return samples(spark, sf_dir).groupBy(*SERIES, "t").agg(F.min("x").alias("x"), F.min("event_id").alias("event_id"), F.min("bpm").alias("bpm"), F.min("y").alias("y"))


@query(S + f""", {ONE_SQL}
select d.event_id, d.t, arg_min(m.t, abs(d.t - m.t) * 2 + (case when m.t > d.t then 1 else 0 end)) as near_t, round(arg_min(m.x, abs(d.t - m.t) * 2 + (case when m.t > d.t then 1 else 0 end)), 4) as x
from u d left join u m on d.dyad = m.dyad and d.trial = m.trial and m.role = 'matcher' and abs(d.t - m.t) < 14400000 where d.role = 'director' group by d.event_id, d.t""")
def join_asof_nearest(spark, sf_dir):
    rows = unique_times(spark, sf_dir)
    found = joins.asof_nearest(rows.where("role = 'director'"), rows.where("role = 'matcher'"), TRIAL, "t", "x", 14400000, "event_id")
    return found.withColumn("x", F.round("x", 4))


@query(S + """select event_id from s d where role = 'director' and exists (select 1 from s m where m.role = 'matcher' and m.dyad = d.dyad and m.trial = d.trial and m.t < d.t and (m.x - d.x) * (m.x - d.x) + (m.y - d.y) * (m.y - d.y) < 900.0)""")
def join_radius_semi(spark, sf_dir):
    rows = samples(spark, sf_dir).select("event_id", *SERIES, "t", "x", "y")
    return joins.within_radius(rows.where("role = 'director'"), rows.where("role = 'matcher'"), TRIAL, 30.0, F.col("r.t") < F.col("l.t"), "event_id")


ROUTE_SQL = "r as (select cast(i as int) as place, i * 10.0 as rx, abs(450.0 - i * 18.0) as ry from range(0, 50) g(i))"


@query(S + f""", {ROUTE_SQL}, d as (select event_id, place, sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry)) as distance from s, r)
select event_id, round(min(distance), 5) as distance, round(min(distance), 5) < 30 as on_route from d group by event_id""")
def join_nearest_neighbour(spark, sf_dir):
    route = spark.range(50).select(F.col("id").cast("int").alias("place"), (F.col("id") * 10.0).alias("x"), F.abs(450.0 - F.col("id") * 18.0).alias("y"))
    found = joins.nearest(samples(spark, sf_dir).select("event_id", "x", "y"), route, "event_id", "place")
    return found.select("event_id", F.round("distance", 5).alias("distance"), (F.round("distance", 5) < 30).alias("on_route"))


@query(S + f""", {ONE_SQL}, n as (select *, cast(row_number() over (partition by dyad, trial, role order by t) as int) as n from u)
select a.dyad, a.trial, a.n, a.t as left_t, b.t as right_t from n a join n b on a.dyad = b.dyad and a.trial = b.trial and a.n = b.n where a.role = 'director' and b.role = 'matcher'""")
def join_ordinal(spark, sf_dir):
    rows = unique_times(spark, sf_dir)
    return joins.by_ordinal(rows.where("role = 'director'"), rows.where("role = 'matcher'"), TRIAL, "t")


@query(S + """select dyad, trial, round(coalesce(max(case when role = 'director' then m end), -1), 7) as director_x, round(coalesce(max(case when role = 'matcher' then m end), -1), 7) as matcher_x,
  cast(sum(n) as double) as n_samples from (select dyad, trial, role, avg(x) as m, count(*) as n from s group by dyad, trial, role) group by dyad, trial""")
def join_feature_assembly(spark, sf_dir):
    rows = samples(spark, sf_dir)
    means = rows.groupBy(*SERIES).agg(F.avg("x").alias("value")).select(*TRIAL, F.lit(1).alias("source"), F.concat("role", F.lit("_x")).alias("feature"), "value")
    counts = rows.groupBy(*TRIAL).agg(F.count(F.lit(1)).cast("double").alias("value")).select(*TRIAL, F.lit(2).alias("source"), F.lit("n_samples").alias("feature"), "value")
    late = means.withColumn("source", F.lit(3)).withColumn("value", F.lit(-5.0))
    names = ["director_x", "matcher_x", "n_samples"]
    wide = joins.assemble(means.unionAll(counts).unionAll(late), TRIAL, names)
    return wide.select(*TRIAL, *(F.round(F.coalesce(n, F.lit(-1.0)), 7).alias(n) for n in names[:2]), "n_samples")


@query(S + "select distinct dyad, trial from s where (dyad, trial) not in (select (dyad, trial) from s group by dyad, trial having count(*) >= 20)")
def join_anti_excluded(spark, sf_dir):
    rows = samples(spark, sf_dir)
    kept = rows.groupBy(*TRIAL).agg(F.count(F.lit(1)).alias("n")).where("n >= 20")
    return rows.select(*TRIAL).distinct().join(kept, TRIAL, "left_anti")


@query("""select c_custkey, c_mktsegment, n_name, count(o_orderkey) as n_orders, round(coalesce(sum(o_totalprice), 0), 2) as total
from customer left join orders on o_custkey = c_custkey left join nation on n_nationkey = c_nationkey group by 1, 2, 3""")
def join_left_dimension(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    joined = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("c_custkey", "c_mktsegment", "n_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


# ---- aggregates


@query(S + """select dyad, trial, role, count(*) as n, round(avg(x), 7) as mean, round(coalesce(stddev_samp(x), 0), 5) as sd, round(coalesce(stddev_pop(x), 0), 5) as sd0, min(x) as lo, max(x) as hi,
  round(median(x), 5) as med, round(quantile_cont(x, 0.25), 5) as p25, round(quantile_cont(x, 0.95), 5) as p95 from s group by dyad, trial, role""")
def agg_descriptive(spark, sf_dir):
    pct = lambda p: F.round(F.percentile("x", p), 5)
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 5)
    return samples(spark, sf_dir).groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 7).alias("mean"), zero(F.stddev_samp("x")).alias("sd"), zero(F.stddev_pop("x")).alias("sd0"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        pct(0.5).alias("med"), pct(0.25).alias("p25"), pct(0.95).alias("p95"),
    )


@query(S + """, c as (select dyad, trial, cast(least(greatest(floor(x / 65.1), 0), 9) as int) as cx, cast(least(greatest(floor(y / 90.0), 0), 9) as int) as cy from s),
h as (select dyad, trial, count(*) * 1.0 / sum(count(*)) over (partition by dyad, trial) as p from c group by dyad, trial, cx, cy)
select dyad, trial, count(*) as cells, round(-sum(p * log2(p + 1e-12)), 6) as entropy, round(-sum(p * log2(p + 1e-12)) / log2(100.0), 6) as normalised from h group by dyad, trial""")
def agg_grid_entropy(spark, sf_dir):
    cell = lambda c, w: F.least(F.greatest(F.floor(F.col(c) / w), F.lit(0)), F.lit(9))
    cells = samples(spark, sf_dir).groupBy(*TRIAL, cell("x", 65.1).alias("cx"), cell("y", 90.0).alias("cy")).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(*TRIAL))
    h = cells.withColumn("h", -sc.plog2(p)).groupBy(*TRIAL).agg(F.count(F.lit(1)).alias("cells"), F.sum("h").alias("h"))
    return h.select(*TRIAL, "cells", F.round("h", 6).alias("entropy"), F.round(F.col("h") / F.log2(F.lit(100.0)), 6).alias("normalised"))


STEP_SQL = """d as (select dyad, trial, role, event_id, t, x, y, t - lag(t) over w as dt, x - lag(x) over w as dx, y - lag(y) over w as dy from s window w as (partition by dyad, trial, role order by t, event_id))"""


def steps(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy(*SERIES).orderBy("t", "event_id")
    rows = samples(spark, sf_dir)
    return rows.select(*SERIES, "event_id", "t", "x", "y", *((F.col(c) - F.lag(c).over(w)).alias(f"d{c}") for c in ("t", "x", "y")))


@query(S + f""", {STEP_SQL}, b as (select dyad, trial, role, case cast(least(floor((degrees(atan2(dy, dx)) + 180) / 45), 7) as int) when 0 then 'W' when 1 then 'NW' when 2 then 'N' when 3 then 'NE' when 4 then 'E' when 5 then 'SE' when 6 then 'S' else 'SW' end as bin from d where dx is not null)
select dyad, trial, role, bin, round(count(*) * 1.0 / sum(count(*)) over (partition by dyad, trial, role), 6) as share from b group by dyad, trial, role, bin""")
def agg_direction_bins(spark, sf_dir):
    names = F.array(*map(F.lit, ["W", "NW", "N", "NE", "E", "SE", "S", "SW"]))
    place = F.least(F.floor((sc.heading(F.col("dx"), F.col("dy")) + 180) / 45), F.lit(7)).cast("int")
    counts = steps(spark, sf_dir).where("dx is not null").groupBy(*SERIES, F.element_at(names, place + 1).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    return counts.select(*SERIES, "bin", F.round(F.col("c") / F.sum("c").over(Window.partitionBy(*SERIES)), 6).alias("share"))


@query(S + f""", a as (select dyad, trial, role, {AREA_SQL} as aoi, lag({AREA_SQL}) over (partition by dyad, trial, role order by t, event_id) as prev from s),
c as (select dyad, trial, role, prev, aoi, count(*) as c from a where prev <> aoi group by all),
p as (select dyad, trial, role, c, c * 1.0 / sum(c) over (partition by dyad, trial, role) as pij, c * 1.0 / sum(c) over (partition by dyad, trial, role, prev) as pc from c)
select dyad, trial, role, cast(sum(c) as bigint) as transitions, round(-sum(pij * log2(pc + 1e-12)), 6) + 0.0 as entropy from p group by dyad, trial, role""")
def agg_transition_entropy(spark, sf_dir):
    w = Window.partitionBy(*SERIES).orderBy("t", "event_id")
    rows = samples(spark, sf_dir).withColumn("aoi", sc.area_of(F.col("x"), F.col("y"), F.col("role"), SAMPLE_AREAS)).withColumn("prev", F.lag("aoi").over(w))
    counts = rows.where("prev <> aoi").groupBy(*SERIES, "prev", "aoi").agg(F.count(F.lit(1)).alias("c"))
    joint, given = F.col("c") / F.sum("c").over(Window.partitionBy(*SERIES)), F.col("c") / F.sum("c").over(Window.partitionBy(*SERIES, "prev"))
    h = counts.withColumn("h", -joint * F.log2(given + 1e-12))
    return h.groupBy(*SERIES).agg(F.sum("c").alias("transitions"), (F.round(F.sum("h"), 6) + 0.0).alias("entropy"))


@query(S + """select dyad, trial, round(case when var_pop(t) > 1e-12 then covar_pop(x, t) / var_pop(t) * 3600000 end, 6) as slope,
  round(case when stddev_pop(x) > 1e-12 and stddev_pop(y) > 1e-12 then covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) end, 6) as r, round(avg(case when x < 100 then 1.0 else 0.0 end), 6) as below from s group by dyad, trial""")
def agg_slope_corr(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("t", F.col("t").cast("double"))
    return rows.groupBy(*TRIAL).agg(
        F.round(sc.slope(F.col("x"), F.col("t")) * 3600000, 6).alias("slope"), F.round(sc.corr("x", "y"), 6).alias("r"), F.round(F.avg(F.when(F.col("x") < 100, 1.0).otherwise(0.0)), 6).alias("below")
    )


@query(S + """select coalesce(event_type, 'all') as mode, coalesce(cast(trial as varchar), 'all') as trial, count(*) as n, round(avg(x), 7) as mean from s group by rollup (event_type, trial)""")
def agg_rollup_mode_difficulty(spark, sf_dir):
    rows = samples(spark, sf_dir).rollup("event_type", "trial").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 7).alias("mean"))
    return rows.select(F.coalesce("event_type", F.lit("all")).alias("mode"), F.coalesce(F.col("trial").cast("string"), F.lit("all")).alias("trial"), "n", "mean")


@query(S + f"select event_type, {', '.join(f'round(avg(x) filter (trial = {k}), 7) as t{k}' for k in range(3, 9))} from s group by event_type")
def agg_pivot(spark, sf_dir):
    wide = samples(spark, sf_dir).groupBy("event_type").pivot("trial", list(range(3, 9))).agg(F.avg("x"))
    return wide.select("event_type", *(F.round(str(k), 7).alias(f"t{k}") for k in range(3, 9)))


MAP_SQL = "m as (select *, dyad % 12 as map from (select dyad, trial, avg(x) as score, min(y) as low, count(*) as n from s group by dyad, trial))"


def trials(spark, sf_dir) -> DataFrame:
    rows = samples(spark, sf_dir).groupBy(*TRIAL).agg(F.avg("x").alias("score"), F.min("y").alias("low"), F.count(F.lit(1)).alias("n"))
    return rows.withColumn("map", F.col("dyad") % 12)


@query(S + f""", {MAP_SQL} select dyad, trial, map, round(avg(score) over (partition by map), 5) as difficulty, count(*) over (partition by map) as n_trials, round(score - avg(score) over (partition by map), 5) + 0.0 as adjusted from m""")
def agg_map_difficulty(spark, sf_dir):
    rows = trials(spark, sf_dir)
    maps = rows.groupBy("map").agg(F.avg("score").alias("d"), F.count(F.lit(1)).alias("n_trials"))
    joined = rows.join(maps, "map", "left")
    return joined.select(*TRIAL, "map", F.round("d", 5).alias("difficulty"), "n_trials", (F.round(F.col("score") - F.col("d"), 5) + 0.0).alias("adjusted"))


@query(S + """, o as (select dyad, trial, list(t order by t) as l from s group by dyad, trial) select dyad, trial, l[len(l) // 2 + 1] as upper_median, list_max(l) - list_min(l) as spread from o""")
def agg_upper_median(spark, sf_dir):
    w = Window.partitionBy(*TRIAL)
    rows = samples(spark, sf_dir).select(*TRIAL, "t", F.row_number().over(w.orderBy("t")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    return rows.groupBy(*TRIAL).agg(F.max(F.when(F.expr("k = n div 2 + 1"), F.col("t"))).alias("upper_median"), (F.max("t") - F.min("t")).alias("spread"))


# ---- windows


@query(S + f""", {MAP_SQL} select dyad, trial, cast(dense_rank() over (partition by dyad order by round(score, 6)) as int) as rank, dense_rank() over (partition by dyad order by round(score, 6)) >= count(*) over (partition by dyad) - 1 as bottom,
  round(case when coalesce(stddev_samp(score) over (partition by dyad), 0) > 0 then (score - avg(score) over (partition by dyad)) / stddev_samp(score) over (partition by dyad) else 0 end, 5) + 0.0 as z from m""")
def win_rank_z(spark, sf_dir):
    w = Window.partitionBy("dyad")
    rank = F.dense_rank().over(w.orderBy(F.round("score", 6)))
    sd = F.coalesce(F.stddev_samp("score").over(w), F.lit(0.0))
    z = F.when(sd > 0, (F.col("score") - F.avg("score").over(w)) / sd).otherwise(0.0)
    return trials(spark, sf_dir).select(*TRIAL, rank.alias("rank"), (rank >= F.count(F.lit(1)).over(w) - 1).alias("bottom"), (F.round(z, 5) + 0.0).alias("z"))


@query(S + f""", {STEP_SQL} select event_id, round(case when dt > 0 then sqrt(dx * dx + dy * dy) / dt * 1000 end, 6) as speed, round(sum(coalesce(sqrt(dx * dx + dy * dy), 0)) over (partition by dyad, trial, role order by t, event_id), 4) as path from d""")
def win_velocity(spark, sf_dir):
    way = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    path = F.sum(F.coalesce(way, F.lit(0.0))).over(Window.partitionBy(*SERIES).orderBy("t", "event_id"))
    return steps(spark, sf_dir).select("event_id", F.round(F.when(F.col("dt") > 0, way / F.col("dt") * 1000), 6).alias("speed"), F.round(path, 4).alias("path"))


@query(S + """select event_id, round(case when count(*) over w >= 3 then avg(x) over w end, 7) as mean5, round(case when count(*) over c >= 2 then stddev_samp(x) over c end, 5) as sd4 from s
window w as (partition by dyad, trial, role order by t, event_id rows between 4 preceding and current row), c as (partition by dyad, trial, role order by t, event_id rows between 2 preceding and 1 following)""")
def win_rolling(spark, sf_dir):
    base = Window.partitionBy(*SERIES).orderBy("t", "event_id")
    w, c = base.rowsBetween(-4, 0), base.rowsBetween(-2, 1)
    mean, sd = F.when(F.count("x").over(w) >= 3, F.avg("x").over(w)), F.when(F.count("x").over(c) >= 2, F.stddev_samp("x").over(c))
    return samples(spark, sf_dir).select("event_id", F.round(mean, 7).alias("mean5"), F.round(sd, 5).alias("sd4"))


PACE_SQL = """e as (select dyad, trial, min(t) as a, greatest(1, (max(t) - min(t)) // 86400000) as n from s group by all having max(t) > min(t)),
b as (select s.dyad, s.trial, (t - a) // 86400000 as win, count(*) as n, sum(x) as total from s join e on s.dyad = e.dyad and s.trial = e.trial group by all),
g as (select dyad, trial, unnest(range(0, n)) as win from e), pace as (select dyad, trial, win, coalesce(n, 0) as n, coalesce(total, 0) as total from g left join b using (dyad, trial, win))"""


def pace_windows(spark, sf_dir) -> DataFrame:
    """(TRIAL, win, n, total): whole windows of a day from a trial's first sample
    to its last (one at least); the tail beyond them is in none."""
    rows = samples(spark, sf_dir)
    ends = rows.groupBy(*TRIAL).agg(F.min("t").alias("_a"), F.max("t").alias("_b")).where("_b > _a").withColumn("_n", F.greatest(F.lit(1), F.expr("(_b - _a) div 86400000")))
    spine = ends.withColumn("win", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).select(*TRIAL, "win")
    sums = rows.join(ends, TRIAL).withColumn("win", F.expr("(t - _a) div 86400000")).groupBy(*TRIAL, "win").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))
    return spine.join(sums, [*TRIAL, "win"], "left").select(*TRIAL, "win", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query(S + f", {PACE_SQL} select dyad, trial, win, n, round(total, 4) as total from pace")
def win_pace(spark, sf_dir):
    return pace_windows(spark, sf_dir).withColumn("total", F.round("total", 4))


@query(S + f", {PACE_SQL} select dyad, trial, count(*) as windows, round(avg(n), 6) as mean, round(case when count(*) > 1 then regr_slope(n, win) end, 6) + 0.0 as trend from pace group by dyad, trial")
def win_pace_trend(spark, sf_dir):
    rows = pace_windows(spark, sf_dir).withColumn("w", F.col("win").cast("double"))
    return rows.groupBy(*TRIAL).agg(F.count(F.lit(1)).alias("windows"), F.round(F.avg("n"), 6).alias("mean"), (F.round(sc.slope(F.col("n"), F.col("w")), 6) + 0.0).alias("trend"))


@query(S + """select dyad, trial, third, count(*) as n, round(avg(x), 7) as mean from s, (values (1, 0, 144000000), (2, 144000000, 288000000), (3, 288000000, 432000000)) v(third, a, b) where t between a and b group by dyad, trial, third""")
def win_thirds(spark, sf_dir):
    bounds = F.array(*(F.struct(F.lit(k + 1).alias("third"), F.lit(k * 144000000).alias("a"), F.lit((k + 1) * 144000000).alias("b")) for k in range(3)))
    rows = samples(spark, sf_dir).withColumn("v", F.explode(F.filter(bounds, lambda v: F.col("t").between(v["a"], v["b"]))))
    return rows.groupBy(*TRIAL, F.col("v.third").alias("third")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 7).alias("mean"))


@query(S + f""", {MAP_SQL}, e as (select quantile_cont(score, 1.0 / 3) as a, quantile_cont(score, 2.0 / 3) as b from m) select dyad, trial, case when score <= a then 'easy' when score <= b then 'medium' else 'hard' end as tertile from m, e""")
def win_tertiles(spark, sf_dir):
    """Scores of nine digits: equal ones stay equal in whatever order they were summed."""
    rows = trials(spark, sf_dir).withColumn("score", F.round("score", 9))
    edges = rows.agg(F.percentile("score", F.lit(1 / 3)).alias("a"), F.percentile("score", F.lit(2 / 3)).alias("b"))
    tertile = F.when(F.col("score") <= F.col("a"), "easy").when(F.col("score") <= F.col("b"), "medium").otherwise("hard")
    return rows.join(F.broadcast(edges)).select(*TRIAL, tertile.alias("tertile"))


@query(S + f""", {STEP_SQL} select dyad, trial, role, count(*) filter (dt > 0) as gaps, count(*) filter (dt > 43200000) as hesitations, coalesce(max(dt), 0) as longest from d group by dyad, trial, role""")
def win_gaps(spark, sf_dir):
    gap = F.col("dt")
    return steps(spark, sf_dir).groupBy(*SERIES).agg(F.count(F.when(gap > 0, 1)).alias("gaps"), F.count(F.when(gap > 43200000, 1)).alias("hesitations"), F.coalesce(F.max(gap), F.lit(0)).alias("longest"))


@query(S + f""", a as (select *, lag(aoi) over w as prev, count(*) over (partition by dyad, trial, role, aoi order by t, event_id) - 1 as seen from (select *, {AREA_SQL} as aoi from s) window w as (partition by dyad, trial, role order by t, event_id))
select dyad, trial, role, aoi, count(*) as n, count(*) filter (seen > 0 and prev <> aoi) as revisits, min(t) as first_t, round(count(*) * 1.0 / sum(count(*)) over (partition by dyad, trial, role), 6) as share from a group by dyad, trial, role, aoi""")
def win_revisits(spark, sf_dir):
    w = Window.partitionBy(*SERIES).orderBy("t", "event_id")
    rows = samples(spark, sf_dir).withColumn("aoi", sc.area_of(F.col("x"), F.col("y"), F.col("role"), SAMPLE_AREAS)).withColumn("prev", F.lag("aoi").over(w))
    rows = rows.withColumn("seen", F.row_number().over(Window.partitionBy(*SERIES, "aoi").orderBy("t", "event_id")) - 1)
    found = rows.groupBy(*SERIES, "aoi").agg(F.count(F.lit(1)).alias("n"), F.count(F.when((F.col("seen") > 0) & (F.col("prev") != F.col("aoi")), 1)).alias("revisits"), F.min("t").alias("first_t"))
    return found.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*SERIES)), 6))


# ---- islands


@query(S + """, f as (select *, event_type = 'error' as flag, lead(t) over w as next_t, max(t) over (partition by dyad, trial, role) as end_t, row_number() over w - row_number() over (partition by dyad, trial, role, event_type = 'error' order by t, event_id) as island from s window w as (partition by dyad, trial, role order by t, event_id))
select dyad, trial, role, min(t) as start, coalesce(arg_max(next_t, (t, event_id)), max(end_t)) - min(t) as duration, count(*) as n from f where flag group by dyad, trial, role, island""")
def isl_blinks(spark, sf_dir):
    w = Window.partitionBy(*SERIES).orderBy("t", "event_id")
    rows = samples(spark, sf_dir).withColumn("flag", F.col("event_type") == "error").withColumn("next_t", F.lead("t").over(w)).withColumn("end_t", F.max("t").over(Window.partitionBy(*SERIES)))
    rows = rows.withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*SERIES, "flag").orderBy("t", "event_id")))
    stop = F.coalesce(F.max_by("next_t", F.struct("t", "event_id")), F.max("end_t"))
    return rows.where("flag").groupBy(*SERIES, "island").agg(F.min("t").alias("start"), (stop - F.min("t")).alias("duration"), F.count(F.lit(1)).alias("n")).drop("island")


@query(S + """, f as (select *, t // 21600000 as idx from s) select dyad, trial, role, idx, round(avg(x), 7) as mean_x, round(avg(y), 7) as mean_y, max(t) - min(t) as duration, round(arg_min(x, (t, event_id)), 4) as first_x,
  round(sqrt(pow(arg_max(x, (t, event_id)) - arg_min(x, (t, event_id)), 2) + pow(arg_max(y, (t, event_id)) - arg_min(y, (t, event_id)), 2)), 4) as amplitude from f group by dyad, trial, role, idx""")
def isl_fixations(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("idx", F.expr("t div 21600000"))
    order = F.struct("t", "event_id")
    first, last = lambda c: F.min_by(c, order), lambda c: F.max_by(c, order)
    amplitude = F.sqrt(F.pow(last("x") - first("x"), F.lit(2)) + F.pow(last("y") - first("y"), F.lit(2)))
    return rows.groupBy(*SERIES, "idx").agg(
        F.round(F.avg("x"), 7).alias("mean_x"), F.round(F.avg("y"), 7).alias("mean_y"), (F.max("t") - F.min("t")).alias("duration"), F.round(first("x"), 4).alias("first_x"), F.round(amplitude, 4).alias("amplitude")
    )


@query(S + """select event_id, t from (select event_id, t, x, lag(x, 1, 0.0) over (partition by dyad, trial, role order by t, event_id) as prev from s) where prev <= 100 and x > 100""")
def isl_rising_edges(spark, sf_dir):
    before = F.lag("x", 1, 0.0).over(Window.partitionBy(*SERIES).orderBy("t", "event_id"))
    return samples(spark, sf_dir).withColumn("prev", before).where("prev <= 100 and x > 100").select("event_id", "t")


@query(S + """, r as (select *, row_number() over (partition by dyad, trial, role order by t, event_id) - row_number() over (partition by dyad, trial, role, x > 80 order by t, event_id) as island from s),
l as (select dyad, trial, role, island, count(*) as n from r where x > 80 group by all having count(*) >= 2)
select dyad, trial, role, count(*) as runs, max(n) as longest, round(avg(n), 7) as mean from l group by dyad, trial, role""")
def isl_runs(spark, sf_dir):
    w = Window.partitionBy(*SERIES)
    rows = samples(spark, sf_dir).withColumn("on", F.col("x") > 80)
    island = F.row_number().over(w.orderBy("t", "event_id")) - F.row_number().over(Window.partitionBy(*SERIES, "on").orderBy("t", "event_id"))
    runs = rows.withColumn("island", island).where("on").groupBy(*SERIES, "island").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return runs.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("runs"), F.max("n").alias("longest"), F.round(F.avg("n"), 7).alias("mean"))
