"""Feature families and assembly steps over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tandemlab.functions import scalars as sc
from tandemlab.operators import features as ft
from tandemlab.operators import learn, series
from tandemlab.operators import stats as st
from tandemlab.plans.advanced import SCORE_SQL, scored
from tandemlab.plans.basics import AREA_SQL, SERIES, STEP_SQL, TRIAL, S, raw_values, steps, trials, unique_times
from tandemlab.plans.models import feature_table
from tandemlab.plans.registry import query
from tandemlab.sources.adapters import SAMPLE_AREAS, read, samples


@query(S + """, g as (select dyad, trial, t // 86400000 as stroke, min(x) as x0, max(x) as x1, max(y) as y1, count(*) as n from s group by all having count(*) >= 2), m as (select *, max(x1) over (partition by dyad, trial) as mx, max(y1) over (partition by dyad, trial) as my from g)
select dyad, trial, stroke, n, round(x1 * case when mx > 100 then 100 / 1024.0 else 1 end, 6) as right, round(y1 * case when my > 600 then 600 / 1024.0 else 1 end, 6) as bottom,
  round(3 * least(case when mx > 100 then 100 / 1024.0 else 1 end, case when my > 600 then 600 / 1024.0 else 1 end), 6) as width from m""")
def clean_stroke_scale(spark, sf_dir):
    rows = samples(spark, sf_dir).groupBy(*TRIAL, F.expr("t div 86400000").alias("stroke")).agg(F.collect_list(F.struct("x", "y", "t")).alias("points"))
    scaled = ft.rescaled(rows.withColumn("mode", F.lit("draw")).withColumn("width", F.lit(3.0)), TRIAL, 100, 600)
    most = lambda c: F.round(F.array_max(F.transform("points", lambda p: p[c])), 6)
    return scaled.select(*TRIAL, "stroke", F.size("points").cast("long").alias("n"), most("x").alias("right"), most("y").alias("bottom"), F.round("width", 6).alias("width"))


@query(S + """, b as (select dyad, trial, min(t) as a, max(t) as b from s where event_type = 'purchase' group by all) select event_id from s join b on s.dyad = b.dyad and s.trial = b.trial where t between a - 3600000 and b + 10800000""")
def clean_session_window(spark, sf_dir):
    return ft.session_window(samples(spark, sf_dir), F.col("event_type") == "purchase", TRIAL, 3600000, 10800000).select("event_id")


@query(S + """select dyad, trial, max(t) filter (event_type = 'purchase') as final_time, min(t) filter (event_type = 'click') as first_draw, arg_max(x, event_id) filter (event_type = 'signup') as last_success,
  coalesce(arg_max(y, event_id) filter (event_type = 'error'), arg_max(y, event_id) filter (event_type = 'signup'), arg_max(y, event_id)) as map_number from s group by dyad, trial""")
def clean_trial_meta(spark, sf_dir):
    kind = lambda k: F.col("event_type") == k
    return samples(spark, sf_dir).groupBy(*TRIAL).agg(
        F.max(F.when(kind("purchase"), F.col("t"))).alias("final_time"), F.min(F.when(kind("click"), F.col("t"))).alias("first_draw"), ft.last_of("x", kind("signup"), F.col("event_id")).alias("last_success"),
        F.coalesce(ft.last_of("y", kind("error"), F.col("event_id")), ft.last_of("y", kind("signup"), F.col("event_id")), F.max_by("y", "event_id")).alias("map_number"),
    )


@query("select event_id, cast(item as int) as item, cast(case when item % 2 = 0 then k + item else (k - item) / 2.0 end as double) as value from (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events), (select unnest(range(1, 9)) as item)")
def clean_items_flatten(spark, sf_dir):
    """Questionnaire payloads whose items are numbers or {itemNum, value}."""
    entries = [F.concat(F.lit(f'"{n}": '), F.when(F.lit(n % 2 == 0), (F.col("k") + n).cast("string")).otherwise(F.concat(F.lit('{"itemNum": %d, "value": ' % n), ((F.col("k") - n) / 2.0).cast("string"), F.lit("}")))) for n in range(1, 9)]
    rows = raw_values(spark, sf_dir).select("event_id", F.parse_json(F.concat(F.lit("{"), F.concat_ws(", ", *entries), F.lit("}"))).alias("p"))
    items = rows.select("event_id", "p", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("item"))
    each = F.coalesce(*(F.when(F.col("item") == n, F.coalesce(F.try_variant_get("p", f"$['{n}']", "double"), F.try_variant_get("p", f"$['{n}'].value", "double"))) for n in range(1, 9)))
    return items.select("event_id", "item", each.alias("value"))


NAMES = ("director_hr_mean", "matcher_fix_n", "rqa_det", "director_stroke_len", "speech_rate", "chamfer", "dcrp_lag", "tlx_mental", "matcher_target_hr_x")


@query("""select * from (values ('director_hr_mean', 'hr', 'D', false), ('matcher_fix_n', 'gaze', 'M', false), ('rqa_det', 'joint', 'J', false), ('director_stroke_len', 'drawing', 'D', false), ('speech_rate', 'speech', 'J', false),
  ('chamfer', 'other', 'J', true), ('dcrp_lag', 'joint', 'J', false), ('tlx_mental', 'other', 'J', false), ('matcher_target_hr_x', 'hr', 'M', true)) t(feature, modality, side, is_leak)""")
def clean_catalogue(spark, sf_dir):
    return ft.catalogue(spark.createDataFrame([(n,) for n in NAMES], "feature string"))


@query(S + "select dyad, event_id, t, x from (select *, row_number() over (partition by dyad order by x desc, event_id) as n from s) where n <= 5")
def win_top_k(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("dyad").orderBy(F.desc("x"), "event_id"))
    return samples(spark, sf_dir).withColumn("n", nth).where("n <= 5").select("dyad", "event_id", "t", "x")


@query(S + "select event_id from (select *, row_number() over (partition by dyad, trial, role order by event_type <> 'error', md5('3:' || event_id), event_id) as n from s) where n <= 3")
def win_seeded_sample(spark, sf_dir):
    """Three failures of each series by a seeded hash; successes fill up where there are fewer."""
    nth = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.col("event_type") != "error", F.md5(F.concat(F.lit("3:"), F.col("event_id")).cast("binary")), "event_id"))
    return samples(spark, sf_dir).withColumn("n", nth).where("n <= 3").select("event_id")


@query(S + """, k as (select dyad, trial, event_type from s group by all having count(distinct role) = 2) select dyad, trial, string_agg(event_type, ',' order by event_type) as common, count(*) as n from k group by dyad, trial""")
def agg_common_types(spark, sf_dir):
    """What both roles of a trial have: an intersection of two sets of five types."""
    kinds = lambda role: F.collect_set(F.when(F.col("role") == role, F.col("event_type")))
    rows = samples(spark, sf_dir).groupBy(*TRIAL).agg(kinds("director").alias("a"), kinds("matcher").alias("b")).select(*TRIAL, F.array_sort(F.array_intersect("a", "b")).alias("c"))
    return rows.where(F.size("c") > 0).select(*TRIAL, F.concat_ws(",", "c").alias("common"), F.size("c").cast("long").alias("n"))


@query("""with r as (select event_id, case when k % 5 = 2 then k * 1.0::double when k % 5 = 3 then -(k + 0.75)::double end as d, k from (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events)) select event_id, d, nullif(k % 3, 0) as m from r where d is not null and k % 3 <> 0""")
def clean_drop_missing(spark, sf_dir):
    """Rows that lack any of the columns asked for go; the others stay whole."""
    rows = raw_values(spark, sf_dir).select("event_id", sc.safe_double(F.col("raw")).alias("d"), F.nullif(F.col("k") % 3, F.lit(0)).alias("m"))
    return rows.dropna(subset=["d", "m"])


@query(S + """, d as (select distinct dyad from s), f as (select dyad, case dyad % 3 when 0 then 'dyad ' || dyad || '-b' when 1 then 'DYAD_' || dyad || '_B' else 'Dyad-' || dyad || ' B' end as folder from d where dyad % 5 <> 4)
select d.dyad, f.folder from d left join f on translate(lower(trim(f.folder)), ' -', '__') = 'dyad_' || d.dyad || '_b'""")
def join_directory(spark, sf_dir):
    """Folders find their dyad however their names are written."""
    dyads = samples(spark, sf_dir).select("dyad").distinct()
    n = F.col("dyad")
    name = F.when(n % 3 == 0, F.concat(F.lit("dyad "), n, F.lit("-b"))).when(n % 3 == 1, F.concat(F.lit("DYAD_"), n, F.lit("_B"))).otherwise(F.concat(F.lit("Dyad-"), n, F.lit(" B")))
    folders = dyads.where(n % 5 != 4).select(name.alias("folder")).withColumn("_key", sc.normal_id(F.col("folder")))
    return dyads.withColumn("_key", F.concat(F.lit("dyad_"), n, F.lit("_b"))).join(folders, "_key", "left").select("dyad", "folder")


@query(SCORE_SQL + """, g as (select source, lang, avg(score) as v from o group by all), p as (select source, lang, v / sum(v) over (partition by source) as share from g)
select source, """ + ", ".join(f"round(coalesce(max(share) filter (lang = '{c}'), 0), 6) as {c}" for c in ("de", "en", "es", "fr")) + " from p group by source")
def st_share_pivot(spark, sf_dir):
    """The shares side by side, 0 where a source has none."""
    rows = scored(spark, sf_dir).groupBy("source", "lang").agg(F.avg("score").alias("v"))
    shares = rows.withColumn("share", F.col("v") / F.sum("v").over(Window.partitionBy("source")))
    wide = shares.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.first("share"))
    return wide.select("source", *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("de", "en", "es", "fr")))


@query(S + "select event_id from (select *, row_number() over (partition by dyad, trial, role, t // 21600000 order by t, event_id) as n from s) where n = 1")
def isl_downsample(spark, sf_dir):
    return ft.downsample(samples(spark, sf_dir), SERIES, "t", 21600000, "event_id").select("event_id")


@query(S + "select event_id, (case when event_type = 'error' then null else x end < 20 and y < 200) is true or (event_type = 'error' and y < 300) as blink from s")
def isl_blink_rule(spark, sf_dir):
    gaze = F.when(F.col("event_type") != "error", F.col("x"))
    pupil = F.when(F.col("y") >= 300, F.col("y"))
    return samples(spark, sf_dir).select("event_id", ft.is_blink(gaze / 100, F.col("y") / 1000, pupil, pupil, gaze, 0.2).alias("blink"))


@query(S + """, u as (select dyad, trial, role, t, min(bpm) as v from s group by all), b as (select dyad, trial, max(a) as a, min(b) as b from (select dyad, trial, role, min(t) as a, max(t) as b from u group by all) group by all having count(*) = 2),
g as (select dyad, trial, unnest(range(a, b, 21600000)) as t from b), p as (select g.*, role from g, (values ('director'), ('matcher')) r(role)),
l as (select p.*, u.t as t0, u.v as v0 from p asof join u on p.dyad = u.dyad and p.trial = u.trial and p.role = u.role and p.t >= u.t),
f as (select l.*, u.t as t1, u.v as v1 from l asof join u on l.dyad = u.dyad and l.trial = u.trial and l.role = u.role and l.t <= u.t),
w as (select dyad, trial, t, max(v) filter (role = 'director') as d, max(v) filter (role = 'matcher') as m from (select *, case when t1 = t0 then v0 else v0 + (t - t0) * 1.0 / (t1 - t0) * (v1 - v0) end as v from f) group by all)
select dyad, trial, count(*) as n, round(covar_pop(d, m) / (stddev_pop(d) * stddev_pop(m)), 5) + 0.0 as r from w group by all having count(*) >= 5 and stddev_pop(d) > 1e-9 and stddev_pop(m) > 1e-9""")
def ts_crossmodal_corr(spark, sf_dir):
    """Two series on one grid over their overlap, end exclusive."""
    rows = unique_times(spark, sf_dir).select(*SERIES, "t", "bpm")
    ends = rows.groupBy(*SERIES).agg(F.min("t").alias("a"), F.max("t").alias("b")).groupBy(*TRIAL).agg(F.max("a").alias("_from"), F.min("b").alias("_to"), F.count(F.lit(1)).alias("_k")).where("_k = 2")
    grid = _overlap_grid(rows, ends)
    wide = grid.groupBy(*TRIAL, "t").agg(F.max(F.when(F.col("role") == "director", F.col("v"))).alias("d"), F.max(F.when(F.col("role") == "matcher", F.col("v"))).alias("m"))
    found = wide.groupBy(*TRIAL).agg(F.count(F.lit(1)).alias("n"), F.round(sc.corr("d", "m"), 5).alias("r"))
    return found.where("n >= 5 and r is not null").withColumn("r", F.col("r") + 0.0)


def _overlap_grid(rows, ends):
    return series.on_grid(rows.join(ends, TRIAL), SERIES, "t", "bpm", F.max("_from"), F.max("_to"), 21600000, inclusive=False)


@query(S + f""", {STEP_SQL}, k as (select *, case when dt > 1 then sqrt(dx * dx + dy * dy) / dt * 3600000 end as speed from d)
select dyad, trial, role, round(avg(speed), 4) as mean, round(quantile_cont(speed, 0.95), 4) as p95, round(max(speed), 4) as top, round(avg(case when dt > 1 then abs(degrees(atan2(dy, dx))) end), 5) as turn from k group by all having count(speed) > 0""")
def geo_speed(spark, sf_dir):
    rows = ft.kinematics(samples(spark, sf_dir).select(*SERIES, "event_id", "t", "x", "y"), SERIES, ["t", "event_id"]).withColumn("s", F.col("speed") * 3600000)
    found = rows.groupBy(*SERIES).agg(
        F.round(F.avg("s"), 4).alias("mean"), F.round(F.percentile("s", F.lit(0.95)), 4).alias("p95"), F.round(F.max("s"), 4).alias("top"), F.round(F.avg(F.when(F.col("speed").isNotNull(), F.abs("heading"))), 5).alias("turn")
    )
    return found.where("top is not null")


@query(S + """, m as (select *, case when event_type = 'error' then 'erase' else 'draw' end as mode from s), n as (select *, lead(mode) over (partition by dyad, trial order by t, event_id) as nx from m)
select dyad, trial, count(*) filter (mode = 'draw') as draws, count(*) filter (mode = 'erase') as erases, round(count(*) filter (mode = 'erase') * 1.0 / count(*), 6) as erase_ratio, count(*) filter (mode = 'erase' and nx = 'draw') as redraws from n group by dyad, trial""")
def geo_behaviour(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("mode", F.when(F.col("event_type") == "error", "erase").otherwise("draw"))
    rows = rows.withColumn("nx", F.lead("mode").over(Window.partitionBy(*TRIAL).orderBy("t", "event_id")))
    n = lambda c: F.count(F.when(c, 1))
    erase = F.col("mode") == "erase"
    return rows.groupBy(*TRIAL).agg(n(~erase).alias("draws"), n(erase).alias("erases"), F.round(n(erase) / F.count(F.lit(1)), 6).alias("erase_ratio"), n(erase & (F.col("nx") == "draw")).alias("redraws"))


@query(S + """, f as (select dyad, trial, role, t // 21600000 as idx, max(t) - min(t) as d from s group by all)
select dyad, trial, role, count(*) as n, round(avg(d), 5) as mean, round(coalesce(stddev_samp(d), 0), 4) as sd, round(count(*) filter (d < 3600000) * 1.0 / nullif(count(*) filter (d > 7200000), 0), 6) as ambient_focal from f group by dyad, trial, role""")
def geo_fixations(spark, sf_dir):
    rows = samples(spark, sf_dir).groupBy(*SERIES, F.expr("t div 21600000").alias("idx")).agg((F.max("t") - F.min("t")).alias("d"))
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 5).alias("mean"), F.round(F.coalesce(F.stddev_samp("d"), F.lit(0.0)), 4).alias("sd"), F.round(F.try_divide(n(F.col("d") < 3600000), n(F.col("d") > 7200000)), 6).alias("ambient_focal")
    )


@query(S + f""", {STEP_SQL} select dyad, trial, role, count(*) as n, round(avg(case when abs(degrees(atan2(dy, dx))) > 90 then 1.0 else 0.0 end), 6) as regressive,
  round(case when var_pop(sqrt(dx * dx + dy * dy)) > 1e-12 then covar_pop(abs(dx), sqrt(dx * dx + dy * dy)) / var_pop(sqrt(dx * dx + dy * dy)) end, 5) as main_slope from d where dx is not null group by dyad, trial, role""")
def geo_saccades(spark, sf_dir):
    way = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    back = F.abs(sc.heading(F.col("dx"), F.col("dy"))) > 90
    rows = steps(spark, sf_dir).where("dx is not null").withColumn("way", way).withColumn("ax", F.abs("dx"))
    return rows.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(back, 1.0).otherwise(0.0)), 6).alias("regressive"), F.round(sc.slope(F.col("ax"), F.col("way")), 5).alias("main_slope"))


@query(S + """, p as (select *, case when x > 0 and y > 0 then (x + y) / 2 when x > 0 then x when y > 0 then y end as p, x - lag(x) over w as dx, t - lag(t) over w as dt from s window w as (partition by dyad, trial, role order by t, event_id))
select dyad, trial, role, round(avg(p), 7) as mean, round(max(p) - min(p), 7) as span, round(avg(p) - arg_min(p, (t, event_id)), 7) + 0.0 as change, round(avg(dx / (case when dt <= 0 then 0.000001 else dt / 1000.0 end)), 6) + 0.0 as rate, round(avg(x - y), 7) + 0.0 as asymmetry from p group by dyad, trial, role""")
def geo_pupil(spark, sf_dir):
    w = Window.partitionBy(*SERIES).orderBy("t", "event_id")
    rows = samples(spark, sf_dir).withColumn("p", sc.mean_pupil(F.col("x"), F.col("y"))).withColumn("dx", F.col("x") - F.lag("x").over(w)).withColumn("dt", F.col("t") - F.lag("t").over(w))
    rate = F.col("dx") / F.when(F.col("dt") <= 0, 1e-6).otherwise(F.col("dt") / 1000.0)
    return rows.groupBy(*SERIES).agg(
        F.round(F.avg("p"), 7).alias("mean"), F.round(F.max("p") - F.min("p"), 7).alias("span"), (F.round(F.avg("p") - F.min_by("p", F.struct("t", "event_id")), 7) + 0.0).alias("change"),
        (F.round(F.avg(rate), 6) + 0.0).alias("rate"), (F.round(F.avg(F.col("x") - F.col("y")), 7) + 0.0).alias("asymmetry"),
    )


@query(S + f"select dyad, trial, role, round(avg(case when event_type = 'error' then 1.0 else 0.0 end), 6) as loss, round(avg(case when y > 0 then 1.0 else 0.0 end), 6) as valid, round(stddev_pop(y), 5) as head_sd, count(distinct {AREA_SQL}) as areas from s group by dyad, trial, role")
def geo_quality(spark, sf_dir):
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    rows = samples(spark, sf_dir).withColumn("aoi", sc.area_of(F.col("x"), F.col("y"), F.col("role"), SAMPLE_AREAS))
    return rows.groupBy(*SERIES).agg(share(F.col("event_type") == "error").alias("loss"), share(F.col("y") > 0).alias("valid"), F.round(F.stddev_pop("y"), 5).alias("head_sd"), F.countDistinct("aoi").alias("areas"))


@query(SCORE_SQL + ", g as (select source, lang, avg(score) as v from o group by all) select source, lang, round(v / sum(v) over (partition by source), 6) as share from g")
def st_row_shares(spark, sf_dir):
    """Grouped means as shares of their row, before a pivot."""
    rows = scored(spark, sf_dir).groupBy("source", "lang").agg(F.avg("score").alias("v"))
    return rows.select("source", "lang", F.round(F.col("v") / F.sum("v").over(Window.partitionBy("source")), 6).alias("share"))


@query(S + """, c as (select role, event_type, avg(x) - 60 as v, count(*) as n from s group by all), k as (select role, event_type, sign(v) * -log10(1.0 / n + 1e-10) as m from c)
select event_type, round(coalesce(max(m) filter (role = 'director'), 0), 5) as director, round(coalesce(max(m) filter (role = 'matcher'), 0), 5) as matcher from k group by event_type""")
def st_event_matrix(spark, sf_dir):
    """Signed -log10 p per event and role, missing cells 0 (p = 1 / n here)."""
    rows = samples(spark, sf_dir).groupBy("role", "event_type").agg((F.avg("x") - 60).alias("v"), F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("m", F.signum("v") * -F.log10(1.0 / F.col("n") + 1e-10))
    wide = rows.groupBy("event_type").pivot("role", ["director", "matcher"]).agg(F.first("m"))
    return wide.select("event_type", *(F.round(F.coalesce(c, F.lit(0.0)), 5).alias(c) for c in ("director", "matcher")))


@query(S + "select dyad % 4 as cluster, t // 21600000 as tick, round(avg(bpm), 6) as mean, round(coalesce(stddev_samp(bpm), 0), 5) as sd, count(*) as n from s group by all")
def st_mean_trace(spark, sf_dir):
    rows = samples(spark, sf_dir).groupBy((F.col("dyad") % 4).alias("cluster"), F.expr("t div 21600000").alias("tick"))
    return rows.agg(F.round(F.avg("bpm"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("bpm"), F.lit(0.0)), 5).alias("sd"), F.count(F.lit(1)).alias("n"))


MAP_SQL = "m as (select *, dyad % 12 as map from (select dyad, trial, avg(x) as score, min(y) as low, count(*) as n from s group by dyad, trial))"


@query(S + f", {MAP_SQL}, e as (select *, row_number() over (partition by map order by round(score, 6) desc, dyad, trial) as k from m where (dyad, trial) in (select (dyad, trial) from s where event_type = 'purchase')) select map, dyad, trial from e where k = 1")
def st_exemplar(spark, sf_dir):
    """The extreme trial of each group that has what is to be shown."""
    there = samples(spark, sf_dir).where("event_type = 'purchase'").select(*TRIAL).distinct()
    rows = trials(spark, sf_dir).join(there, TRIAL, "left_semi")
    nth = F.row_number().over(Window.partitionBy("map").orderBy(F.desc(F.round("score", 6)), *TRIAL))
    return rows.withColumn("k", nth).where("k = 1").select("map", *TRIAL)


@query(S + f""", {MAP_SQL}, l as (select dyad, trial, 'score' as f, score as v, 1 as g from m union all select dyad, trial, 'low', low, -1 from m), z as (select dyad, trial, g, case when coalesce(stddev_samp(v) over w, 0) > 0 then (v - avg(v) over w) / stddev_samp(v) over w else 0 end as z from l window w as (partition by dyad, f))
select dyad, trial, round(avg(z * g), 6) as workload from z group by dyad, trial""")
def st_workload(spark, sf_dir):
    rows = trials(spark, sf_dir)
    long = rows.select(*TRIAL, F.explode(F.array(F.struct(F.lit("score").alias("feature"), F.col("score").alias("value")), F.struct(F.lit("low").alias("feature"), F.col("low").alias("value")))).alias("_f")).select(*TRIAL, "_f.*")
    signs = spark.createDataFrame([("score", 1), ("low", -1)], "feature string, sign int")
    return ft.workload(long, signs, TRIAL, "dyad")


@query()
def ml_two_stage(spark, sf_dir):
    """Out-of-fold probabilities per block of features into a second model."""
    base, out = feature_table(spark, sf_dir), None
    folds = learn.fold_table(spark, base, "dyad", 5, [0])
    for name, at in (("a", 1), ("b", 33)):
        part = base.withColumn("features", F.slice("features", at, 32))
        found = learn.cross_validate(part, folds, "dyad", "vec_id", "features", "label", "logistic").select("vec_id", F.col("p").alias(name))
        out = found if out is None else out.join(found, "vec_id")
    table = base.drop("features").join(out, "vec_id").withColumn("features", F.array("a", "b"))
    return st.roc_auc(learn.cross_validate(table, folds, "dyad", "vec_id", "features", "label", "logistic"), "p", "label")
