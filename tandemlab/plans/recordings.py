"""Alignment of gaze with speech and drawing, episodes by index, load, and all
families of a recording at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemlab.functions import scalars as sc
from tandemlab.operators import alignment as al
from tandemlab.operators import joins
from tandemlab.operators import series as ts
from tandemlab.plans import families  # noqa: F401  (registers what the facades put together)
from tandemlab.plans.advanced import USER_SQL, line_sql
from tandemlab.plans.basics import AREA_SQL, SERIES, TRIAL, S
from tandemlab.plans.registry import ORACLES, QUERIES, query
from tandemlab.sources.adapters import SAMPLE_AREAS, read, samples

HOUR = 3_600_000


def gaze(spark, sf_dir, role: str) -> DataFrame:
    rows = samples(spark, sf_dir).where(F.col("role") == role)
    return rows.select(*TRIAL, F.col("event_id").alias("ident"), "t", "x", "y", sc.area_of(F.col("x"), F.col("y"), F.col("role"), SAMPLE_AREAS).alias("aoi"))


GAZE_SQL = f"g as (select *, {AREA_SQL} as aoi, count(*) over (partition by dyad, trial, role) as k from s)"


@query(S + f""", {GAZE_SQL},
w as (select dyad, trial, t as start, t + {HOUR} as "end", lead(t) over o as nx, row_number() over o as n from s where event_type = 'click' window o as (partition by dyad, trial order by t)),
p as (select dyad, trial, n, true as speech, start, "end" from w union all select dyad, trial, n, false, "end", nx from w where nx - "end" > {2 * HOUR}),
j as (select p.dyad, p.trial, p.n, speech, aoi, sqrt(pow(x - lag(x) over v, 2) + pow(y - lag(y) over v, 2)) as step from p join g on g.dyad = p.dyad and g.trial = p.trial and g.role = 'director' and g.k >= 10 and g.t between start and "end"
  window v as (partition by p.dyad, p.trial, p.n, speech order by g.t, g.event_id)),
f as (select dyad, trial, avg(step) filter (speech) as speech, avg(step) filter (not speech) as pause, avg(case when aoi = 'map' then 1.0 else 0.0 end) filter (speech) as on_map from j group by dyad, trial)
select dyad, trial, round(speech, 5) as speech, round(pause, 5) as pause, round(case when speech is not null and pause is not null then case when pause > 0 then speech / pause else 0 end end, 5) as ratio, round(coalesce(on_map, 0), 6) as on_map
from (select distinct dyad, trial from g where role = 'director' and k >= 10) join (select distinct dyad, trial from w) using (dyad, trial) left join f using (dyad, trial)""")
def geo_gaze_speech(spark, sf_dir):
    """Clicks of a trial stand for words of an hour each, pauses are longer than two."""
    words = samples(spark, sf_dir).where("event_type = 'click'").select(*TRIAL, F.col("t").alias("start"), (F.col("t") + HOUR).alias("end"))
    found = al.gaze_speech(gaze(spark, sf_dir, "director"), words, TRIAL, 2 * HOUR, 2 * HOUR)
    return found.select(*TRIAL, *(F.round(c, 5).alias(c) for c in ("speech", "pause", "ratio")), F.round("on_map", 6).alias("on_map"))


@query(S + f""", {GAZE_SQL},
m as (select * from g where role = 'matcher' and k >= 10),
q as (select dyad, trial, t // 86400000 as stroke, event_id, t, (x - 100) * 651 / 200.0 as u, (y - 100) * 900 / 600.0 as v, row_number() over (partition by dyad, trial, t // 86400000 order by t, event_id) = 1 as first,
  max(t) over (partition by dyad, trial, t // 86400000) as ended, x, y from s where role = 'director'),
h as (select dyad, trial, t, arg_min(x, event_id) as gx, arg_min(y, event_id) as gy from m group by all),
n as (select q.event_id, any_value(q.dyad) as dyad, any_value(q.trial) as trial, any_value(first) as first, arg_min(sqrt(pow(gx - x, 2) + pow(gy - y, 2)), abs(q.t - h.t) * 2 + (case when h.t > q.t then 1 else 0 end)) as d from q join h on q.dyad = h.dyad and q.trial = h.trial and abs(q.t - h.t) < {4 * HOUR} group by q.event_id),
c as (select dyad, trial, avg(d) as cursor_mean, median(d) as cursor_median, stddev_pop(d) as cursor_sd, avg(d) filter (first) as onset_mean, avg(case when d < 50 then 1.0 else 0.0 end) filter (first) as onset_near from n group by dyad, trial),
o as (select dyad, trial, min(ended) as begun from q group by dyad, trial),
e as (select m.dyad, m.trial, case when exists (select 1 from q where q.dyad = m.dyad and q.trial = m.trial and q.ended < m.t and pow((m.x - 100) * 651 / 200.0 - q.u, 2) + pow((m.y - 100) * 900 / 600.0 - q.v, 2) < 900.0) then 1.0 else 0.0 end as near
  from m join o on o.dyad = m.dyad and o.trial = m.trial where m.aoi = 'map' and m.t > o.begun),
r as (select dyad, trial, avg(near) as on_drawing from e group by dyad, trial)
select dyad, trial, round(cursor_mean, 5) as cursor_mean, round(cursor_median, 5) as cursor_median, round(cursor_sd, 5) as cursor_sd, round(onset_mean, 5) as onset_mean, round(onset_near, 6) as onset_near, round(on_drawing, 6) as on_drawing
from (select distinct dyad, trial from m) join (select distinct dyad, trial from q) using (dyad, trial) left join c using (dyad, trial) left join r using (dyad, trial)""")
def geo_gaze_drawing(spark, sf_dir):
    """The director's samples of a day stand for a stroke on the map."""
    u, v = sc.to_map(F.col("x"), F.col("y"))
    points = samples(spark, sf_dir).where("role = 'director'").select(*TRIAL, F.expr("t div 86400000").alias("stroke"), F.col("event_id").alias("ident"), "t", u.alias("x"), v.alias("y"))
    found = al.gaze_drawing(gaze(spark, sf_dir, "matcher"), points, TRIAL, 4 * HOUR)
    return found.select(*TRIAL, *(F.round(c, 5).alias(c) for c in ("cursor_mean", "cursor_median", "cursor_sd", "onset_mean")), *(F.round(c, 6).alias(c) for c in ("onset_near", "on_drawing")))


BLINK_SQL = """f as (select *, event_type = 'error' as flag, lead(t) over w as next_t, max(t) over (partition by dyad, trial, role) as end_t, row_number() over w - row_number() over (partition by dyad, trial, role, event_type = 'error' order by t, event_id) as island from s window w as (partition by dyad, trial, role order by t, event_id)),
e as (select dyad, trial, role, coalesce(arg_max(next_t, (t, event_id)), max(end_t)) - min(t) as d from f where flag group by dyad, trial, role, island),
b as (select dyad, trial, role, count(*) as n, avg(d) as mean, stddev_pop(d) as sd, max(d) as longest from e group by all),
z as (select dyad, trial, role, case when count(*) > 1 then (max(t) - min(t)) / 1000.0 else 1.0 end as seconds from s group by all),
blink as (select dyad, trial, role, coalesce(n, 0) as n, case when seconds > 0 then coalesce(n, 0) / (seconds / 60) else 0 end as per_minute, mean, sd, longest from z left join b using (dyad, trial, role))"""


def blinks(spark, sf_dir) -> DataFrame:
    """(SERIES, n, per_minute, mean, sd, longest): episodes of error events."""
    span = samples(spark, sf_dir).groupBy(*SERIES).agg(F.when(F.count(F.lit(1)) > 1, (F.max("t") - F.min("t")) / 1000.0).otherwise(1.0).alias("seconds"))
    found = QUERIES["isl_blinks"](spark, sf_dir).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("mean"), F.stddev_pop("duration").alias("sd"), F.max("duration").alias("longest"))
    n = F.coalesce("n", F.lit(0))
    rate = F.when(F.col("seconds") > 0, n / (F.col("seconds") / 60)).otherwise(0.0)
    return span.join(found, SERIES, "left").select(*SERIES, n.alias("n"), rate.alias("per_minute"), "mean", "sd", "longest")


@query(S + f", {BLINK_SQL} select dyad, trial, role, n, round(per_minute, 8) as per_minute, round(mean, 4) as mean, round(sd, 4) as sd, longest from blink")
def isl_blink_rate(spark, sf_dir):
    return blinks(spark, sf_dir).select(*SERIES, "n", F.round("per_minute", 8).alias("per_minute"), F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "longest")


TRACK_SQL = """k as (select s.*, cast(json_extract(props, '$.k') as bigint) as k from s join events e using (event_id)),
q as (select *, case when k % 7 = 0 then '' when k < 10 then '0' else cast(t // 43200000 as varchar) end as fixation_idx, case when k % 7 = 0 then cast(t // 86400000 as varchar) when k % 7 = 1 then '0' end as saccade_idx,
  case when k % 5 = 0 then 0.0 when k % 5 = 1 then x + 1 end as fixation_x, cast(null as double) as fixation_y, case when k % 3 = 0 then k * 10.0 end as fixation_duration from k)"""


def tracked(spark, sf_dir) -> DataFrame:
    """Samples with the columns that a tracker gives, some of them empty."""
    k = sc.safe_long(F.get_json_object("props", "$.k"))
    rows = samples(spark, sf_dir).join(read(spark, sf_dir, "events").select("event_id", k.alias("k")), "event_id")
    place = F.when(F.col("k") % 5 == 0, 0.0).when(F.col("k") % 5 == 1, F.col("x") + 1)
    return rows.select(
        "*", F.when(F.col("k") % 7 == 0, "").when(F.col("k") < 10, "0").otherwise(F.expr("t div 43200000").cast("string")).alias("fixation_idx"),
        F.when(F.col("k") % 7 == 0, F.expr("t div 86400000").cast("string")).when(F.col("k") % 7 == 1, "0").alias("saccade_idx"),
        place.alias("fixation_x"), F.lit(None).cast("double").alias("fixation_y"), F.when(F.col("k") % 3 == 0, F.col("k") * 10.0).alias("fixation_duration"),
    )


@query(S + f""", {TRACK_SQL} select dyad, trial, role, fixation_idx, round(avg(coalesce(nullif(fixation_x, 0), x)), 6) as x, round(avg(coalesce(nullif(fixation_y, 0), y)), 6) as y, min(t) as start, max(t) as "end",
  coalesce(arg_min(fixation_duration, (t, event_id)) filter (fixation_duration is not null), cast(max(t) - min(t) as double)) as duration from q where fixation_idx not in ('', '0') group by dyad, trial, role, fixation_idx""")
def isl_fixation_index(spark, sf_dir):
    found = al.fixation_list(tracked(spark, sf_dir), SERIES, ["t", "event_id"])
    return found.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


FILLED_SQL = TRACK_SQL + """, v as (select *, case when t - lag(t) over w > 0 then sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) / ((t - lag(t) over w) / 1000.0) end as velocity from q window w as (partition by dyad, trial, role order by t, event_id)),
a as (select dyad, trial, role, fixation_idx, avg(x) as fx, avg(y) as fy, cast(max(t) - min(t) as double) as fd from v where fixation_idx not in ('', '0') group by all),
b as (select dyad, trial, role, saccade_idx, count(*) as n, arg_max(x, (t, event_id)) - arg_min(x, (t, event_id)) as dx, arg_max(y, (t, event_id)) - arg_min(y, (t, event_id)) as dy, max(velocity) as peak from v where saccade_idx not in ('', '0') group by all),
filled as (select v.dyad, v.trial, v.role, v.t, event_id, v.saccade_idx, velocity, fx, fy, fd, case when n is not null then case when n >= 2 then sqrt(dx * dx + dy * dy) else 0 end end as amplitude, case when n is not null then case when n >= 2 then degrees(atan2(dy, dx)) else 0 end end as direction,
  case when n is not null then coalesce(peak, 0) end as peak from v left join a using (dyad, trial, role, fixation_idx) left join b using (dyad, trial, role, saccade_idx))"""


@query(S + f", {FILLED_SQL} select event_id, round(velocity, 8) as velocity, round(fx, 6) as fx, round(fy, 6) as fy, fd, round(amplitude, 5) as amplitude, round(direction, 5) + 0.0 as direction, round(peak, 8) as peak from filled")
def isl_gap_filling(spark, sf_dir):
    found = al.gaps_filled(tracked(spark, sf_dir), SERIES, ["t", "event_id"])
    return found.select(
        "event_id", F.round("gaze_velocity", 8).alias("velocity"), F.round("fixation_x", 6).alias("fx"), F.round("fixation_y", 6).alias("fy"), F.col("fixation_duration").alias("fd"),
        F.round("saccade_amplitude", 5).alias("amplitude"), (F.round("saccade_direction", 5) + 0.0).alias("direction"), F.round("saccade_peak_velocity", 8).alias("peak"),
    )


@query(S + f""", {FILLED_SQL} select dyad, trial, role, saccade_idx, round(arg_min(amplitude, (t, event_id)), 5) as amplitude, round(max(peak), 8) as peak, round(arg_min(direction, (t, event_id)), 5) + 0.0 as direction, min(t) as start
from filled where saccade_idx not in ('', '0') group by dyad, trial, role, saccade_idx""")
def isl_saccade_index(spark, sf_dir):
    found = al.saccade_list(al.gaps_filled(tracked(spark, sf_dir), SERIES, ["t", "event_id"]), SERIES, ["t", "event_id"])
    return found.select(*SERIES, "saccade_idx", F.round("amplitude", 5).alias("amplitude"), F.round("peak_velocity", 8).alias("peak"), (F.round("direction", 5) + 0.0).alias("direction"), "start")


@query(S + f""", {BLINK_SQL},
x as (select dyad, trial, role, t // 21600000 as idx, max(t) - min(t) as d from s group by all), fix as (select dyad, trial, role, avg(d) as fix_dur from x group by all),
p as (select dyad, trial, role, avg(case when x > 0 and y > 0 then (x + y) / 2 when x > 0 then x when y > 0 then y end) as pupil, avg(bpm) as hr from s group by all),
base as (select dyad, role, pupil as base_pupil, hr as base_hr from p where trial = 3),
l as (select p.dyad, p.trial, p.role, case when base_pupil > 0 then (pupil - base_pupil) / base_pupil end as pupil, case when base_pupil > 0 then null else p.pupil end as pupil_raw, fix_dur, -per_minute as inv_blink_rate, case when base_hr <> 0 then hr - base_hr end as hr_change
  from p join fix using (dyad, trial, role) join blink using (dyad, trial, role) left join base b on b.dyad = p.dyad and b.role = p.role)
select dyad, trial, role, round(pupil, 6) + 0.0 as pupil, round(pupil_raw, 6) as pupil_raw, round(fix_dur, 4) as fix_dur, round(inv_blink_rate, 8) + 0.0 as inv_blink_rate, round(hr_change, 6) + 0.0 as hr_change,
  (pupil is not null)::int + (pupil_raw is not null)::int + (fix_dur is not null)::int + (inv_blink_rate is not null)::int + (hr_change is not null)::int as n_components from l""")
def geo_load(spark, sf_dir):
    """The first trial (3) is the baseline of its person."""
    rows = samples(spark, sf_dir)
    means = rows.groupBy(*SERIES).agg(F.avg(sc.mean_pupil(F.col("x"), F.col("y"))).alias("pupil"), F.avg("bpm").alias("hr"))
    fix = rows.groupBy(*SERIES, F.expr("t div 21600000").alias("idx")).agg((F.max("t") - F.min("t")).alias("d")).groupBy(*SERIES).agg(F.avg("d").alias("fix"))
    base = means.where("trial = 3").select("dyad", "role", F.col("pupil").alias("base_pupil"), F.col("hr").alias("base_hr"))
    table = means.join(fix, SERIES).join(blinks(spark, sf_dir).select(*SERIES, "per_minute"), SERIES).join(base, ["dyad", "role"], "left")
    parts = al.load_components(F.col("pupil"), F.col("base_pupil"), F.col("fix"), F.col("per_minute"), F.col("hr"), F.col("base_hr"))
    found = table.select(*SERIES, *parts)
    digits = {"pupil": 6, "pupil_raw": 6, "fix_dur": 4, "inv_blink_rate": 8, "hr_change": 6}
    return found.select(*SERIES, *((F.round(c, d) + 0.0).alias(c) for c, d in digits.items()), "n_components")


@query("""with f as (select event_id, 'T' || lpad(cast(k as varchar), 2, '0') as trial, k from (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events)),
m as (select cast(n as varchar) as trial, n * 100 + 7 as ms, n as pos from range(0, 40) r(n) union all select 'T' || cast(n as varchar), n * 100 + 9, 100 + n from range(30, 60) r(n) union all select '', 5, 500 union all select '3', 0, 600)
select f.event_id, f.trial, coalesce((select arg_max(ms, pos) from m where m.trial = f.trial having arg_max(ms, pos) <> 0), (select arg_max(ms, pos) from m where m.trial = case when ltrim(ltrim(f.trial, 'T'), '0') = '' then '0' else ltrim(ltrim(f.trial, 'T'), '0') end having arg_max(ms, pos) <> 0)) as marker_ms from f""")
def join_markers(spark, sf_dir):
    """Flashes labelled T07 against markers labelled 7, T37 or nothing."""
    k = sc.safe_long(F.get_json_object("props", "$.k"))
    flashes = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("T"), F.lpad(k.cast("string"), 2, "0")).alias("trial"))
    n = F.col("id")
    bare = spark.range(40).select(n.cast("string").alias("trial"), (n * 100 + 7).alias("marker_ms"), n.alias("pos"))
    named = spark.range(30, 60).select(F.concat(F.lit("T"), n).alias("trial"), (n * 100 + 9).alias("marker_ms"), (n + 100).alias("pos"))
    odd = spark.createDataFrame([("", 5, 500), ("3", 0, 600)], "trial string, marker_ms long, pos long")
    return joins.marker_match(flashes, bare.unionAll(named).unionAll(odd))


GAZE_RQA_SQL = f"""{USER_SQL.replace("round(bpm, 6) as v", "x as v")}, d as (select user_id, v, i, greatest(n // 200, 1) as step from v where n >= 20), y as (select user_id, cast(i // step as int) as i, v from d where i % step = 0),
h as (select user_id, i, v, lead(v) over (partition by user_id order by i) as w, greatest(0.1 * stddev_samp(v) over (partition by user_id), 1.0) as r from y), c as (select * from h where w is not null),
z as (select user_id, count(*) * (count(*) - 1) as cells from c group by user_id), e as (select a.user_id, a.i, b.i as j from c a join c b on a.user_id = b.user_id and a.i <> b.i and sqrt(pow(a.v - b.v, 2) + pow(a.w - b.w, 2)) <= a.r)"""


@query(f"select user_id, rr, det, mean_diag, max_diag, entropy, lam, trapping_time from ({S}, {GAZE_RQA_SQL}, {line_sql('user_id')})")
def ts_gaze_rqa(spark, sf_dir):
    """Auto-recurrence of the strided x of gaze, embedded in two dimensions."""
    rows = ts.strided(ts.indexed(samples(spark, sf_dir), ["user_id"], ["trial", "t", "event_id"], F.col("x")).where("n >= 20"), ["user_id"], 200)
    rows = ts.embedded(rows, ["user_id"])
    sizes = rows.groupBy("user_id").agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)).alias("cells"))
    edges = ts.recurrences(rows, rows, ["user_id"], ["v", "w"], F.greatest(F.col("a.sd") * 0.1, F.lit(1.0)), 1)
    return ts.line_metrics(edges, sizes, ["user_id"]).drop("max_vert", "div", "entropy_vert")


def prefixed(parts: dict[str, str], keys: str, columns: dict[str, tuple[str, ...]]) -> str:
    """SQL of registered queries side by side, as joins.beside does."""
    froms = " full join ".join(f"(select {keys}, {', '.join(f'{c} as {p}_{c}' for c in columns[p])} from ({ORACLES[q]})) {p}" + ("" if k == 0 else f" using ({keys})") for k, (p, q) in enumerate(parts.items()))
    return f"select * from {froms}"


#: Families of one person's recording and of a pair's, by prefix.
PERSON = {"fix": "geo_fixations", "sacc": "geo_saccades", "pupil": "geo_pupil", "blink": "isl_blink_rate", "aoi": "agg_transition_entropy", "quality": "geo_quality", "speed": "geo_speed", "load": "geo_load"}
PAIR = {"speech": "geo_gaze_speech", "drawing": "geo_gaze_drawing", "pixels": "geo_pixel_metrics", "boundary": "geo_boundary_f", "chamfer": "geo_chamfer_hausdorff", "behaviour": "geo_behaviour", "hr": "ts_crossmodal_corr"}
PERSON_COLUMNS = {
    "fix": ("n", "mean", "sd", "ambient_focal"), "sacc": ("n", "regressive", "main_slope"), "pupil": ("mean", "span", "change", "rate", "asymmetry"), "blink": ("n", "per_minute", "mean", "sd", "longest"),
    "aoi": ("transitions", "entropy"), "quality": ("loss", "valid", "head_sd", "areas"), "speed": ("mean", "p95", "top", "turn"), "load": ("pupil", "pupil_raw", "fix_dur", "inv_blink_rate", "hr_change", "n_components"),
}
PAIR_COLUMNS = {
    "speech": ("speech", "pause", "ratio", "on_map"), "drawing": ("cursor_mean", "cursor_median", "cursor_sd", "onset_mean", "onset_near", "on_drawing"), "pixels": ("iou", "precision", "recall", "f1"), "boundary": ("boundary_f",),
    "chamfer": ("chamfer", "hausdorff"), "behaviour": ("draws", "erases", "erase_ratio", "redraws"), "hr": ("n", "r"),
}


@query(prefixed(PERSON, "dyad, trial, role", PERSON_COLUMNS))
def geo_person(spark, sf_dir):
    """All families of one person's recording: a row per dyad, trial and role."""
    return joins.beside({p: QUERIES[q](spark, sf_dir) for p, q in PERSON.items()}, SERIES)


@query(prefixed(PAIR, "dyad, trial", PAIR_COLUMNS))
def geo_pair(spark, sf_dir):
    """All families of a pair's recording: a row per dyad and trial."""
    return joins.beside({p: QUERIES[q](spark, sf_dir) for p, q in PAIR.items()}, TRIAL)
