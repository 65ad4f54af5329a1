"""Feature families of a recording and the catalogue of feature names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemlab.functions.scalars import heading


def rescaled(strokes: DataFrame, keys: list[str], width: int, height: int, source: int = 1024) -> DataFrame:
    """strokes (keys, mode, width, points array<struct<x,y,t>>) in a width by
    height frame: an axis whose largest coordinate passes the frame is taken to
    be `source` long. Strokes need two valid points and a known mode."""
    valid = F.filter("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    rows = strokes.withColumn("points", valid).where((F.size("points") >= 2) & F.col("mode").isin("draw", "erase"))
    w = Window.partitionBy(*keys)
    far = lambda c: F.max(F.array_max(F.transform("points", lambda p: p[c]))).over(w)
    sx, sy = F.when(far("x") > width, width / source).otherwise(1.0), F.when(far("y") > height, height / source).otherwise(1.0)
    rows = rows.withColumn("_sx", sx).withColumn("_sy", sy)
    scaled = F.transform("points", lambda p: F.struct((p["x"] * F.col("_sx")).alias("x"), (p["y"] * F.col("_sy")).alias("y"), p["t"].alias("t")))
    return rows.withColumn("points", scaled).withColumn("width", F.col("width") * F.least("_sx", "_sy")).drop("_sx", "_sy")


def session_window(events: DataFrame, anchor: Column, keys: list[str], before: int, after: int, t: str = "t") -> DataFrame:
    """Events within [first anchored time - before, last + after] of a session."""
    bounds = events.groupBy(*keys).agg(F.min(F.when(anchor, F.col(t))).alias("_a"), F.max(F.when(anchor, F.col(t))).alias("_b"))
    return events.join(bounds, keys).where(F.col(t).between(F.col("_a") - before, F.col("_b") + after)).drop("_a", "_b")


def session_bounds(events: DataFrame, keys: list[str], first_hr: Column, authoritative: Column, t: str = "t") -> DataFrame:
    """(keys, start, end): an hour before to three after the first heart-rate time;
    without one (or 0), four hours before to one after the last authoritative
    event; null without either."""
    hour = 3600000
    found = events.groupBy(*keys).agg(F.min(F.when(first_hr > 0, first_hr)).alias("_hr"), F.max(F.when(authoritative, F.col(t))).alias("_last"))
    return found.select(*keys, F.coalesce(F.col("_hr") - hour, F.col("_last") - 4 * hour).alias("start"), F.coalesce(F.col("_hr") + 3 * hour, F.col("_last") + hour).alias("end"))


def clock_offset(measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, offset): the upper median of the director's clock less the matcher's.
    measured: (keys, scope, role, peer, samples, offset) within the session.
    Measurements without samples don't count; those of the session's own file
    (scope 0) go before those of its trials (1); 0 without any."""
    signed = F.when((F.col("role") == "matcher") & (F.col("peer") == "director"), F.col("offset")).when((F.col("role") == "director") & (F.col("peer") == "matcher"), -F.col("offset"))
    rows = measured.where("samples > 0 and offset is not null").withColumn("_o", signed).where("_o is not null")
    scope = Window.partitionBy(*keys)
    rows = rows.withColumn("_scope", F.min("scope").over(scope)).where("scope = _scope")
    rows = rows.withColumn("_k", F.row_number().over(scope.orderBy("_o"))).withColumn("_n", F.count(F.lit(1)).over(scope))
    middle = rows.where("_k = _n div 2 + 1").select(*keys, F.col("_o").alias("offset"))
    return measured.select(*keys).distinct().join(middle, keys, "left").select(*keys, F.coalesce("offset", F.lit(0.0)).alias("offset"))


def last_of(value: Column | str, where: Column, pos: Column | str) -> Column:
    """The value of the last row in file order that fulfils where."""
    return F.max_by(value, F.when(where, pos))


def downsample(df: DataFrame, keys: list[str], t: str, step: int, tie: str) -> DataFrame:
    """The first row of each bucket of `step`: keep-if-far-from-the-last-kept
    needs state, buckets don't; rows kept may stand closer than step across a
    bucket's edge."""
    nth = F.row_number().over(Window.partitionBy(*keys, F.floor(F.col(t) / step)).orderBy(t, tie))
    return df.withColumn("_n", nth).where("_n = 1").drop("_n")


def is_blink(left: Column, right: Column, pupil_left: Column, pupil_right: Column, x: Column, threshold: float) -> Column:
    """Both eyelids nearly shut, or no pupil and no gaze."""
    shut = F.coalesce((left < threshold) & (right < threshold), F.lit(False))
    blind = (F.coalesce(pupil_left, F.lit(0.0)) <= 0) & (F.coalesce(pupil_right, F.lit(0.0)) <= 0) & x.isNull()
    return shut | blind


#: Fixed markers of what a feature name belongs to; the first that occurs wins.
MODALITIES = (("hr", ("hr_", "hrv_", "rmssd", "bpm")), ("speech", ("speech", "act_pct", "conv_")), ("drawing", ("stroke", "draw", "erase")), ("gaze", ("gaze", "fix", "sacc", "pupil", "blink")), ("joint", ("rqa", "dcrp", "coupling", "te_", "convergence")))
LEAKS = ("target", "success", "chamfer", "iou", "final_time")


def catalogue(names: DataFrame, name: str = "feature") -> DataFrame:
    """feature, modality, side (D, M, J), is_leak."""
    low = F.lower(name)
    any_of = lambda marks: _any([low.contains(m) for m in marks])
    modality = F.when(any_of(MODALITIES[0][1]), MODALITIES[0][0])
    for label, marks in MODALITIES[1:]:
        modality = modality.when(any_of(marks), label)
    side = F.when(low.startswith("director") | low.contains("_d_"), "D").when(low.startswith("matcher") | low.contains("_m_"), "M").otherwise("J")
    return names.select(name, modality.otherwise("other").alias("modality"), side.alias("side"), any_of(LEAKS).alias("is_leak"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def kinematics(points: DataFrame, keys: list[str], order: list[str], least_ms: int = 1) -> DataFrame:
    """Per row of (keys, t, x, y): heading and speed of the step to it (a speed,
    if the step takes longer than least_ms), the acceleration from that speed to
    the next one over the step's time, and the curvature at the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    lag = lambda c: F.lag(c).over(w)
    rows = points.withColumn("_dt", F.col("t") - lag("t")).withColumn("_dx", F.col("x") - lag("x")).withColumn("_dy", F.col("y") - lag("y"))
    timed = F.col("_dt") > least_ms
    rows = rows.withColumn("speed", F.when(timed, F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")) / F.col("_dt")))
    # the next speed there is, however many steps without one lie between
    ahead = F.first("speed", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("acceleration", F.when(timed, (ahead - F.col("speed")) / F.col("_dt")))
    dx, dy = lag("_dx"), lag("_dy")
    bend = F.abs(dx * (F.col("_dy") - dy) - dy * (F.col("_dx") - dx))
    rows = rows.withColumn("curvature", bend / F.greatest(F.pow(dx * dx + dy * dy, F.lit(1.5)), F.lit(1e-8)))
    return rows.withColumn("heading", heading(F.col("_dx"), F.col("_dy"))).drop("_dt", "_dx", "_dy")


def workload(long: DataFrame, signs: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Mean sign-aligned z within the group of long features (keys, group,
    feature, value); signs: (feature, sign), one row per feature of the study."""
    w = Window.partitionBy(group, "feature")
    sd = F.coalesce(F.stddev_samp("value").over(w), F.lit(0.0))
    z = F.when(sd > 0, (F.col("value") - F.avg("value").over(w)) / sd).otherwise(0.0)
    return long.withColumn("_z", z).join(signs, "feature").groupBy(*keys).agg(F.round(F.avg(F.col("_z") * F.col("sign")), 6).alias("workload"))
