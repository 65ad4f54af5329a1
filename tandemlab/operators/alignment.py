"""What gaze does while its owner speaks or draws, episodes by tracker index, and
the parts of a load index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemlab.functions.scalars import from_map, to_map
from tandemlab.operators import joins

#: Fewer valid gaze samples than this tell nothing.
LEAST_SAMPLES = 10


def _enough(gaze: DataFrame, keys: list[str]) -> DataFrame:
    valid = F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).over(Window.partitionBy(*keys))
    return gaze.withColumn("_valid", valid).where(F.col("_valid") >= LEAST_SAMPLES).drop("_valid")


def gaze_speech(gaze: DataFrame, words: DataFrame, keys: list[str], pause: int, width: int) -> DataFrame:
    """gaze: (keys, ident, t, x, y, aoi), words: (keys, start, end). Mean step
    of gaze within words and within pauses longer than `pause`, their ratio, and
    the share of samples in words that lie on the map. `width`: time bins of the
    join, about as long as a span. Steps never cross a span's edge."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    spans = words.select(*keys, "start", "end", F.lead("start").over(order).alias("_next"), F.row_number().over(order).alias("_n"))
    speech = spans.select(*keys, "_n", F.lit(True).alias("_speech"), "start", "end")
    silence = spans.where(F.col("_next") - F.col("end") > pause).select(*keys, "_n", F.lit(False).alias("_speech"), F.col("end").alias("start"), F.col("_next").alias("end"))
    gaze = _enough(gaze.select(*keys, "ident", "t", "x", "y", "aoi"), keys)
    inside = joins.interval_join(gaze, speech.unionAll(silence), keys, "t", "start", "end", width)
    valid = F.col("x").isNotNull() & F.col("y").isNotNull()
    run = Window.partitionBy(*keys, "_speech", "_n", valid).orderBy("t", "ident")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(run), F.lit(2)) + F.pow(F.col("y") - F.lag("y").over(run), F.lit(2)))
    rows = inside.withColumn("_step", step)
    mean = lambda spoken: F.avg(F.when(F.col("_speech") == spoken, F.col("_step")))
    found = rows.groupBy(*keys).agg(mean(True).alias("speech"), mean(False).alias("pause"), F.avg(F.when(F.col("_speech"), (F.col("aoi") == "map").cast("double"))).alias("on_map"))
    there = gaze.select(*keys).distinct().join(words.select(*keys).distinct(), keys)
    ratio = F.when(F.col("speech").isNotNull() & F.col("pause").isNotNull(), F.when(F.col("pause") > 0, F.col("speech") / F.col("pause")).otherwise(0.0))
    return there.join(found, keys, "left").select(*keys, "speech", "pause", ratio.alias("ratio"), F.coalesce("on_map", F.lit(0.0)).alias("on_map"))


def gaze_drawing(gaze: DataFrame, points: DataFrame, keys: list[str], tolerance: int, area=(100, 100, 300, 700), near: float = 50.0, radius: float = 30.0) -> DataFrame:
    """gaze: (keys, ident, t, x, y, aoi) on the screen, points: (keys, stroke,
    ident, t, x, y) on the map. Distance of the drawn point on the screen to the
    gaze sample nearest in time (closer than `tolerance`): mean, median and SD
    over all points, mean and share under `near` over the first of each stroke.
    on_drawing: of the samples on the map after the first stroke ended, the
    share within `radius` of a point of a stroke that had ended by then."""
    gaze = _enough(gaze.select(*keys, "ident", "t", "x", "y", "aoi"), keys)
    whole = points.where("t is not null and x is not null and y is not null")
    seen = gaze.where("x is not null and y is not null").groupBy(*keys, "t").agg(F.min_by(F.struct("x", "y"), "ident").alias("_g")).select(*keys, "t", F.col("_g.x").alias("gx"), F.col("_g.y").alias("gy"))
    found = joins.asof_nearest(whole, seen, keys, "t", ["gx", "gy"], tolerance, "ident").where("near_t is not null").drop("t", "near_t")
    first = F.row_number().over(Window.partitionBy(*keys, "stroke").orderBy("t", "ident")) == 1
    sx, sy = from_map(F.col("x"), F.col("y"), area)
    apart = F.sqrt(F.pow(F.col("gx") - sx, F.lit(2)) + F.pow(F.col("gy") - sy, F.lit(2)))
    rows = whole.withColumn("_first", first).join(found, "ident").withColumn("_d", apart)
    onset = F.when(F.col("_first"), F.col("_d"))
    cursor = rows.groupBy(*keys).agg(
        F.avg("_d").alias("cursor_mean"), F.median("_d").alias("cursor_median"), F.stddev_pop("_d").alias("cursor_sd"), F.avg(onset).alias("onset_mean"), F.avg(F.when(onset < near, 1.0).when(onset.isNotNull(), 0.0)).alias("onset_near")
    )
    ended = points.groupBy(*keys, "stroke").agg(F.max("t").alias("ended"))
    drawn = whole.select(*keys, "stroke", "x", "y").join(ended, [*keys, "stroke"])
    started = ended.groupBy(*keys).agg(F.min("ended").alias("_from"))
    u, v = to_map(F.col("x"), F.col("y"), area)
    on_map = gaze.where("aoi = 'map' and x is not null and y is not null").join(started, keys).where(F.col("t") > F.col("_from")).select(*keys, "ident", "t", u.alias("x"), v.alias("y"))
    close = joins.within_radius(on_map, drawn, keys, radius, F.col("r.ended") < F.col("l.t"), "ident").withColumn("_near", F.lit(1.0))
    share = on_map.join(close, "ident", "left").groupBy(*keys).agg(F.avg(F.coalesce("_near", F.lit(0.0))).alias("on_drawing"))
    there = gaze.select(*keys).distinct().join(points.select(*keys).distinct(), keys)
    return there.join(cursor, keys, "left").join(share, keys, "left")


def load_components(pupil: Column, base_pupil: Column, fixation: Column, blink_rate: Column, bpm: Column, base_bpm: Column) -> list[Column]:
    """The parts of the load index that a recording gives, and their number:
    pupil against its baseline (as it is without one), mean fixation, inverted
    blink rate, heart rate above its baseline."""
    against = base_pupil.isNotNull() & (base_pupil > 0)
    parts = {
        "pupil": F.when(against, (pupil - base_pupil) / base_pupil),
        "pupil_raw": F.when(~against | base_pupil.isNull(), pupil),
        "fix_dur": fixation,
        "inv_blink_rate": -blink_rate,
        "hr_change": F.when(base_bpm != 0, bpm - base_bpm),
    }
    count = F.lit(0)
    for part in parts.values():
        count = count + part.isNotNull().cast("int")
    return [*(part.alias(name) for name, part in parts.items()), count.alias("n_components")]


def indexed(name: str) -> Column:
    """Whether a sample belongs to a numbered episode."""
    return F.col(name).isNotNull() & ~F.col(name).isin("", "0")


def fixation_list(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows: (keys, t, x, y, fixation_idx, fixation_x, fixation_y,
    fixation_duration). One row per index: centroid (of the tracker's own place
    where it has one that isn't 0), start, end, and the first duration given, else
    the time it spans. Indices '' and '0' are none."""
    at = F.struct(*order)
    place = lambda c: F.coalesce(F.nullif(F.col(f"fixation_{c}"), F.lit(0.0)), F.col(c))
    given = F.min_by("fixation_duration", F.when(F.col("fixation_duration").isNotNull(), at))
    found = rows.where(indexed("fixation_idx")).groupBy(*keys, "fixation_idx").agg(
        F.avg(place("x")).alias("x"), F.avg(place("y")).alias("y"), F.min("t").alias("start"), F.max("t").alias("end"), F.coalesce(given, (F.max("t") - F.min("t")).cast("double")).alias("duration")
    )
    return found.where("x is not null and start is not null")


def saccade_list(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per saccade index: first amplitude and direction given, greatest
    peak velocity (0 where there is none), start."""
    at = F.struct(*order)
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), at)), F.lit(0.0))
    return rows.where(indexed("saccade_idx")).groupBy(*keys, "saccade_idx").agg(
        first("saccade_amplitude").alias("amplitude"), F.coalesce(F.max("saccade_peak_velocity"), F.lit(0.0)).alias("peak_velocity"), first("saccade_direction").alias("direction"), F.coalesce(F.min("t"), F.lit(0)).alias("start")
    )


def gaps_filled(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows: (keys, t, x, y, fixation_idx, saccade_idx) of a tracker that gives
    indices alone. Adds place and duration of the fixation, gaze velocity (a
    second), and amplitude, direction and peak velocity of the saccade."""
    w = Window.partitionBy(*keys).orderBy(*order)
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    dt, step = F.col("t") - F.lag("t").over(w), F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), F.lit(2)) + F.pow(F.col("y") - F.lag("y").over(w), F.lit(2)))
    rows = rows.withColumn("gaze_velocity", F.when(dt > 0, step / (dt / 1000.0)))
    f, s = Window.partitionBy(*keys, "fixation_idx"), Window.partitionBy(*keys, "saccade_idx")
    fixed, moved = indexed("fixation_idx"), indexed("saccade_idx")
    at = F.when(both, F.struct(*order))
    ends = {c: (F.max_by(c, at).over(s) - F.min_by(c, at).over(s)) for c in ("x", "y")}
    enough = F.count(at).over(s) >= 2
    length = F.sqrt(F.pow(ends["x"], F.lit(2)) + F.pow(ends["y"], F.lit(2)))
    return (
        rows.withColumn("fixation_x", F.when(fixed, F.avg("x").over(f)))
        .withColumn("fixation_y", F.when(fixed, F.avg("y").over(f)))
        .withColumn("fixation_duration", F.when(fixed, (F.max("t").over(f) - F.min("t").over(f)).cast("double")))
        .withColumn("saccade_amplitude", F.when(moved, F.when(enough, length).otherwise(0.0)))
        .withColumn("saccade_direction", F.when(moved, F.when(enough, F.degrees(F.atan2(ends["y"], ends["x"]))).otherwise(0.0)))
        .withColumn("saccade_peak_velocity", F.when(moved, F.coalesce(F.max("gaze_velocity").over(s), F.lit(0.0))))
    )


def flash_onset(samples: DataFrame, flashes: DataFrame, keys: list[str], ident: str, tight: tuple[int, int], wide: int, few: int, least: int) -> DataFrame:
    """(ident, onset): the time of the sample before the steepest fall of x among
    the samples within `tight` after a flash, or within `wide` on both sides of
    it where those are fewer than `few`. Flashes with fewer than `least` samples,
    or without a fall, have none."""
    spans = flashes.withColumn("_start", F.col("flash") - wide).withColumn("_end", F.col("flash") + wide)
    near = joins.interval_join(samples, spans, keys, "t", "_start", "_end", 2 * wide)
    inside = F.col("t").between(F.col("flash") + tight[0], F.col("flash") + tight[1])
    whole = Window.partitionBy(ident)
    near = near.withColumn("_tight", inside).withColumn("_k", F.count(F.when(inside, 1)).over(whole)).where((F.col("_k") < few) | F.col("_tight"))
    w = whole.orderBy("t")
    rate = (F.col("x") - F.lag("x").over(w)) / F.nullif(F.col("t") - F.lag("t").over(w), F.lit(0))
    near = near.withColumn("_rate", rate).withColumn("_before", F.lag("t").over(w)).withColumn("_n", F.count(F.lit(1)).over(whole))
    return near.where((F.col("_n") >= least) & (F.col("_rate") < 0)).groupBy(ident).agg(F.min_by("_before", F.struct("_rate", "t")).alias("onset"))


#: Latency of the pupil's reflex, in ms.
LATENCY = 250


def offset_choice(single: DataFrame, flashes: DataFrame, edges: DataFrame, pupil: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, method, shift): the first clock offset that there is of: the mean
    over matched markers (lsl), the mean over rising edges paired with flashes by
    order (ttl, if there are edges for two thirds of the flashes), one given by
    hand (manual), the upper median of those found in the pupil less the reflex'
    latency, and the coarse one less the latency; 0 without any.

    single: (keys, lsl, manual, coarse); flashes: (keys, flash); edges: (keys,
    edge); pupil: (keys, offset)."""
    nth = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(c))
    size = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    counts = single.join(size(flashes, "_flashes"), keys, "left").join(size(edges, "_edges"), keys, "left")
    paired = flashes.withColumn("_k", nth("flash")).join(edges.withColumn("_k", nth("edge")), [*keys, "_k"])
    ttl = paired.groupBy(*keys).agg(F.avg(F.col("edge") - F.col("flash")).alias("_ttl"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    middle = pupil.withColumn("_k", nth("offset")).withColumn("_n", n).where("_k = _n div 2 + 1").select(*keys, (F.col("offset") - LATENCY).alias("_pupil"))
    rows = counts.join(ttl, keys, "left").join(middle, keys, "left")
    whole = lambda c: F.when(F.col(c) >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("double")
    flashed = F.coalesce(F.col("_flashes"), F.lit(0)) > 0
    ways = {
        "lsl": F.when(flashed, whole("lsl")),
        "ttl": F.when(flashed & (F.coalesce("_edges", F.lit(0)) >= F.expr("_flashes * 2 div 3")), whole("_ttl")),
        "manual": F.col("manual").cast("double"),
        "pupil": F.col("_pupil").cast("double"),
        "coarse": whole("coarse") - LATENCY,
    }
    method = F.lit(None).cast("string")
    for name, value in reversed(ways.items()):
        method = F.when(value.isNotNull(), name).otherwise(method)
    return rows.select(*keys, F.coalesce(method, F.lit("none")).alias("method"), F.coalesce(*ways.values(), F.lit(0.0)).alias("shift"))


def coarse_offset(series: DataFrame, flashes: DataFrame, keys: list[str], later: tuple[int, int], least_drop: float, tolerance: int) -> DataFrame:
    """(keys, score, coarse): the offset between two clocks by the pattern of flashes.

    series: (keys, t, p), unique times. A sample is a candidate if p falls by more
    than least_drop to its mean `later` on (two samples at least); five times as
    many as there are flashes count, those of the greatest drop. Each candidate in
    turn is taken for the first flash: for every other flash the first candidate
    within tolerance of its expected time matches. The best score wins (the
    earliest of equals), if it is 3 and two thirds of the flashes or more; the
    offset is the mean over its matches."""
    ahead = Window.partitionBy(*keys).orderBy("t").rangeBetween(*later)
    known = flashes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("flash").alias("_first")).where("_n >= 3")
    drops = series.withColumn("_drop", F.col("p") - F.avg("p").over(ahead)).withColumn("_later", F.count(F.lit(1)).over(ahead))
    drops = drops.where((F.col("_later") >= 2) & (F.col("_drop") > least_drop)).join(known, keys)
    w = Window.partitionBy(*keys)
    drops = drops.withColumn("_r", F.row_number().over(w.orderBy(F.desc("_drop"), "t"))).withColumn("_all", F.count(F.lit(1)).over(w))
    candidates = drops.where("_all >= _n and _r <= 5 * _n").select(*keys, F.col("t").alias("cand"), "_n", "_first")
    expected = candidates.join(flashes, keys).withColumn("_at", F.col("cand") + F.col("flash") - F.col("_first"))
    expected = expected.withColumn("_start", F.col("_at") - tolerance).withColumn("_end", F.col("_at") + tolerance).withColumn("_flash", F.col("flash"))
    points = candidates.select(*keys, F.col("cand").alias("t"))
    hits = joins.interval_join(points, expected.select(*keys, "cand", "_flash", "_start", "_end"), keys, "t", "_start", "_end", 2 * tolerance)
    hits = hits.groupBy(*keys, "cand", "_flash").agg(F.min("t").alias("_hit"))
    matched = expected.select(*keys, "cand", "_n", "_first", "_flash").join(hits, [*keys, "cand", "_flash"], "left")
    matched = matched.withColumn("_hit", F.when(F.col("_flash") == F.col("_first"), F.col("cand")).otherwise(F.col("_hit")))
    scored = matched.groupBy(*keys, "cand").agg(F.max("_n").alias("_n"), F.count("_hit").alias("score"), F.avg(F.col("_hit") - F.col("_flash")).alias("_raw"))
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("score", "_raw", "_n"), F.struct("score", -F.col("cand"))).alias("_b")).select(*keys, "_b.*")
    raw = F.when(F.col("_raw") >= 0, F.floor("_raw")).otherwise(F.ceil("_raw"))
    return best.where(F.col("score") >= F.greatest(F.lit(3), F.expr("_n * 2 div 3"))).select(*keys, "score", raw.cast("long").alias("coarse"))
