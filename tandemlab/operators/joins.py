"""Joins that Spark has no single operator for, as plain equi-joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Points inside closed spans. Spans are cut into time bins of `width`, so
    the join is an equi-join on keys and bin; a point has one bin, hence no
    match appears twice."""
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    here = points.withColumn("_bin", F.floor(F.col(t) / width))
    inside = (F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end))
    left, right = here.alias("_p"), binned.alias("_s")
    on = inside & (F.col("_p._bin") == F.col("_s._bin"))
    for key in keys:
        on &= F.col(f"_p.{key}") == F.col(f"_s.{key}")
    joined = left.join(right, on, how)
    return joined.select("_p.*", *(F.col(f"_s.{c}") for c in spans.columns if c not in keys)).drop("_bin")


def first_interval(points: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, end: str, label: str, width: int, ident: str) -> DataFrame:
    """points with the label of the first span (by start, then label) that holds
    them, `none` where there is none."""
    joined = interval_join(points, spans, keys, t, start, end, width, "left")
    picked = joined.groupBy(ident).agg(F.min(F.when(F.col(start).isNotNull(), F.struct(start, label))).alias("_first"))
    return picked.select(ident, F.coalesce(F.col(f"_first.{label}"), F.lit("none")).alias(label))


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], t: str, value: str | list[str], tolerance: int, ident: str) -> DataFrame:
    """(ident, t, near_t, values): the row of right nearest in time, the earlier
    one on ties, null beyond tolerance. One shuffle: both sides are stacked and
    looked at backward and forward. right's times are unique per key."""
    values = [value] if isinstance(value, str) else value
    none = F.lit(None).cast(f"struct<{', '.join(f'{v}: double' for v in values)}>")
    stacked = left.select(*keys, t, F.col(ident), none.alias("_v"), F.lit(0).alias("_r")).unionAll(
        right.select(*keys, t, F.lit(None).cast("long").alias(ident), F.struct(*(F.col(v).cast("double").alias(v) for v in values)).alias("_v"), F.lit(1).alias("_r"))
    )
    entry = F.when(F.col("_r") == 1, F.struct(F.col(t).alias("t"), F.col("_v").alias("v")))
    order = Window.partitionBy(*keys).orderBy(t)
    back = F.last(entry, ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.first(entry, ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    seen = stacked.withColumn("_b", back).withColumn("_a", ahead).where("_r = 0")
    to_b, to_a = F.col(t) - F.col("_b.t"), F.col("_a.t") - F.col(t)
    best = F.when(to_a.isNull() | (to_b <= to_a), F.col("_b")).otherwise(F.col("_a"))
    seen = seen.withColumn("_n", best)
    close = F.abs(F.col(t) - F.col("_n.t")) < tolerance
    return seen.select(ident, t, F.when(close, F.col("_n.t")).alias("near_t"), *(F.when(close, F.col(f"_n.v.{v}")).alias(v) for v in values))


def within_radius(left: DataFrame, right: DataFrame, keys: list[str], radius: float, condition: Column, ident: str) -> DataFrame:
    """Semi join: rows of left (x, y) with a row of right (x, y) closer than
    radius that fulfils condition (columns as l.* and r.*). Cells of the radius'
    size meet their nine neighbours."""
    step = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    cell = lambda df: df.withColumn("_cx", F.floor(F.col("x") / radius)).withColumn("_cy", F.floor(F.col("y") / radius))
    spread = cell(right).withColumn("_s", F.explode(step)).withColumn("_cx", F.col("_cx") + F.col("_s.a")).withColumn("_cy", F.col("_cy") + F.col("_s.b"))
    l, r = cell(left).alias("l"), spread.alias("r")
    on = (F.col("l._cx") == F.col("r._cx")) & (F.col("l._cy") == F.col("r._cy")) & condition
    for key in keys:
        on &= F.col(f"l.{key}") == F.col(f"r.{key}")
    apart = F.pow(F.col("l.x") - F.col("r.x"), 2) + F.pow(F.col("l.y") - F.col("r.y"), 2)
    return l.join(r, on & (apart < radius * radius), "left_semi").select(ident)


def nearest(points: DataFrame, route: DataFrame, ident: str, place: str, digits: int | None = None) -> DataFrame:
    """(ident, distance, place) of the nearest route point, the first on ties
    (distances are rounded to `digits` first, if given).
    The route is a fixed drawing: callers give a table of known, small size,
    which meets each point inside its task as an array."""
    whole = route.agg(F.sort_array(F.collect_list(F.struct(place, F.col("x").alias("rx"), F.col("y").alias("ry")))).alias("_route"))
    rounded = (lambda d: d) if digits is None else (lambda d: F.round(d, digits))
    far = F.transform("_route", lambda q: F.struct(rounded(F.sqrt(F.pow(F.col("x") - q["rx"], 2) + F.pow(F.col("y") - q["ry"], 2))).alias("distance"), q[place].alias(place)))
    best = F.array_min(far)
    return points.join(F.broadcast(whole)).select(ident, best["distance"].alias("distance"), best[place].alias(place))


def by_ordinal(left: DataFrame, right: DataFrame, keys: list[str], t: str) -> DataFrame:
    """The n-th of left beside the n-th of right, by time."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(t))
    a = left.withColumn("n", nth).select(*keys, "n", F.col(t).alias("left_t"))
    return a.join(right.withColumn("n", nth).select(*keys, "n", F.col(t).alias("right_t")), [*keys, "n"])


def assemble(features: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Long features (keys, source, feature, value) to one wide row per keys:
    of several values of a feature the one of the first source wins."""
    one = features.where("value is not null").groupBy(*keys, "feature").agg(F.min_by("value", "source").alias("value"))
    return one.groupBy(*keys).pivot("feature", names).agg(F.first("value"))


def beside(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Feature tables with one row per keys side by side, each column under its
    table's prefix; a row for each key that any of them has."""
    out = None
    for prefix, table in tables.items():
        named = table.select(*keys, *(F.col(f"`{c}`").alias(f"{prefix}_{c}") for c in table.columns if c not in keys))
        out = named if out is None else out.join(named, keys, "full_outer")
    return out


def marker_match(flashes: DataFrame, markers: DataFrame, trial: str = "trial") -> DataFrame:
    """flashes with the marker of their trial, whose label may stand as it is
    (T01) or as its bare number (1). The label as it is goes first; of several
    markers of one key the last (by `pos`) counts."""
    one = markers.where(F.length(F.trim(trial)) > 0).groupBy(F.trim(trial).alias("_key")).agg(F.max_by("marker_ms", "pos").alias("marker_ms")).where("marker_ms <> 0")
    bare = F.regexp_replace(F.regexp_replace(F.col(trial), "^T+", ""), "^0+", "")
    keys = F.array(F.struct(F.lit(0).alias("_by"), F.col(trial).alias("_key")), F.struct(F.lit(1).alias("_by"), F.when(bare == "", "0").otherwise(bare).alias("_key")))
    each = flashes.withColumn("_ways", keys).withColumn("_way", F.explode("_ways")).select(*flashes.columns, "_way.*")
    found = each.join(one, "_key").groupBy(*flashes.columns).agg(F.min_by("marker_ms", "_by").alias("marker_ms"))
    return flashes.join(found, flashes.columns, "left")


def nearest_other(points: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """(keys, ident, d): distance of each point (x, y) to the nearest other one
    of its keys. Points meet those of the nine cells around their own, twice the
    mean spacing wide; only who finds none closer than a cell meets all."""
    size = points.groupBy(*keys).agg(
        F.greatest(2 * F.sqrt((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")) / F.count(F.lit(1))), F.lit(1e-9)).alias("_w"), F.min("x").alias("_x0"), F.min("y").alias("_y0")
    )
    cell = points.join(size, keys).withColumn("_cx", F.floor((F.col("x") - F.col("_x0")) / F.col("_w"))).withColumn("_cy", F.floor((F.col("y") - F.col("_y0")) / F.col("_w"))).drop("_x0", "_y0")
    step = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    spread = cell.withColumn("_s", F.explode(step)).withColumn("_cx", F.col("_cx") + F.col("_s.a")).withColumn("_cy", F.col("_cy") + F.col("_s.b"))

    def least(left: DataFrame, right: DataFrame, at: list[str]) -> DataFrame:
        other = right.select(*at, F.col(ident).alias("_i"), F.col("x").alias("_x"), F.col("y").alias("_y"))
        d = F.sqrt(F.pow(F.col("x") - F.col("_x"), F.lit(2)) + F.pow(F.col("y") - F.col("_y"), F.lit(2)))
        return left.join(other, at).where(F.col(ident) != F.col("_i")).groupBy(*keys, ident).agg(F.min(d).alias("d"))

    near = cell.join(least(cell, spread, [*keys, "_cx", "_cy"]), [*keys, ident], "left")
    sure = F.coalesce(F.col("d") <= F.col("_w"), F.lit(False))
    rest = least(near.where(~sure).drop("d"), points, keys)
    return near.where(sure).select(*keys, ident, "d").unionAll(rest)
