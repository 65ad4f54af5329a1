"""Time-series operators on rows (keys, i, value): grids, recurrence, entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemlab.functions.scalars import corr, slope


def indexed(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """(keys, i, v, n): a gapless index from 0 and the series' length."""
    w = Window.partitionBy(*keys)
    return df.select(*keys, (F.row_number().over(w.orderBy(*order)) - 1).cast("int").alias("i"), value.cast("double").alias("v"), F.count(F.lit(1)).over(w).alias("n"))


def strided(series: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Every k-th row of an indexed series, k the whole number of times that
    `most` goes into its length (1 at least)."""
    step = F.greatest(F.floor(F.col("n") / most), F.lit(1))
    return series.withColumn("_step", step).where("i % _step = 0").withColumn("i", F.expr("cast(i div _step as int)")).drop("_step")


def on_grid(df: DataFrame, keys: list[str], t: str, value: str, start: Column, end: Column, step: int, inclusive: bool = True) -> DataFrame:
    """(keys, t, v): linear interpolation at start, start + step, .. end; the
    edge value outside the series. df's times are unique per key; start and end
    are aggregates over a key."""
    bounds = df.groupBy(*keys).agg(start.alias("_s"), end.alias("_e"))
    last = F.col("_e") if inclusive else F.col("_e") - 1
    ticks = bounds.where(last >= F.col("_s")).select(*keys, F.explode(F.sequence("_s", last, F.lit(step).cast("long"))).alias(t), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_g"))
    both = df.select(*keys, t, F.col(value).cast("double").alias("_v"), F.lit(0).alias("_g")).unionAll(ticks)
    known = F.when(F.col("_g") == 0, F.struct(F.col(t).alias("t"), F.col("_v").alias("v")))
    w = Window.partitionBy(*keys).orderBy(t)
    both = both.withColumn("_b", F.last(known, True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_a", F.first(known, True).over(w.rangeBetween(0, Window.unboundedFollowing)))
    part = (F.col(t) - F.col("_b.t")) / (F.col("_a.t") - F.col("_b.t"))
    between = F.when(F.col("_a.t") == F.col("_b.t"), F.col("_b.v")).otherwise(F.col("_b.v") + part * (F.col("_a.v") - F.col("_b.v")))
    return both.where("_g = 1").select(*keys, t, F.coalesce(between, F.col("_b.v"), F.col("_a.v")).alias("v"))


def on_fixed_grid(df: DataFrame, keys: list[str], t: str, value: str, start: int, end: int, step: int) -> DataFrame:
    """(keys, t, v): linear interpolation at start, start + step, .. below end;
    null before a series' first time and after its last."""
    ends = df.groupBy(*keys).agg(F.min(t).alias("_first"), F.max(t).alias("_last"))
    grid = on_grid(df, keys, t, value, F.max(F.lit(start).cast("long")), F.max(F.lit(end).cast("long")), step, inclusive=False)
    inside = F.col(t).between(F.col("_first"), F.col("_last"))
    return grid.join(ends, keys).select(*keys, t, F.when(inside, F.col("v")).alias("v"))


def recurrences(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], radius: Column, theiler: int | None) -> DataFrame:
    """(keys, i, j): pairs of points of two indexed series (i, columns, n) within
    radius (over both sides' columns as a.*, b.*) by Euclidean distance; pairs
    with |i - j| < theiler are left out. Callers bound the series' length."""
    a, b = left.alias("a"), right.alias("b")
    on = F.lit(True)
    for key in keys:
        on &= F.col(f"a.{key}") == F.col(f"b.{key}")
    apart = F.lit(0.0)
    for c in columns:
        apart = apart + F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), 2)
    on &= F.sqrt(apart) <= radius
    if theiler:
        on &= F.abs(F.col("a.i") - F.col("b.i")) >= theiler
    return a.join(b, on).select(*(F.col(f"a.{k}") for k in keys), F.col("a.i").alias("i"), F.col("b.i").alias("j"))


def line_metrics(edges: DataFrame, sizes: DataFrame, keys: list[str], shortest: int = 2) -> DataFrame:
    """Recurrence quantification of an edge list. sizes: keys and `cells`, the
    number of cells that could recur. Lines are islands on a diagonal (i - j)
    or in a column; each window holds one diagonal or column, never a matrix."""

    def lines(line: Column, place: str, names: tuple[str, ...]) -> DataFrame:
        rows = edges.select(*keys, line.alias("_l"), F.col(place).alias("_p"))
        island = F.col("_p") - F.row_number().over(Window.partitionBy(*keys, "_l").orderBy("_p"))
        runs = rows.withColumn("_i", island).groupBy(*keys, "_l", "_i").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= shortest)
        lengths = runs.groupBy(*keys, "_n").agg(F.count(F.lit(1)).alias("_c"))
        total = F.sum("_c").over(Window.partitionBy(*keys))
        p = F.col("_c") / total
        lengths = lengths.withColumn("_h", -p * F.ln(p))
        covered, mean, most, spread = names
        return lengths.groupBy(*keys).agg(
            F.sum(F.col("_n") * F.col("_c")).alias(covered), (F.sum(F.col("_n") * F.col("_c")) / F.sum("_c")).alias(mean), F.max("_n").alias(most), F.sum("_h").alias(spread)
        )

    count = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_e"))
    diagonal = lines(F.col("i") - F.col("j"), "i", ("_d", "mean_diag", "max_diag", "entropy"))
    column = lines(F.col("j"), "i", ("_v", "trapping_time", "max_vert", "entropy_vert"))
    joined = sizes.join(count, keys, "left").join(diagonal, keys, "left").join(column, keys, "left")
    longest = F.coalesce("max_diag", F.lit(0))
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double")
    return joined.select(
        *keys,
        F.round(share("_e", "cells"), 6).alias("rr"),
        F.round(share("_d", "_e"), 6).alias("det"),
        F.round(zero("mean_diag"), 6).alias("mean_diag"),
        longest.cast("long").alias("max_diag"),
        F.round(F.when(longest > 0, 1 / longest).otherwise(0.0), 6).alias("div"),
        F.round(zero("entropy"), 6).alias("entropy"),
        F.round(share("_v", "_e"), 6).alias("lam"),
        F.round(zero("trapping_time"), 6).alias("trapping_time"),
        F.coalesce("max_vert", F.lit(0)).cast("long").alias("max_vert"),
        F.round(zero("entropy_vert"), 6).alias("entropy_vert"),
    )


def embedded(series: DataFrame, keys: list[str]) -> DataFrame:
    """Two-dimensional delay embedding (v, w) with the length of the series."""
    w = Window.partitionBy(*keys).orderBy("i")
    sd = F.stddev_samp("v").over(Window.partitionBy(*keys))
    return series.withColumn("w", F.lead("v").over(w)).withColumn("sd", sd).where("w is not null")


def sample_entropy(series: DataFrame, keys: list[str], r: float = 0.2) -> DataFrame:
    """Template lengths 2 and 3, Chebyshev distance, N - length templates of
    each (so N - 2 and N - 3), pairs i < j; null where a count is 0 or the series is constant or under 4 points."""
    w = Window.partitionBy(*keys).orderBy("i")
    sd = F.stddev_samp("v").over(Window.partitionBy(*keys))
    rows = series.select(*keys, "i", "n", "v", F.lead("v", 1).over(w).alias("v1"), F.lead("v", 2).over(w).alias("v2"), (sd * r).alias("r"))
    rows = rows.where("n >= 4 and i < n - 2 and r > 0")
    a, b = rows.alias("a"), rows.alias("b")
    on = F.col("a.i") < F.col("b.i")
    for key in keys:
        on &= F.col(f"a.{key}") == F.col(f"b.{key}")
    near = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= F.col("a.r")
    pairs = a.join(b, on & near("v") & near("v1"))
    two = F.count(F.lit(1))
    three = F.sum(F.when((F.col("b.i") < F.col("b.n") - 3) & near("v2"), 1).otherwise(0))
    counted = pairs.groupBy(*(F.col(f"a.{k}").alias(k) for k in keys)).agg(two.alias("m2"), three.alias("m3"))
    value = F.when((F.col("m2") > 0) & (F.col("m3") > 0), -F.ln(F.col("m3") / F.col("m2")))
    return series.select(*keys).distinct().join(counted, keys, "left").select(*keys, F.round(value, 6).alias("sampen"))


def dfa_alpha(series: DataFrame, keys: list[str], low: int = 4, high: int = 16) -> DataFrame:
    """Detrended fluctuation exponent over scales low.. below min(high + 1,
    N div 2); series under 18 points are left out."""
    w = Window.partitionBy(*keys)
    mean = F.avg("v").over(w)
    rows = series.where("n >= 18").withColumn("y", F.col("v") - mean)
    rows = rows.withColumn("y", F.sum("y").over(w.orderBy("i")))
    top = F.least(F.lit(high + 1), F.expr("cast(n div 2 as int)")) - 1
    rows = rows.where(top >= low).withColumn("scale", F.explode(F.sequence(F.lit(low), top)))
    rows = rows.withColumn("seg", F.expr("i div scale")).where("seg < n div scale")
    x = F.col("i").cast("double")
    residual = F.var_pop("y") - F.covar_pop(x, F.col("y")) * F.covar_pop(x, F.col("y")) / F.var_pop(x)
    segments = rows.groupBy(*keys, "scale", "seg").agg(F.sqrt(F.greatest(residual, F.lit(0.0))).alias("rms"))
    scales = segments.groupBy(*keys, "scale").agg(F.avg("rms").alias("f")).where("f > 0")
    logs = scales.withColumn("lx", F.ln(F.col("scale").cast("double"))).withColumn("ly", F.ln("f"))
    return logs.groupBy(*keys).agg(F.round(slope(F.col("ly"), F.col("lx")), 5).alias("alpha1"))


def windowed(series: DataFrame, keys: list[str], width: int, step: int, i: str = "i") -> DataFrame:
    """Each row once for each window [s, s + width) with s = 0, step, .. that
    ends within the series of length n."""
    first = F.greatest(F.lit(0), F.ceil((F.col(i) - width + 1) / step)).cast("int")
    last = F.least(F.floor(F.col(i) / step), F.floor((F.col("n") - width) / step)).cast("int")
    return series.where(F.col("n") >= width).withColumn("_f", first).withColumn("_t", last).where("_f <= _t").withColumn("win", F.explode(F.sequence("_f", "_t"))).drop("_f", "_t")


def transfer_entropy(pairs: DataFrame, keys: list[str], source: str, target: str, name: str) -> DataFrame:
    """Binary up/down symbols, log2; pairs: keys, i, and the two series."""
    w = Window.partitionBy(*keys).orderBy("i")
    up = lambda c: F.when(F.col(c) > F.lag(c).over(w), 1).otherwise(0)
    sym = pairs.withColumn("s", up(source)).withColumn("t", up(target)).where("i > 0")
    rows = sym.select(*keys, "s", "t", F.lead("t").over(w).alias("nx")).where("nx is not null")
    joint = rows.groupBy(*keys, "nx", "t", "s").agg(F.count(F.lit(1)).alias("c"))
    part = lambda *more: F.sum("c").over(Window.partitionBy(*keys, *more))
    terms = joint.withColumn("h", F.col("c") / part() * F.log2(F.col("c") * part("t") / (part("t", "s") * part("nx", "t"))))
    return terms.groupBy(*keys).agg(F.round(F.sum("h") + 0.0, 6).alias(name))


def lag_profile(pairs: DataFrame, keys: list[str], lags: int, least: int) -> DataFrame:
    """Pearson r of a(i) and b(i + lag) for each lag with `least` pairs or more."""
    shifted = pairs.select(*keys, F.col("i").alias("_i"), F.col("b"))
    each = pairs.select(*keys, "i", "a").withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags)))).withColumn("_i", F.col("i") + F.col("lag"))
    found = each.join(shifted, [*keys, "_i"]).groupBy(*keys, "lag").agg(corr("a", "b").alias("r"), F.count(F.lit(1)).alias("_n"))
    return found.where((F.col("_n") >= least) & F.col("r").isNotNull()).drop("_n")
