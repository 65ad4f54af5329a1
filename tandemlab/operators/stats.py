"""Rank statistics, effect sizes and metrics as aggregates and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bins of a running sum over a whole table.
BINS = 1024


def running(counts: DataFrame, keys: list[str], value: str, columns: list[str]) -> DataFrame:
    """counts (one row per keys and value) with `_before_<c>`, the sum of c over
    smaller values, and `_total_<c>`. Without keys no task orders the table:
    values are dealt into equal bins between the least and the greatest, and only
    the bins' sums (at most BINS + 1 rows) meet in one place."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    ahead = (Window.unboundedPreceding, -1)
    if keys:
        w = Window.partitionBy(*keys)
        before = w.orderBy(value).rowsBetween(*ahead)
        return counts.select("*", *(zero(F.sum(c).over(before)).alias(f"_before_{c}") for c in columns), *(F.sum(c).over(w).alias(f"_total_{c}") for c in columns))
    ends = counts.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), *(F.sum(c).alias(f"_total_{c}") for c in columns))
    part = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    # one row
    binned = counts.crossJoin(F.broadcast(ends)).withColumn("_bin", F.when(F.col("_hi") > F.col("_lo"), F.floor(part * BINS)).otherwise(0)).drop("_lo", "_hi")
    sums = binned.groupBy("_bin").agg(*(F.sum(c).alias(f"_sum_{c}") for c in columns))
    below = sums.select("_bin", *(zero(F.sum(f"_sum_{c}").over(Window.orderBy("_bin").rowsBetween(*ahead))).alias(f"_below_{c}") for c in columns))
    inside = Window.partitionBy("_bin").orderBy(value).rowsBetween(*ahead)
    joined = binned.join(F.broadcast(below), "_bin")
    found = joined.select("*", *((F.col(f"_below_{c}") + zero(F.sum(c).over(inside))).alias(f"_before_{c}") for c in columns))
    return found.drop("_bin", *(f"_below_{c}" for c in columns))


def average_ranks(df: DataFrame, value: str, keys: list[str] | None = None, out: str = "rank") -> DataFrame:
    """Ranks with ties averaged. Values are counted first and running counts
    are per distinct value, so equal values of any number are one row."""
    keys = keys or []
    counts = running(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")), keys, value, ["_c"])
    return df.join(counts.select(*keys, value, (F.col("_before__c") + (F.col("_c") + 1) / 2).alias(out)), [*keys, value])


def rank_sums(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Per group: n1, n0, the Mann-Whitney U of label 1 and the tie term."""
    keys = keys or []
    counts = running(df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_c"), F.sum(label).alias("_p")), keys, score, ["_c"])
    ranked = counts.withColumn("_r", F.col("_before__c") + (F.col("_c") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(
        F.sum("_p").alias("n1"), F.sum(F.col("_c") - F.col("_p")).alias("n0"), F.sum(F.col("_r") * F.col("_p")).alias("_s"), F.sum(F.pow("_c", F.lit(3)) - F.col("_c")).alias("ties")
    )
    return sums.withColumn("u", F.col("_s") - F.col("n1") * (F.col("n1") + 1) / 2).drop("_s")


def roc_auc(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Exact area, ties count half; null with one class only."""
    keys = keys or []
    sums = rank_sums(df, score, label, keys)
    return sums.select(*keys, F.round(F.try_divide(F.col("u"), F.col("n1") * F.col("n0")), 8).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    rows = running(df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_c"), F.sum(label).alias("_p")), keys, score, ["_c", "_p"])
    above = {c: F.col(f"_total_{c}") - F.col(f"_before_{c}") for c in ("_c", "_p")}
    term = F.try_divide(F.col("_p"), F.col("_total__p")) * above["_p"] / above["_c"]
    return rows.groupBy(*keys).agg(F.round(F.sum(term), 8).alias("ap"))


def mann_whitney(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """u and z (tie and continuity corrected normal approximation; null with one
    class only or all scores equal)."""
    keys = keys or []
    sums = rank_sums(df, score, label, keys)
    n = F.col("n1") + F.col("n0")
    variance = F.col("n1") * F.col("n0") / 12.0 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    gap = F.col("u") - F.col("n1") * F.col("n0") / 2.0
    z = F.signum(gap) * F.try_divide(F.greatest(F.abs(gap) - 0.5, F.lit(0.0)), F.sqrt(F.when(variance > 0, variance)))
    return sums.select(*keys, "u", F.round(z, 6).alias("z"))


#: The polynomial of the normal tail, right to 1.5e-7.
TAIL = (0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429))


def two_sided_p(z: Column) -> Column:
    """2 (1 - Phi(|z|)) by a polynomial in 1 / (1 + c |z|)."""
    t = 1 / (1 + TAIL[0] * F.abs(z))
    total = F.lit(0.0)
    for b in reversed(TAIL[1]):
        total = (total + b) * t
    return 2 * F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * total


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def stability(shares: DataFrame, reference: DataFrame) -> DataFrame:
    """Mean co-assignment (a, b, share; pairs that never met are not there) of
    pairs within a cluster of the reference (item, cluster) and between two."""
    pair = shares.join(reference.select(F.col("item").alias("a"), F.col("cluster").alias("_ca")), "a").join(reference.select(F.col("item").alias("b"), F.col("cluster").alias("_cb")), "b")
    return _inside_and_between(pair, F.lit(1), reference)


def _inside_and_between(pair: DataFrame, weight: Column, reference: DataFrame) -> DataFrame:
    """Means of pair's share (clusters _ca and _cb, so many pairs each) over all
    pairs of the reference."""
    same, total = F.col("_ca") == F.col("_cb"), F.col("share") * weight
    sums = pair.agg(F.sum(F.when(same, total)).alias("_in"), F.sum(F.when(~same, total)).alias("_out"))
    sizes = reference.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    n = F.sum("_n")
    inside = F.sum(F.col("_n") * (F.col("_n") - 1) / 2)
    pairs = sizes.agg(inside.alias("_k"), (n * (n - 1) / 2 - inside).alias("_m"))
    mean = lambda total, count: F.coalesce(F.try_divide(F.coalesce(F.col(total), F.lit(0.0)), F.col(count)), F.lit(0.0))
    # one row each
    return sums.crossJoin(F.broadcast(pairs)).select(F.round(mean("_in", "_k"), 6).alias("within"), F.round(mean("_out", "_m"), 6).alias("between"))


def cohen_d(df: DataFrame, value: str, label: str, keys: list[str] | None = None, variant: str = "pooled") -> DataFrame:
    """variant: pooled (ddof 1, weighted), mean0 and mean1 (root of the mean
    variance, ddof 0 and 1)."""
    keys = keys or []
    one, two = F.when(F.col(label) == 1, F.col(value)), F.when(F.col(label) == 0, F.col(value))
    var = F.var_pop if variant == "mean0" else F.var_samp
    row = df.groupBy(*keys).agg(F.avg(one).alias("_m1"), F.avg(two).alias("_m0"), var(one).alias("_v1"), var(two).alias("_v0"), F.count(one).alias("_n1"), F.count(two).alias("_n0"))
    if variant == "pooled":
        spread = ((F.col("_n1") - 1) * F.col("_v1") + (F.col("_n0") - 1) * F.col("_v0")) / (F.col("_n1") + F.col("_n0") - 2)
    else:
        spread = (F.col("_v1") + F.col("_v0")) / 2
    return row.select(*keys, F.round(F.when(spread > 0, (F.col("_m1") - F.col("_m0")) / F.sqrt(spread)), 6).alias("d"))


def wilson(df: DataFrame, label: str, keys: list[str], z: float = 1.96) -> DataFrame:
    """Share of label 1 with its Wilson interval."""
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("p"))
    n, p = F.col("n"), F.col("p")
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return row.select(*keys, "n", F.round(p, 6).alias("p"), F.round(F.greatest(middle - half, F.lit(0.0)), 6).alias("low"), F.round(F.least(middle + half, F.lit(1.0)), 6).alias("high"))


def anova_f(long: DataFrame, feature: str, value: str, label: str) -> DataFrame:
    """F of a one-way analysis of variance for each feature of a long table."""
    groups = long.groupBy(feature, label).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    every = Window.partitionBy(feature)
    mean = F.sum(F.col("n") * F.col("m")).over(every) / F.sum("n").over(every)
    sums = groups.withColumn("_b", F.col("n") * F.pow(F.col("m") - mean, F.lit(2))).groupBy(feature).agg(
        F.sum("_b").alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")
    )
    f = F.when((F.col("ssw") > 0) & (F.col("k") > 1), F.col("ssb") / (F.col("k") - 1) / (F.col("ssw") / (F.col("n") - F.col("k"))))
    return sums.select(feature, F.round(F.coalesce(f, F.lit(0.0)), 5).alias("f"))


def profiles(labels: DataFrame, seed: str, item: str, cluster: str) -> DataFrame:
    """(item, _class): items of the same clusters in the same seeds are a class,
    named by its least item. Items without any cluster are not there."""
    own = labels.where(F.col(cluster).isNotNull()).groupBy(item).agg(F.sort_array(F.collect_list(F.struct(seed, cluster))).alias("_profile"))
    return own.select(item, F.min(item).over(Window.partitionBy("_profile")).alias("_class"))


def met_classes(labels: DataFrame, classes: DataFrame, seed: str, item: str, cluster: str) -> DataFrame:
    """(_a, _b, share), _a <= _b: in what share of the seeds the items of two
    classes have one cluster; classes that never do are not there."""
    entries = labels.join(classes.where(F.col(item) == F.col("_class")).select(item), item)
    a, b = entries.alias("a"), entries.alias("b")
    on = (F.col(f"a.{seed}") == F.col(f"b.{seed}")) & (F.col(f"a.{cluster}") == F.col(f"b.{cluster}")) & (F.col(f"a.{item}") <= F.col(f"b.{item}"))
    both = a.join(b, on).groupBy(F.col(f"a.{item}").alias("_a"), F.col(f"b.{item}").alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    seeds = labels.agg(F.countDistinct(seed).alias("_n"))
    # one row
    return both.join(F.broadcast(seeds)).select("_a", "_b", F.round(F.col("_c") / F.col("_n"), 6).alias("share"))


def co_assignment(labels: DataFrame, seed: str, item: str, cluster: str) -> DataFrame:
    """(a, b, share): in what share of the seeds two items have one cluster.
    Shares are found between classes of equal items, whose members then meet."""
    members = profiles(labels, seed, item, cluster)
    # by item, so that a large class is many tasks' work
    parts = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = met_classes(labels, members, seed, item, cluster).join(members.select(F.col("_class").alias("_a"), F.col(item).alias("_x")), "_a").repartition(parts, "_x")
    both = left.join(members.select(F.col("_class").alias("_b"), F.col(item).alias("_y")), "_b").where("_a < _b or _x < _y")
    return both.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "share")


def class_stability(labels: DataFrame, seed: str, item: str, cluster: str, reference: int) -> DataFrame:
    """stability() against the labels of one seed, by pairs of classes and their
    sizes: no pairs of items are made."""
    chosen = labels.where((F.col(seed) == reference) & F.col(cluster).isNotNull()).select(item, F.col(cluster).alias("cluster"))
    classes = profiles(labels, seed, item, cluster)
    # the reference is part of a class' profile: one cluster each
    sizes = classes.join(chosen, item).groupBy("_class", "cluster").agg(F.count(F.lit(1)).alias("_k"))
    side = lambda k: sizes.select(F.col("_class").alias(f"_{k}"), F.col("cluster").alias(f"_c{k}"), F.col("_k").alias(f"_k{k}"))
    pair = met_classes(labels, classes, seed, item, cluster).join(side("a"), "_a").join(side("b"), "_b")
    weight = F.when(F.col("_a") == F.col("_b"), F.col("_ka") * (F.col("_ka") - 1) / 2).otherwise(F.col("_ka") * F.col("_kb"))
    return _inside_and_between(pair, weight, chosen)


def shuffled_within(df: DataFrame, group: str, ident: str, label: str, times: int, seed: int) -> DataFrame:
    """(perm, ident, label): labels re-dealt within their group, `times` over.
    The order is a hash of seed, permutation and row, so any engine repeats it."""
    perms = df.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("perm"), F.col(ident)).cast("binary"))
    w = Window.partitionBy("perm", group)
    rows = perms.withColumn("_to", F.row_number().over(w.orderBy(ident))).withColumn("_from", F.row_number().over(w.orderBy(key, ident)))
    left = rows.select("perm", group, F.col("_to").alias("_k"), ident)
    right = rows.select("perm", group, F.col("_from").alias("_k"), label)
    return left.join(right, ["perm", group, "_k"]).select("perm", ident, label)
