"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemlab.llm.common import WORD, cut, doc_key, numbered_copies, packed, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Bins per source and level of the ranking variable. Only the bin of a bin that
#: holds the cut is ever sorted: about one in a million of a source's documents.
BINS = 1024
LEVELS = 2
KEY = ["doc_id", "text_crc32", "copy"]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sizes: one row per source (source, source_size). Adds `target`: the share
    of all sizes by weight, where the sources in code point order (null last)
    weigh weights[0], weights[1], .. repeating. No target passes `most` times
    its source's size; what it leaves is shared again by weight.

    This is a water level: with sources ordered by cap over weight, the full
    ones are a prefix, so running sums give the level without a loop. One task
    orders one row per source: sources are named collections, of which a task
    can order millions."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("_k", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_k") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most)
    by_fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_k").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(by_fill), F.lit(0.0))) / (
        F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(by_fill), F.lit(0.0))
    )
    # the level if all before this row are full; the first row it doesn't fill sets the level
    ranked = ranked.withColumn("_level", level)
    fill = F.col("_cap") / F.col("_w")
    chosen = F.min(F.when(fill >= F.col("_level"), F.struct(fill, "_k", "_level"))).over(every)["_level"]
    return ranked.select("source", "source_size", F.least("_cap", F.col("_w") * F.coalesce(chosen, F.lit(0.0))).alias("target"))


def size_classes(size: Column) -> Column:
    """1 for one word, and 1 more for each doubling; 0 without words."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def inclusion(classes: DataFrame, most: float = MOST) -> DataFrame:
    """classes: (source, target, class, words), the words of a source's documents
    of each size class. Returns (source, rate): a document is wanted
    min(rate * class, most) times, so that long ones come oftener than short
    ones, and the words wanted of a source sum to its target.

    The classes that reach `most` are the highest ones; the rate is that of the
    highest class which doesn't, if all above it do."""
    by_source = Window.partitionBy("source")
    above = F.coalesce(F.sum("words").over(by_source.orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    upto = F.sum(F.col("class") * F.col("words")).over(by_source.orderBy("class").rowsBetween(Window.unboundedPreceding, 0))
    rated = classes.withColumn("rate", (F.col("target") - most * above) / upto)
    fits = F.col("rate") * F.col("class") <= most + 1e-9
    return rated.groupBy("source").agg(F.max_by("rate", F.when(fits, F.col("class"))).alias("rate"))


def uniform(*cols: str, seed: int) -> Column:
    """In (0, 1), from 52 bits of a digest of the seed and the columns."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def sized_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("digest"),
    )
    return numbered_copies(rows, ["doc_id", "source", "size", "text_crc32", "digest"])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 17) -> DataFrame:
    """Copies of each row in the mix: doc_id, source, text_crc32, copy, size,
    source_size, target, copies, taken (= copies * size).

    Each document has a number of copies wanted of it (see inclusion), which
    grows with the doublings of its size: its floor is certain whole copies, the
    fraction f the inclusion probability of one more. The documents of a source
    are ranked by Pareto's variable Q = (u / (1 - u)) / (f / (1 - f)), u a digest
    of seed, id, text and copy, and taken in that order: a sample of fixed size,
    counted in words, as targets are words. Documents are taken while the words
    last; once, those that no longer fit are passed over, and the order goes on
    among the ones that do.

    Sources are null-safe: null is a source of its own, ordered last. Null text
    has no words. Rows equal in all of this are told apart by `copy`. A document
    without words has no copies, a source without words the target 0. The result
    depends on the rows alone.
    """
    rows = sized_rows(docs, id_col, text_col, source_col)
    u = uniform("doc_id", "digest", "copy", seed=seed)
    rows = cut(rows.withColumn("class", size_classes(F.col("size"))).withColumn("u", u).drop("digest"), "sized")
    sums = cut(rows.groupBy("source", "class").agg(F.sum("size").cast("double").alias("words")), "classes")
    targets = cut(source_targets(sums.groupBy("source").agg(F.sum("words").cast("long").alias("source_size")), weights, most), "targets")
    classes = _beside_source(sums.where("class > 0"), targets.select("source", "target"))
    rates = inclusion(classes, most)
    # one row per source and class (at most 64): what all its documents share
    plan = _beside_source(_beside_source(sums, targets), rates, "left")
    wanted = F.when(F.col("class") > 0, F.least(F.col("rate") * F.col("class"), F.lit(most))).otherwise(0.0)
    plan = plan.withColumn("_e", wanted).withColumn("_whole", F.floor(F.col("_e") + 1e-9))
    plan = plan.withColumn("_f", F.when(F.col("_e") - F.col("_whole") > 1e-9, F.col("_e") - F.col("_whole")))
    rest = F.col("target") - F.sum(F.col("_whole") * F.col("words")).over(Window.partitionBy("source"))
    plan = cut(plan.select("source", "class", "source_size", "target", "_whole", "_f", rest.alias("rest")), "plan")

    plan = plan.withColumnRenamed("source", "_source").withColumnRenamed("class", "_class")
    ranked = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class"))).drop("_source", "_class")
    odds = F.col("u") / (1 - F.col("u"))
    ranked = ranked.withColumn("q", odds * (1 - F.col("_f")) / F.col("_f"))
    one = drawn_in_order(ranked.where("q is not null"))
    ranked = _beside_source(ranked, one, "left").withColumn("_one", _within("_to")).drop("_to")
    ranked = ranked.withColumn("rest", F.col("rest") - F.coalesce("_words", F.lit(0))).drop("_words")
    two = drawn_in_order(ranked.where("q is not null and not _one and size <= rest"))
    ranked = _beside_source(ranked, two, "left").withColumn("_two", ~F.col("_one") & (F.col("size") <= F.col("rest")) & _within("_to"))
    copies = (F.col("_whole") + F.col("_one").cast("long") + F.col("_two").cast("long")).cast("long")
    return ranked.select("doc_id", "source", "text_crc32", "copy", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _beside_source(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns of a table of one row per source, null being one."""
    named = table.withColumnRenamed("source", "_source")
    return rows.join(named, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _place() -> Column:
    return F.struct("q", *KEY)


def _within(to: str) -> Column:
    return F.coalesce(F.col("q").isNotNull() & (_place() <= F.col(to)), F.lit(False))


def drawn_in_order(ranked: DataFrame) -> DataFrame:
    """ranked: (source, q, KEY, size > 0, rest). Per source the place in the order
    of q up to which its documents sum to `rest` words at most, and those words:
    (source, _to, _words). Sources with none are left out.

    The order is followed by bins of q, and only in the bin where the words run
    out by finer bins, so that a task sorts few documents of any source."""
    part = F.col("q") / (1 + F.col("q"))
    rows = ranked.withColumn("_start", F.lit(0).cast("long"))
    done = None
    for level in range(1, LEVELS + 1):
        rows = rows.withColumn("_fine", F.floor(part * float(BINS**level)))
        sums = rows.groupBy("source", "rest", "_start", "_fine").agg(F.sum("size").alias("_n"), F.max(_place()).alias("_last"))
        upto = F.sum("_n").over(Window.partitionBy("source").orderBy("_fine"))
        sums = cut(sums.withColumn("_upto", F.col("_start") + upto), f"bins-{level}")
        whole = sums.where("_upto <= rest").groupBy("source").agg(F.max("_last").alias("_to"), F.max("_upto").alias("_words"))
        done = whole if done is None else done.unionAll(whole)
        crossed = sums.where("_upto > rest").groupBy("source").agg(F.min(F.struct("_upto", "_fine", "_n")).alias("_c"))
        crossed = cut(crossed.select("source", F.col("_c._fine").alias("_at"), (F.col("_c._upto") - F.col("_c._n")).alias("_from")), f"cut-bins-{level}")
        rows = _beside_source(rows.drop("_start"), crossed).where("_fine = _at").withColumn("_start", F.col("_from")).drop("_at", "_from")
    run = F.col("_start") + F.sum("size").over(Window.partitionBy("source").orderBy(_place()))
    last = rows.withColumn("_run", run).where("_run <= rest").groupBy("source").agg(F.max(_place()).alias("_to"), F.max("_run").alias("_words"))
    return cut(done.unionAll(last).groupBy("source").agg(F.max("_to").alias("_to"), F.max("_words").alias("_words")), "drawn")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs as often as the mix takes them, columns unchanged. Of
    rows equal in id, source and text the first comes as often as all together."""
    plan = mix(docs, id_col, text_col, source_col, **how)
    plan = plan.groupBy(doc_key("doc_id", F.col("text_crc32"), F.col("source")).alias("_key")).agg(F.sum("copies").alias("_n")).where("_n > 0")
    crc = F.crc32(text_or_empty(f"_row.{text_col}").cast("binary"))
    keyed = packed(docs).withColumn("_key", doc_key(f"_row.{id_col}", crc, F.col(f"_row.{source_col}").cast("string")))
    # rows equal in id, source and text share one plan row: its copies go to the first
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(1)))
    joined = keyed.join(plan.hint("merge"), "_key").withColumn("_nth", nth).where("_nth = 1")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_row.*")
