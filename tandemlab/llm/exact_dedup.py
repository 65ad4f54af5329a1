"""Exact deduplication by distributed MSD radix partitioning.

A round compares the next digit (a run of bytes; digits grow eightfold) of all
documents that still share their bytes so far. A document alone with its digit
is done; so are all that ended within it, which are equal. The others go on
with what remains of their text. Equality is that of the bytes themselves.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemlab.llm.common import cut, doc_key, packed, text_or_empty

FIRST_DIGIT, GROWTH = 64, 8


def normalised(text_col: str) -> Column:
    """UTF-8 with A-Z lower-cased and nothing else changed; null is empty. Where
    all characters are ASCII, lower does just that, and faster."""
    text = text_or_empty(text_col)
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).cast("binary")


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of two or more rows alike in keys. Counted with partial sums, so a
    group of any size is one row per map task."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("doc_id").alias("_keep")).where("_n > 1")
    return cut(counted.withColumn("_next", F.monotonically_increasing_id()), "radix-groups")


def equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT) -> DataFrame:
    """One row per row of docs: doc_id, keep_id (the largest doc_id with an equal
    text), group_size (rows), text_sha256 (of the normalised text), kept.

    Null texts equal the empty text. A null doc_id ranks below every other:
    keep_id is null only if all of the group are null. Of rows that are equal
    in doc_id and text, one is kept at most. Empty input gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("_data"))
    digit, rest = F.expr(f"substring(_data, 1, {first_digit})").alias("digit"), F.expr(f"substring(_data, {first_digit + 1})").alias("rest")
    groups = _groups(source.select("doc_id", digit), ["digit"])
    # the digest is only handed on, never compared
    rows = source.select("doc_id", digit, rest, F.sha2("_data", 256).alias("text_sha256"))
    keys, width, done = ["digit"], first_digit, []
    while True:
        # both sides are shuffled for this join alone, so AQE can split hot groups;
        # the groups grow with the input and are never broadcast
        joined = rows.join(groups.hint("merge"), keys, "left")
        ended = F.octet_length("digit") < width
        alone = F.col("_n").isNull()
        state = joined.select(
            "doc_id",
            "text_sha256",
            F.when(alone, F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
            F.coalesce("_n", F.lit(1)).alias("group_size"),
            F.when(~alone & ~ended, F.col("_next")).alias("group"),
            F.when(~alone & ~ended, F.col("rest")).alias("rest"),
        )
        state = cut(state, "radix-rows")
        done.append(state.where("group is null").drop("group", "rest"))
        active = state.where("group is not null")
        if active.isEmpty():
            break
        width *= GROWTH
        rows = active.select("doc_id", "text_sha256", "group", F.expr(f"substring(rest, 1, {width})").alias("digit"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
        keys = ["group", "digit"]
        groups = _groups(rows, keys)
    return _one_kept(reduce(DataFrame.unionAll, done))


def _one_kept(rows: DataFrame) -> DataFrame:
    """Adds kept: doc_id is keep_id, and of rows equal in all columns only one."""
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_times"))
    each = counted.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return each.select(*columns, (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)).alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that equal_texts keeps, columns unchanged."""
    kept = equal_texts(docs, id_col, text_col).where("kept").select(doc_key("doc_id", F.col("text_sha256")).alias("_key"))
    digests = packed(docs).withColumn("_sha", F.sha2(normalised(f"_row.{text_col}"), 256))
    keyed = digests.select("_row", doc_key(f"_row.{id_col}", F.col("_sha")).alias("_key"))
    first = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(1)))
    return keyed.join(kept.hint("merge"), "_key", "left_semi").withColumn("_nth", first).where("_nth = 1").select("_row.*")
