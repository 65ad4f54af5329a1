"""Star-schema tables seen as recordings of two-person sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlab.functions.scalars import safe_long

ORIGIN = "2024-01-01"


#: The areas of a screen in the units of the samples below.
SAMPLE_AREAS = {
    "director": (("timer", 0, 0, 120, 120), ("map", 100, 100, 300, 700), ("toolbar", 280, 0, 420, 900)),
    "matcher": (("timer", 0, 0, 120, 120), ("map", 80, 100, 280, 700), ("toolbar", 280, 0, 440, 900)),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples: a pair of users is a dyad, five days are a trial, t is
    milliseconds since the trial's start."""
    events = read(spark, sf_dir, "events")
    ms = F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'{ORIGIN}', ts)")
    trial = F.expr("least((day(ts) - 1) div 5, 5)")
    return events.select(
        "event_id",
        "user_id",
        F.expr("user_id div 2").alias("dyad"),
        F.when(F.col("user_id") % 2 == 0, "director").otherwise("matcher").alias("role"),
        (trial + 3).cast("int").alias("trial"),
        (ms - trial * 5 * 86400000).alias("t"),
        "event_type",
        F.col("value").alias("x"),
        (safe_long(F.get_json_object("props", "$.k")) * 9.0).alias("y"),
        (60 + F.col("value") / 10).alias("bpm"),
    )


#: The same table for the SQL twins.
SAMPLES_SQL = """s as (
  select event_id, user_id, user_id // 2 as dyad, case when user_id % 2 = 0 then 'director' else 'matcher' end as role,
    cast(least((day(ts) - 1) // 5, 5) + 3 as int) as trial,
    epoch_us(ts) // 1000 - 1704067200000 - least((day(ts) - 1) // 5, 5) * 5 * 86400000 as t,
    event_type, value as x, cast(json_extract(props, '$.k') as bigint) * 9.0::double as y, 60 + value / 10 as bpm
  from events)"""
