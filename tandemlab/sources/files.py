"""Readers and writers of recordings: CSV and TSV exports, session archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandemlab.functions.scalars import AREAS, area_of, filetime_ms, safe_double, safe_long
from tandemlab.operators.features import is_blink


def column_or_null(df: DataFrame, name: str, kind: str = "string"):
    """A column that may be absent."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def read_headed(spark: SparkSession, path: str, names: list[str], sep: str = ",") -> DataFrame:
    """A tracker export with # lines on top: data rows by position after the
    header line, with the `Unix time` of the top as `unix_s`."""
    lines = spark.read.text(path, wholetext=False).withColumn("_file", F.col("_metadata.file_path"))
    unix = lines.where("value like '#%Unix time%'").groupBy("_file").agg(F.min(safe_double(F.regexp_extract("value", r"Unix time:?\s*([0-9.]+)", 1))).alias("unix_s"))
    data = lines.where("value not like '#%' and length(trim(value)) > 0").where(~F.col("value").startswith(names[0]))
    parts = F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"sep": sep})
    return data.select("_file", parts.alias("_r")).join(F.broadcast(unix), "_file", "left").select("_file", "unix_s", "_r.*")


def aurora_gaze(raw: DataFrame) -> DataFrame:
    """Time and gaze alone of aurora_samples."""
    return aurora_samples(raw).select("t", "x", "y")


def aurora_samples(raw: DataFrame, lids_shut: float = 0.2) -> DataFrame:
    """Gaze with the interpolated pair where either coordinate is missing, the
    eyelids and pupils where the export has them, and whether it is a blink (see
    features.is_blink)."""
    x, y = safe_double(F.col("gaze_x")), safe_double(F.col("gaze_y"))
    whole = x.isNotNull() & y.isNotNull()
    at = F.floor(F.col("unix_s") * 1000 + safe_double(F.col("timestamp")))
    eye = {name: safe_double(column_or_null(raw, name)) for name in ("eyelid_left", "eyelid_right", "pupil_left", "pupil_right")}
    rows = raw.select(
        at.cast("long").alias("t"), F.when(whole, x).otherwise(safe_double(F.col("interp_x"))).alias("x"), F.when(whole, y).otherwise(safe_double(F.col("interp_y"))).alias("y"), *(c.alias(n) for n, c in eye.items())
    )
    blink = is_blink(F.col("eyelid_left"), F.col("eyelid_right"), F.col("pupil_left"), F.col("pupil_right"), F.col("x"), lids_shut)
    return rows.withColumn("blink", blink.cast("int"))


def labelled(gaze: DataFrame, bounds: DataFrame, role: str, areas: dict = AREAS) -> DataFrame:
    """Gaze with the area of the role's screen and the first trial (by start,
    then label) whose closed bounds (label, start, end) hold its time, else
    no_trial. A session's trials are few: they meet each row in its task."""
    # the trials of one session, some ten rows
    trials = bounds.agg(F.sort_array(F.collect_list(F.struct("start", "label", "end"))).alias("_trials"))
    inside = F.filter("_trials", lambda b: F.col("t").between(b["start"], b["end"]))
    rows = gaze.crossJoin(F.broadcast(trials))
    trial = F.coalesce(F.get(inside, F.lit(0))["label"], F.lit("no_trial"))
    return rows.withColumn("trial", trial).withColumn("aoi", area_of(F.col("x"), F.col("y"), F.lit(role), areas)).withColumn("role", F.lit(role)).drop("_trials")


#: The columns of a unified gaze table.
GAZE = (
    "t_unix_ms long, t_iso string, trial string, gaze_x double, gaze_y double, aoi string, pupil_left double, pupil_right double, head_pitch double, head_yaw double, head_roll double, "
    "fixation_idx string, fixation_x double, fixation_y double, fixation_duration double, saccade_idx string, saccade_amplitude double, saccade_peak_velocity double, saccade_direction double, "
    "gaze_velocity double, blink string, eyelid_left double, eyelid_right double, role string, source string"
)


def gaze_tables(spark: SparkSession, path: str, trial: str | None = None) -> DataFrame:
    """Unified gaze CSVs under path (folders and globs too) with their file in
    `file`; of one trial, if one is named (the filter reaches the scan)."""
    rows = spark.read.schema(GAZE).option("header", True).option("enforceSchema", False).csv(path).withColumn("file", F.col("_metadata.file_path"))
    return rows if trial is None else rows.where(F.col("trial") == trial)


ROUTE = "image struct<width: int, height: int>, strokes array<struct<points: array<struct<x: double, y: double>>, polyline: array<struct<x: double, y: double>>>>"


def routes(spark: SparkSession, path: str) -> DataFrame:
    """(map, place, x, y, width, height) of the files gt_<map>.json under path, in
    the order of their strokes. A map without a file has no rows."""
    whole = spark.read.schema(ROUTE).option("multiLine", True).option("pathGlobFilter", "gt_*.json").json(path)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"gt_([0-9]+)\.json$", 1).try_cast("int")
    rows = whole.select(number.alias("map"), "image", F.posexplode("strokes").alias("_s", "_stroke"))
    points = F.coalesce("_stroke.points", "_stroke.polyline")
    rows = rows.select("map", "image", "_s", F.posexplode(points).alias("_p", "_point")).where("_point.x is not null and _point.y is not null")
    place = F.row_number().over(Window.partitionBy("map").orderBy("_s", "_p")) - 1
    return rows.select("map", place.alias("place"), "_point.x", "_point.y", "image.width", "image.height")


def heart_rate_baselines(members: DataFrame) -> DataFrame:
    """(archive, director, matcher) of the session's hr_baseline.json: numbers
    only, null for anything else; archives without the file have no row."""
    text = members.where(F.col("member").endswith("hr_baseline.json")).select("archive", F.decode("content", "utf-8").alias("_json"))
    value = F.try_parse_json("_json")
    number = lambda who: F.when(F.schema_of_variant(F.variant_get(value, f"$.{who}", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(value, f"$.{who}", "double"))
    return text.select("archive", number("director").alias("director"), number("matcher").alias("matcher"))


def write_session_tables(tables: dict[str, DataFrame], path: str, session: str = "session") -> None:
    """One Parquet table per family under path, partitioned by session; a
    session written again replaces its own partitions alone."""
    for name, table in tables.items():
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(session).parquet(f"{path.rstrip('/')}/{name}")


def screen_gaze(raw: DataFrame, screen: str | None = None) -> DataFrame:
    """Rows on the named screen (all, if none is named); clock ticks since 1601;
    the filtered pair, else the raw one where it is missing or (0, 0); pupils in
    metres become millimetres."""
    rows = raw.where((safe_long(F.col("RealTimeClock")) > 0)) if screen is None else raw.where((safe_long(F.col("RealTimeClock")) > 0) & (F.col("screen") == screen))
    fx, fy = safe_double(F.col("filtered_x")), safe_double(F.col("filtered_y"))
    use = fx.isNotNull() & fy.isNotNull() & ~((fx == 0) & (fy == 0))
    pupil = safe_double(F.col("pupil"))
    return rows.select(
        filetime_ms(safe_long(F.col("RealTimeClock"))).alias("t"),
        F.when(use, fx).otherwise(safe_double(F.col("raw_x"))).alias("x"),
        F.when(use, fy).otherwise(safe_double(F.col("raw_y"))).alias("y"),
        F.when((pupil > 0) & (pupil < 0.1), pupil * 1000).otherwise(pupil).alias("pupil"),
    )


def heart_rate(lines: DataFrame) -> DataFrame:
    """t, bpm, phase of `t,x,bpm[,phase]` text lines; others are dropped."""
    parts = F.split("value", ",")
    rows = lines.select(F.get(parts, F.lit(0)).alias("_t"), safe_double(F.get(parts, F.lit(2))).alias("bpm"), F.get(parts, F.lit(3)).alias("phase"), F.size(parts).alias("_n"))
    return rows.where(F.col("_t").rlike("^[0-9]+$") & (F.col("_n") >= 3)).select(F.col("_t").cast("long").alias("t"), "bpm", "phase")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, content) of zip archives: a one-off ingest step."""

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        if not member.endswith("/"):
                            yield pa.RecordBatch.from_pydict({"archive": [name], "member": [member], "content": [archive.read(member)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unzip, "archive string, member string, content binary")


EVENT = "array<struct<t: bigint, type: string, role: string, payload: string>>"


def archive_events(members: DataFrame) -> DataFrame:
    """Events of the JSON members, in file order (`pos`)."""
    text = members.where(F.col("member").endswith("events.json")).select("archive", "member", F.decode("content", "utf-8").alias("_json"))
    return text.select("archive", "member", F.posexplode(F.from_json("_json", EVENT)).alias("pos", "_e")).select("archive", "member", "pos", "_e.*")


def trial_bounds(events: DataFrame, keys: list[str]) -> DataFrame:
    """Start: the first draw_stroke, else the first time; end: the last
    trial_final_time in file order, else the last time in file order."""
    when = lambda kind: F.when(F.col("type") == kind, F.col("pos"))
    return events.groupBy(*keys).agg(
        F.coalesce(F.min_by("t", when("draw_stroke")), F.min_by("t", "pos")).alias("start"),
        F.coalesce(F.max_by("t", when("trial_final_time")), F.max_by("t", "pos")).alias("end"),
    )


def flashes(events: DataFrame) -> DataFrame:
    stamp = safe_long(F.get_json_object("payload", "$.flashTs"))
    at = F.coalesce(F.nullif(stamp, F.lit(0)), F.nullif(F.col("t"), F.lit(0)))
    return events.where("type = 'sync_flash'").withColumn("flash", at).where("flash is not null")


def write_union(tables: list[DataFrame], path: str) -> None:
    """CSV with the union of all columns in first-seen order, null as empty."""
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table, allowMissingColumns=True)
    whole.write.option("header", True).option("nullValue", "").csv(path)


def first_payload(events: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """The first event of a kind in file order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    return events.where(F.col("type") == kind).withColumn("_n", nth).where("_n = 1").drop("_n")
