"""Live marker streams and streaming twins of the windowed operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlab.functions.scalars import safe_double

FLASH = "type string, trial string, flashTs double, sessionId string"


def encode(messages: DataFrame, value: str = "value") -> DataFrame:
    """JSON messages of type flash to `flash|trial|ts|session`; others and
    malformed ones are dropped."""
    m = F.from_json(value, FLASH)
    rows = messages.withColumn("_m", m).where("_m.type = 'flash'")
    parts = (F.coalesce("_m.trial", F.lit("?")), F.coalesce(F.col("_m.flashTs"), F.lit(0.0)).cast("long").cast("string"), F.coalesce("_m.sessionId", F.lit("")))
    return rows.withColumn(value, F.concat_ws("|", F.lit("flash"), *parts)).drop("_m")


def decode(markers: DataFrame, session: str | None = None, value: str = "value") -> DataFrame:
    """trial, flash_ms, session of marker strings; an empty session passes."""
    part = lambda k: F.get(F.split(value, r"\|"), F.lit(k))
    rows = markers.where(part(0) == "flash").select("*", F.coalesce(part(1), F.lit("?")).alias("trial"), F.coalesce(safe_double(part(2)), F.lit(0.0)).alias("flash_ms"), F.coalesce(part(3), F.lit("")).alias("session"))
    return rows if session is None else rows.where((F.col("session") == session) | (F.col("session") == ""))


def received_ms(stamp: Column, now: Column, local_clock: Column) -> Column:
    """A stamp of the stream's clock (seconds) as the receiver's epoch time in
    milliseconds, cut toward zero. now and local_clock are both read at receipt."""
    return ((stamp + (now - local_clock)) * 1000).cast("long")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").load(sf_dir, format="parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def pace(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Samples and their sum per user and tumbling window, late rows dropped."""
    w = F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")


def sliding_mean(stream: DataFrame, width: str = "2 days", step: str = "12 hours", late: str = "1 hour") -> DataFrame:
    w = F.window("ts", width, step)
    return stream.withWatermark("ts", late).groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).select("event_type", F.col("w.start").alias("start"), "n", "mean")


def _episodes(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Runs of error events of one user; an open run lives in the state."""
    start, n = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches)).sort_values(["ms", "event_id"])
    out = []
    for kind, ms in zip(rows.event_type, rows.ms, strict=True):
        if kind == "error":
            start, n = (ms if n == 0 else start), n + 1
        elif n:
            out.append((key[0], start, ms - start, n))
            start, n = None, 0
    state.update((start if start is not None else -1, n))
    yield pd.DataFrame(out, columns=["user_id", "start", "duration", "n"])


def blink_episodes(stream: DataFrame) -> DataFrame:
    """Closed runs of error events per user: the streaming twin of the batch
    islands. Rows of one micro-batch are put in time order; a later batch is
    taken to be later in time."""
    rows = stream.select("user_id", "event_id", "event_type", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("user_id").applyInPandasWithState(_episodes, "user_id long, start long, duration long, n long", "start long, n long", "append", "NoTimeout")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a table, with its checkpoint in
    the shared folder, and read the table."""
    spark = stream.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="stream-")
    root = root.rstrip("/")
    path = f"{root}/stream-{uuid.uuid4().hex}"
    if mode == "complete":
        stream = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")).outputMode("complete")
    else:
        stream = stream.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append")
    q = stream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")
