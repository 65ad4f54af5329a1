"""Helpers shared by the training-data operators: cuts in the lineage, word
tables over Arrow buffers, and row numbering that repeated rows cannot skew."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these bytes.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = b" \t\n\x0b\x0c\r"

_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. A session that runs on this
    machine alone may leave it unset: it then gets a temporary folder. On a
    cluster an unset folder is an error, as executors share no local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tandemlab-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session is gone: its owner clears the folder
            return


atexit.register(_sweep)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, removed when the driver exits."""
    path = f"{scratch_dir(spark)}/tandemlab/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared scratch folder and read it
    back: lineage ends there, lost executors cost nothing before it, and the
    planner knows its size. The tables are removed when the driver exits, or by
    forget()."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tandemlab_path = path
    return out


def forget(df: DataFrame) -> None:
    """Remove the table of a frame that cut() made, when nothing will read it again."""
    entry = (df.sparkSession, df._tandemlab_path)
    if entry in _written:
        _written.remove(entry)
        _remove(*entry)


def settled(stage: Callable[[], DataFrame], label: str) -> DataFrame:
    """cut(stage(), label); the tables that the stage itself has cut go, now
    that nothing will read them again."""
    before = len(_written)
    out = cut(stage(), label)
    gone, _written[before:-1] = _written[before:-1], []
    for spark, path in gone:
        _remove(spark, path)
    return out


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    store = sys.modules.setdefault("_tandemlab_worker", types.ModuleType("_tandemlab_worker"))
    return store.__dict__.setdefault(name, {})


def word_memory(name: str | None = None) -> dict:
    """The worker's memory of words under this name. There is one at a time: a
    task that asks for another, or for none, frees it, as workers are used again
    by later stages that need the room."""
    store = worker_cache("words")
    for other in [k for k in store if k != name]:
        del store[other]
    return store.setdefault(name, {}) if name else {}


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def doc_key(id_col: str, *more: Column) -> Column:
    """A string that is never null and tells apart ids and the values of more."""
    parts = [F.coalesce(F.col(id_col).cast("string"), F.lit("null"))]
    for value in more:
        parts.append(F.coalesce(F.concat(F.lit(":="), value.cast("string")), F.lit(":")))
    return F.concat(*parts)


def packed(docs: DataFrame) -> DataFrame:
    """docs as one struct column `_row`: working columns beside it can't clash
    with its own. Undone by select("_row.*")."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to be none of df's columns."""
    while name.lower() in map(str.lower, df.columns):
        name = f"_{name}"
    return name


def numbered_copies(df: DataFrame, keys: list[str], chunk: int = 1024) -> DataFrame:
    """One row per row of df with its keys and `copy`, 0.. among rows equal in
    all keys. Rows are counted, not gathered, so a row repeated any number of
    times is no hot group; long runs of copies are dealt out in chunks."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / chunk).cast("long"))))
    first = F.col("_chunk") * chunk
    last = F.least(first + chunk, F.col("_n")) - 1
    return chunks.select(*keys, F.explode(F.sequence(first, last)).alias("copy"))


def batches_by_bytes(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about `most` bytes of text each (a longer
    text comes alone)."""
    if not batch.num_rows:
        return
    ends = np.asarray(text_offsets(batch.column(text)))[1:]
    at, base = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at, base = to, int(ends[to - 1])


def text_offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string column's values from its first, nulls empty."""
    sizes = np.zeros(len(column) + 1, np.int64)
    lengths = pa.compute.binary_length(column).fill_null(0)
    np.cumsum(np.asarray(lengths, dtype=np.int64), out=sizes[1:])
    return sizes


_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WHITE)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordTable:
    """The words of a string column as arrays: `data` holds the UTF-8 bytes of
    all values, word i is data[starts[i]:ends[i]], and value d has the words
    first[d] to first[d + 1]."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if not pa.types.is_large_binary(column.type):
            column = column.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.offsets = offsets = offsets - offsets[0]
        self.data = data = _LOWER[data] if lower else data
        word = _IS_WORD[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        before[inner], after[inner - 1] = False, False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        n, lengths = len(self.data), self.ends - self.starts
        inside = _IS_WORD[self.data]
        base = np.zeros(n, np.int64)
        base[self.starts] = self.starts
        place = np.arange(n) - np.maximum.accumulate(base)
        powers = np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        value = np.zeros(n, np.uint64)
        value[inside] = (self.data[inside].astype(np.uint64) + np.uint64(1)) * powers[place[inside]]
        return mix(np.add.reduceat(value, self.starts) + lengths.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of x over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive word hashes."""
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix(out)
