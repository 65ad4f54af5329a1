"""Removal of repeated 50-word passages by super-k-mer partitioning.

Words hash to 64 bits, and the minimiser of a window is the least hash of the
8-word runs in it, so equal windows have equal minimisers. Consecutive windows
with one minimiser travel as one packed string (their words, at most LONGEST
windows) to the bucket of that minimiser, where the windows themselves are
sorted and compared byte by byte. Minimisers of only one document are dropped
first: a window that occurs in two documents gives its minimiser to both.

Equal packed strings are one string with the least document that holds it, so
copies of a document fill no bucket. A bucket of more than BUCKET different
strings is split by the minimisers of longer runs (RUNS), which fewer strings
share: its strings are cut into shorter ones and dealt anew. The longest run is
the window itself, whose buckets hold one string each.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemlab.llm.common import WordTable, batches_by_bytes, cut, doc_key, forget, run_hashes

WINDOW = 50
#: Words of the runs whose least hash is the minimiser: at first, and in buckets that are too full.
RUNS = (8, 32, 44, WINDOW)
#: Windows of one packed string at most (113 words); longer runs of one
#: minimiser are cut, with 49 words in both parts.
LONGEST = 64
#: Different strings of a bucket that are sorted at once: with LONGEST, at most
#: 65,536 windows.
BUCKET = 1024


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def super_kmers(words: np.ndarray, window: int = WINDOW, run: int = RUNS[0], longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(first window of each super-k-mer, its minimiser) for one document's
    word hashes; the number of windows closes the first array."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint64)
    least = sliding_min(run_hashes(words, run), window - run + 1)
    place = np.arange(n)
    changes = np.concatenate([[True], least[1:] != least[:-1]])
    since = place - np.maximum.accumulate(np.where(changes, place, 0))
    starts = np.flatnonzero(since % longest == 0)
    return np.append(starts, n), least[starts]


def _tables(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for part in batches_by_bytes(batch, "text"):
            table = WordTable(part.column("text"))
            yield part, table, table.hashes()


def _minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, table, hashes in _tables(batches):
        rows, found = [], []
        for d in range(part.num_rows):
            _, least = super_kmers(hashes[table.first[d] : table.first[d + 1]])
            if len(least):
                least = np.unique(least).view(np.int64)
                rows.append(np.full(len(least), d))
                found.append(least)
        if rows:
            which = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found)), part.column("key").take(which), part.column("rank").take(which)], ["mini", "key", "rank"]
            )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The super-k-mers of the minimisers in the column wanted, as packed strings."""
    for part, table, hashes in _tables(batches):
        mini, key, start, windows, text = [], [], [], [], []
        data = table.data.tobytes()
        for d in range(part.num_rows):
            first, last = table.first[d], table.first[d + 1]
            starts, least = super_kmers(hashes[first:last])
            least = least.view(np.int64)
            for k in np.flatnonzero(np.isin(least, np.asarray(part.column("wanted")[d].values, np.int64))):
                a, b = int(starts[k]), int(starts[k + 1])
                places = slice(first + a, first + b + WINDOW - 1)
                mini.append(int(least[k]))
                key.append(d)
                start.append(a)
                windows.append(b - a)
                text.append(b" ".join([data[s:e] for s, e in zip(table.starts[places].tolist(), table.ends[places].tolist(), strict=True)]))
        if mini:
            which = pa.array(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(mini, pa.int64()), part.column("key").take(which), part.column("rank").take(which), pa.array(start, pa.int64()), pa.array(windows, pa.int64()), pa.array(text, pa.binary())],
                ["mini", "key", "rank", "start", "windows", "packed"],
            )


def windows_of(packed: bytes) -> list[bytes]:
    """The windows of a packed string, in order."""
    ends = [-1] + [k for k, byte in enumerate(packed) if byte == 32] + [len(packed)]
    return [packed[ends[w] + 1 : ends[w + WINDOW]] for w in range(len(ends) - WINDOW)]


def repeats_in_bucket(strings: list[tuple[bytes, int, int]]) -> list[tuple[int, int, int]]:
    """strings: (packed words, least rank, sid), all different. Returns (sid,
    first, end) of runs of windows that a string of smaller rank holds too."""
    windows = [(window, rank, sid, w) for packed, rank, sid in strings for w, window in enumerate(windows_of(packed))]
    windows.sort(key=lambda x: x[:2])
    before, owner, found = None, 0, defaultdict(list)
    for window, rank, sid, w in windows:
        if window != before:
            before, owner = window, rank
        if owner < rank:
            found[sid].append(w)
    return [(sid, a, b) for sid, at in found.items() for a, b in _runs(sorted(at))]


def _runs(sorted_places: list[int]) -> Iterator[tuple[int, int]]:
    first = last = None
    for place in sorted_places:
        if last is not None and place <= last + 1:
            last = place
            continue
        if last is not None:
            yield first, last + 1
        first = last = place
    if last is not None:
        yield first, last + 1


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches are sorted by minimiser; a bucket is held only while it lasts."""
    current, strings, ready = None, [], []

    def record():
        columns = [pa.array(c, pa.int64()) for c in zip(*ready, strict=True)]
        ready.clear()
        return pa.RecordBatch.from_arrays(columns, ["sid", "first", "end"])

    for batch in batches:
        for mini, *row in zip(*(batch.column(c).to_pylist() for c in ("mini", "packed", "least", "sid")), strict=True):
            if mini != current:
                ready += repeats_in_bucket(strings)
                current, strings = mini, []
                if len(ready) > 5000:
                    yield record()
            strings.append(tuple(row))
    ready += repeats_in_bucket(strings)
    if ready:
        yield record()


def _cut_by(run: int):
    """Packed strings cut where the minimiser of `run` words changes."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                table = WordTable(part.column("packed").cast(pa.large_binary()))
                hashes, data = table.hashes(), table.data.tobytes()
                mini, which, start, windows, text = [], [], [], [], []
                for d in range(part.num_rows):
                    first, last = table.first[d], table.first[d + 1]
                    starts, least = super_kmers(hashes[first:last], run=run)
                    for k, (a, b) in enumerate(zip(starts.tolist(), starts[1:].tolist(), strict=False)):
                        mini.append(int(least[k].view(np.int64)))
                        which.append(d)
                        start.append(a)
                        windows.append(b - a)
                        # words of a packed string stand one space apart
                        text.append(data[table.starts[first + a] : table.ends[first + b + WINDOW - 2]])
                index = pa.array(which, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mini, pa.int64()), part.column("sid").take(index), part.column("least").take(index), pa.array(start, pa.int64()), pa.array(windows, pa.int64()), pa.array(text, pa.binary())],
                    ["mini", "key", "rank", "start", "windows", "packed"],
                )

    return pieces


def kept_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    """Words not covered by the windows first..end-1 of any span."""
    out, at = [], 0
    for first, end in sorted(spans):
        if first > at:
            out += words[at:first]
        at = max(at, end + WINDOW - 1)
    return out + words[at:]


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, kept, texts = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            flat = np.frombuffer(spans.as_py() or b"", np.int64).tolist()
            left = kept_words(words, list(zip(flat[::2], flat[1::2], strict=True)))
            counts.append(len(words))
            kept.append(len(left))
            texts.append(b" ".join(left).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(kept, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_kept", "kept_text"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(key, first, end): windows first..end-1 of the rows with that doc_key
    (id and text) whose words also start in a document of smaller id."""
    rows = keyed(docs, id_col, text_col)
    seen = cut(rows.mapInArrow(_minimisers, "mini long, key string, rank long"), "minimisers")
    shared = seen.groupBy("mini").agg(F.min("rank").alias("_a"), F.max("rank").alias("_b")).where("_a < _b").select("mini")
    wanted = cut(seen.join(cut(shared, "shared-minimisers"), "mini").groupBy("key").agg(F.collect_set("mini").alias("wanted")), "wanted-minimisers")
    forget(seen)
    packed = rows.join(wanted.hint("merge"), "key").mapInArrow(_packed, "mini long, key string, rank long, start long, windows long, packed binary")
    return _repeats(cut(packed, "super-kmers"), bucket, RUNS[1:])


def _repeats(packed: DataFrame, bucket: int, runs: tuple[int, ...]) -> DataFrame:
    """packed: a cut table (mini, key, rank, start, windows, packed). Returns
    (key, first, end), the windows of each key that a smaller rank holds too.

    A row above the least rank of its packed string repeats all of it. Only the
    row of least rank itself has to know which windows come in other strings."""
    # every different string once, by its bytes
    strings = packed.groupBy("mini", "packed").agg(F.min("rank").alias("least")).withColumn("sid", F.monotonically_increasing_id())
    strings = cut(strings, "strings")
    held = packed.join(strings.hint("merge"), ["mini", "packed"]).select("key", "rank", "start", "windows", "sid", "least")
    held = cut(held, "held-strings")
    forget(packed)

    # strings that meet others of another rank
    sizes = strings.groupBy("mini").agg(F.count(F.lit(1)).alias("_n"), F.min("least").alias("_a"), F.max("least").alias("_b")).where("_a < _b").select("mini", "_n")
    met = cut(strings.join(cut(sizes, "bucket-sizes"), "mini"), "bucket-strings")
    forget(strings)
    full = met.where(F.col("_n") > bucket)
    split = bool(runs) and not full.isEmpty()
    dealt = (met.where(F.col("_n") <= bucket) if split else met).select("mini", "packed", "least", "sid").repartition("mini").sortWithinPartitions("mini")
    found = dealt.mapInArrow(_buckets, "sid long, first long, end long")
    if split:
        shorter = full.select("packed", "least", "sid").mapInArrow(_cut_by(runs[0]), "mini long, key long, rank long, start long, windows long, packed binary")
        found = found.unionAll(_repeats(cut(shorter, "shorter-strings"), bucket, runs[1:]).withColumnRenamed("key", "sid"))
    found = cut(found, "repeats")

    whole = held.where("rank > least").select("key", F.col("start").alias("first"), (F.col("start") + F.col("windows")).alias("end"))
    part = held.where("rank = least").select("key", "start", "sid").join(found, "sid")
    return whole.unionAll(part.select("key", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("end")).alias("end")))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, rank, text. Null ids rank above every other."""
    text = F.col(text_col).cast("string")
    ident = F.col(id_col).cast("long")
    return docs.select(doc_key(id_col, F.xxhash64(text)).alias("key"), F.coalesce(ident, F.lit((1 << 63) - 1)).alias("rank"), ident.alias("doc_id"), text.alias("text"))


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_kept, kept_text (the words
    left, joined by one space).

    A word goes if some window of 50 words that covers it also starts in a row
    with a smaller id; windows are those of the input. Rows that share an id
    are never compared with each other; a null id is larger than any other.
    Null and empty texts have no words; texts under 50 words stay whole. Other
    columns of docs are not read.
    """
    spans = repeated_spans(docs, id_col, text_col, bucket)
    pairs = spans.distinct().groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("_s"))
    packer = F.arrow_udf(_pack_spans, "binary")
    pairs = cut(pairs.select("key", packer(F.flatten(F.transform("_s", lambda s: F.array(s["first"], s["end"])))).alias("spans")), "spans")
    rows = keyed(docs, id_col, text_col).join(pairs.hint("merge"), "key", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_stripped, "doc_id long, n_words long, n_kept long, kept_text string")


def _pack_spans(column: pa.Array) -> pa.Array:
    return pa.array([struct.pack(f"<{len(x)}q", *x.as_py()) for x in column], pa.binary())
