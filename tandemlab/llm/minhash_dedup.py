"""Near-duplicate components by MinHash: universal hash minima, banding,
signature verification, exact confirmation on full shingle sets, and connected
components by alternating large-star and small-star.

With 40 bands of 6 minima a pair of Jaccard similarity 0.8 misses all bands
with probability (1 - 0.8^6)^40 = 5e-6; the signature check (see AGREE) drops
such a pair with probability under 1e-8. Both are made for similarities of 0.8
and more: lower thresholds are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandemlab.llm.common import WORD, WordTable, batches_by_bytes, cut, doc_key, forget, packed, run_hashes, settled, word_memory

BANDS, ROWS = 40, 6
#: A candidate goes on to the full sets if this share of its minima agree; at a
#: similarity of 0.8, 240 minima agree less often than this six deviations out.
AGREE = 0.64
#: The least threshold that the bands and the signature check are made for.
LEAST_PERCENT = 80
#: Queries and targets of a bucket that meet in one task, of each at most about so many.
BLOCK = 512


def universal_hashes(n: int = BANDS * ROWS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """n multiply-add hash functions of 64-bit keys: x -> a x + b, a odd."""
    made = np.random.default_rng(seed).integers(0, 1 << 63, size=(2, n), dtype=np.uint64)
    return made[0] * np.uint64(2) + np.uint64(1), made[1]


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter sequence is one
    shingle, an empty one has none."""
    return np.unique(run_hashes(words, min(size, len(words)))) if len(words) else np.zeros(0, np.uint64)


def minima(shingles: np.ndarray, hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The 32 high bits of each function's least value."""
    a, b = hashes
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at : at + 512, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _features(size: int, which: str):
    """doc_id, digest of the word sequence (null without words), n_shingles, and
    by `which` the minima, or the whole set, or neither."""
    hashes = universal_hashes()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_memory()
        for batch in batches:
            for part in batches_by_bytes(batch, "text"):
                table = WordTable(part.column("text"), lower=True)
                words, data = table.hashes(), table.data.tobytes()
                digests, counts, extra = [], [], []
                for d in range(part.num_rows):
                    own = words[table.first[d] : table.first[d + 1]]
                    shingles = shingle_set(own, size)
                    sequence = b" ".join(data[table.offsets[d] : table.offsets[d + 1]].split())
                    digests.append(hashlib.blake2b(sequence, digest_size=16).digest() if len(own) else None)
                    counts.append(len(shingles))
                    if which == "minima":
                        extra.append(minima(shingles, hashes).tobytes() if len(own) else None)
                    elif which == "set":
                        extra.append(shingles.tobytes())
                columns = [part.column("doc_id"), pa.array(digests, pa.binary()), pa.array(counts, pa.int64())]
                if which:
                    columns.append(pa.array(extra, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n_shingles", "data"][: len(columns)])

    return made


def features(docs: DataFrame, size: int, which: str = "") -> DataFrame:
    schema = "doc_id long, digest binary, n_shingles long" + (", data binary" if which else "")
    return docs.mapInArrow(_features(size, which), schema)


def _agreeing(left: pa.Array, right: pa.Array) -> pa.Array:
    """Share of equal minima."""
    return pa.array([float(np.mean(np.frombuffer(a.as_py(), np.uint8) == np.frombuffer(b.as_py(), np.uint8))) for a, b in zip(left, right, strict=True)], pa.float64())


def _confirmed(percent: int):
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        """100 * intersection >= percent * union, on whole sets."""
        out = []
        for a, b in zip(left, right, strict=True):
            x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
            both = 0
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return linked


def _short_signature(column: pa.Array) -> pa.Array:
    """The low byte of each minimum."""
    return pa.array([np.frombuffer(x.as_py(), np.uint32).astype(np.uint8).tobytes() for x in column], pa.binary())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long). Returns (node, root): root is the least node of the
    connected component of each node of any edge.

    Alternates large-star (larger neighbours link to the least neighbour) and
    small-star (smaller neighbours and the node do) until the edges stay as
    they are: rounds grow with the logarithm of the size. Minima are partial
    sums and the star of a hot node is joined as rows, never gathered."""

    def least(directed: DataFrame) -> DataFrame:
        return directed.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))

    def mark(now: DataFrame):
        return now.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def stars(now: DataFrame) -> DataFrame:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large-star: every neighbour above a links to the least of a and its neighbours
        mins = cut(least(both), "stars")
        large = both.where("b > a").join(mins, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large, "large-star")
        # small-star: edges point down already; a and its smaller neighbours link to the least of them
        mins = cut(large.groupBy("a").agg(F.min("b").alias("m")), "stars")
        small = large.join(mins, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        return small.unionAll(mins.select("a", F.col("m").alias("b"))).distinct()

    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = mark(now)
    while True:
        spent, now = now, settled(lambda at=now: stars(at), "small-star")
        forget(spent)
        after = mark(now)
        if after == before:
            roots = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots.select("node", F.col("node").alias("root")))
        before = after


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, digest, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set
    holds its distinct word shingles. Documents link when 100 * |intersection|
    >= percent * |union|; component_id is the least doc_id reachable. Documents
    without words link with nothing. A null doc_id names no component: it is
    null where no linked row has an id. Rows may share an id; they are then
    linked by their texts alone. Empty input gives no rows.

    Documents with one word sequence are one node (they are never expanded into
    pairs). Round 1 checks each node against one node, the least one of the band
    buckets they share most; the links give components. Round 2 checks what is
    still open: nodes in one bucket but different components, where the nodes
    outside a bucket's largest component meet the others. Links inside a
    component need no check, so none between components is lost.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"the bands would miss pairs below {LEAST_PERCENT} percent")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    nodes = features(source, shingle, "minima").where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("data").alias("minima"))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("short", F.arrow_udf(_short_signature, "binary")("minima"))
    nodes = cut(nodes, "nodes")

    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("minima", k * ROWS * 4 + 1, F.lit(ROWS * 4))))
    members = nodes.select("node", F.explode(bands).alias("bucket"))
    shared = cut(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "buckets")
    members = cut(members.join(shared, "bucket"), "members")
    # the centre of a group shares most buckets with most others: it is the pivot
    weight = members.groupBy("node").agg(F.sum("_n").alias("_weight"))
    pivots = members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct(F.col("_weight"), (-F.col("node")).alias("node"))).alias("_top"))
    pivots = cut(pivots.select("bucket", (-F.col("_top.node")).alias("pivot")), "pivots")

    # round 1: one pivot for each node
    votes = members.join(pivots, "bucket").where("node <> pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("_n"))
    first = votes.groupBy("node").agg(F.max(F.struct(F.col("_n"), (-F.col("pivot")).alias("pivot"))).alias("_best"))
    pairs = first.select(F.col("node").alias("a"), (-F.col("_best.pivot")).alias("b"))
    sets = _sets(source, nodes, members.select("node").distinct(), shingle)
    links = _linked(pairs, nodes, sets, percent)
    roots = cut(components(links), "components")

    # round 2: bucket mates that are not yet in one component
    rooted = cut(members.drop("_n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    parts = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("_n"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("_n", "root")).alias("_top"), F.count(F.lit(1)).alias("_parts"), F.sum("_n").alias("_all")).where("_parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK)
    mixed = mixed.select("bucket", F.col("_top.root").alias("body"), blocks(F.col("_all")).alias("_rows"), blocks(F.col("_all") - F.col("_top._n")).alias("_cols"))
    mixed = cut(mixed, "mixed-buckets")
    crossing = _crossing(rooted.join(mixed, "bucket"), sets, percent)
    more = _linked(cut(crossing.distinct(), "crossing"), nodes, sets, percent)
    if not more.isEmpty():
        roots = cut(components(links.unionAll(more)), "components")

    ids = nodes.select("digest", "doc_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = cut(ids.groupBy("root").agg(F.min("doc_id").alias("component_id")), "component-ids")
    named = cut(ids.join(least, "root").select(F.col("digest").alias("_digest"), "component_id"), "named")
    every = features(source, shingle)
    joined = every.join(named, every.digest == named._digest, "left")
    return joined.select("doc_id", "digest", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _sets(source: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, data): the whole shingle sets of the wanted nodes, from one
    document of each."""
    named = cut(nodes.join(wanted, "node").select("node", F.col("digest").alias("_digest"), F.col("doc_id").alias("_id")), "wanted-nodes")
    rows = source.join(named.select("_id").distinct().hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    found = features(rows, shingle, "set")
    found = found.join(named, F.col("digest") == F.col("_digest")).groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("data").alias("data"))
    return cut(found.withColumn("sketch", F.arrow_udf(_sketch, "binary")("data")), "sets")


def _sketch(column: pa.Array) -> pa.Array:
    """A bitmap of each set, of eight bits a member or more: a power of two, so
    that a longer one can be folded onto a shorter."""
    out = []
    for value in column:
        members = np.frombuffer(value.as_py(), np.uint64)
        bits = np.zeros(max(2048, 1 << (8 * len(members) - 1).bit_length()), bool)
        bits[(members & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return pa.array(out, pa.binary())


def _crossing(open_rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): mates of one bucket in different components whose similarity may
    reach the threshold. The nodes outside a bucket's largest component are its
    queries, and all its nodes are targets. Both are dealt into blocks of about
    BLOCK; each block of targets meets each block of queries in a task of its
    own, and only pairs that pass an exact bound leave it."""
    rows = open_rows.join(sets.select("node", "n", "sketch"), "node")
    dealt = lambda count, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    own = ("node", "root", "n", "sketch")
    targets = rows.select("bucket", dealt("_rows", 1).alias("row"), every("_cols").alias("col"), F.lit(1).alias("role"), *own)
    queries = rows.where("root <> body").select("bucket", every("_rows").alias("row"), dealt("_cols", 2).alias("col"), F.lit(0).alias("role"), *own)
    cell = ("bucket", "row", "col")
    met = targets.unionAll(queries).repartition(*cell).sortWithinPartitions(*cell)
    return met.mapInArrow(_meet(percent), "a long, b long")


def _meet(percent: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_memory()
        current, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "row", "col", "role", "node", "root", "n", "sketch")]
            for bucket, at, to, *row in zip(*columns, strict=True):
                if (bucket, at, to) != current:
                    yield from _pairs(rows, percent)
                    current, rows = (bucket, at, to), []
                rows.append(row)
        yield from _pairs(rows, percent)

    return meet


def _pairs(rows: list, percent: int) -> Iterator[pa.RecordBatch]:
    """Queries (role 0) against targets (role 1). The bits in which two bitmaps
    differ are at most the members in which the sets differ, which at the
    threshold are (100 - percent) / (100 + percent) of their summed sizes."""
    queries, targets = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
    if not queries or not targets:
        return
    node, root, n = (np.array([r[k] for r in targets], np.int64) for k in (1, 2, 3))
    widths = np.array([len(r[4]) for r in targets])
    held = {w: (at := np.flatnonzero(widths == w), np.frombuffer(b"".join(targets[k][4] for k in at), np.uint64).reshape(len(at), -1)) for w in np.unique(widths)}
    left, right = [], []
    for _, own, own_root, size, sketch in queries:
        mine = np.frombuffer(sketch, np.uint64)
        for at, matrix in held.values():
            width = min(matrix.shape[1], len(mine))
            apart = np.bitwise_count(_folded(matrix, width) ^ _folded(mine[None], width)).sum(axis=1, dtype=np.int64)
            near = at[(apart * (100 + percent) <= (n[at] + size) * (100 - percent)) & (root[at] != own_root)]
            left += [own] * len(near)
            right += node[near].tolist()
    if left:
        a, b = np.array(left, np.int64), np.array(right, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _folded(bitmaps: np.ndarray, width: int) -> np.ndarray:
    while bitmaps.shape[1] > width:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] | bitmaps[:, half:]
    return bitmaps


def _linked(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the signature check and the full sets."""
    short = nodes.select("node", "short")
    near = _beside(pairs, short, "short").where(F.arrow_udf(_agreeing, "double")("short_a", "short_b") >= AGREE).select("a", "b")
    near = cut(near, "near-pairs")
    full = _beside(near, sets, "data")
    return cut(full.where(F.arrow_udf(_confirmed(percent), "boolean")("data_a", "data_b")).select("a", "b"), "links")


def _beside(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("node").alias(side), F.col(value).alias(f"{value}_{side}")), side)
    return pairs


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose id names their component, columns unchanged; of
    rows equal in id and words one stays. Documents without words all stay."""
    found = near_duplicates(docs, id_col, text_col, shingle, percent).where("doc_id <=> component_id and digest is not null")
    kept = found.select(doc_key("doc_id", F.hex("digest")).alias("_key")).distinct()

    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            joined = (b" ".join((text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()) for text in column)
            yield pa.array([hashlib.blake2b(x, digest_size=16).digest() if x else None for x in joined], pa.binary())

    rows = packed(docs)
    has_words = F.coalesce(F.col(f"_row.{text_col}").cast("string").rlike(WORD), F.lit(False))
    digests = F.arrow_udf(digest, "binary")(F.col(f"_row.{text_col}").cast("string"))
    keyed = rows.where(has_words).withColumn("_digest", digests).select("_row", doc_key(f"_row.{id_col}", F.hex("_digest")).alias("_key"))
    first = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(1)))
    one = keyed.join(kept.hint("merge"), "_key", "left_semi").withColumn("_nth", first).where("_nth = 1").select("_row")
    return one.unionAll(rows.where(~has_words)).select("_row.*")
