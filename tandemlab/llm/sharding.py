"""Sharding over fixed virtual slots.

A record's slot is a hash of its identity and never changes. A versioned map
says which shard owns each slot; rebalancing edits that map, so that only the
records of moved slots move. Everything that touches records is DataFrame
code; the driver sees one row per slot (`n_slots`, a fixed parameter).
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandemlab.llm.common import cut, free_name, numbered_copies, packed, text_or_empty

N_SLOTS = 4096
MAP_SCHEMA = "version int, n_shards int, virtual_slot int, shard int, slot_bytes long, slot_rows long"


@dataclass(frozen=True)
class SlotMap:
    """owner[v] is the shard of virtual slot v; bytes and rows are those the
    slot held when this version was made."""

    version: int
    n_shards: int
    owner: list[int]
    bytes: list[int] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.owner):
            out[shard] += self.bytes[slot]
        return out


def initial_map(n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """Version 1: slots dealt round robin."""
    return SlotMap(1, n_shards, [v % n_shards for v in range(n_slots)], [0] * n_slots, [0] * n_slots)


def rebalance(old: SlotMap, slot_bytes: list[int], slot_rows: list[int]) -> SlotMap:
    """The next version. While it narrows the gap between the fullest and the
    emptiest shard, one slot moves between them, or two slots change places:
    the pair whose difference is nearest to half the gap."""
    owner = list(old.owner)
    held = [sorted((slot_bytes[v], v) for v in range(len(owner)) if owner[v] == s) for s in range(old.n_shards)]
    loads = [sum(b for b, _ in h) for h in held]
    while True:
        high = max(range(old.n_shards), key=lambda s: (loads[s], -s))
        low = min(range(old.n_shards), key=lambda s: (loads[s], s))
        gap, best = loads[high] - loads[low], None
        for back in [(0, -1), *held[low]]:
            at = bisect.bisect_left(held[high], (back[0] + gap / 2, -1))
            for give in held[high][max(0, at - 1) : at + 1]:
                if 0 < (step := give[0] - back[0]) < gap and (best is None or abs(gap - 2 * step) < best[0]):
                    best = (abs(gap - 2 * step), give, back)
        if best is None:
            return SlotMap(old.version + 1, old.n_shards, owner, list(slot_bytes), list(slot_rows))
        for entry, source, target in ((best[1], high, low), (best[2], low, high)):
            if entry[1] >= 0:
                held[source].remove(entry)
                bisect.insort(held[target], entry)
                owner[entry[1]] = target
                loads[source] -= entry[0]
                loads[target] += entry[0]


def grow(old: SlotMap) -> SlotMap:
    """The next version with one more shard, which takes slots from the fullest
    shards until it holds its share; no slot moves between older shards."""
    owner, loads, new = list(old.owner), [*old.loads(), 0], old.n_shards
    share = sum(loads) / (new + 1)
    held = [sorted(((old.bytes[v], v) for v in range(len(owner)) if owner[v] == s)) for s in range(new)]
    while True:
        high = max(range(new), key=lambda s: (loads[s], -s))
        fit = bisect.bisect_right(held[high], (share - loads[new], len(owner)))
        if not fit or not held[high][fit - 1][0] or loads[high] <= share:
            return SlotMap(old.version + 1, new + 1, owner, old.bytes, old.rows)
        size, slot = held[high].pop(fit - 1)
        owner[slot], loads[new], loads[high] = new, loads[new] + size, loads[high] - size


def map_frame(spark: SparkSession, slot_map: SlotMap) -> DataFrame:
    rows = [(slot_map.version, slot_map.n_shards, v, s, slot_map.bytes[v], slot_map.rows[v]) for v, s in enumerate(slot_map.owner)]
    return spark.createDataFrame(rows, MAP_SCHEMA)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def store_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Append a version to the map table at path; older versions stay readable
    and are never written again. One writer at a time."""
    if _exists(spark, f"{path}/version={slot_map.version}"):
        raise ValueError(f"version {slot_map.version} of the slot map is there already")
    map_frame(spark, slot_map).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the newest by default (n_slots rows come to the driver)."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    rows = sorted(table.where(F.col("version") == version).collect(), key=lambda r: r.virtual_slot)
    return SlotMap(version, rows[0].n_shards, [r.shard for r in rows], [r.slot_bytes for r in rows], [r.slot_rows for r in rows])


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, copy and virtual_slot of every row. Rows equal
    in id and text differ in `copy`, so that they spread over the slots. A null
    text has the size 8 and the checksum of no bytes; null ids are hashed by
    their text and copy."""
    text = text_or_empty(text_col)
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = numbered_copies(sized, ["doc_id", "size", "text_crc32"])
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(n_slots)).cast("int"))


def slot_totals(rows: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: at most n_slots rows reach the driver."""
    held, count = [0] * n_slots, [0] * n_slots
    for slot, size, n in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect():
        held[slot], count[slot] = size, n
    return held, count


def place(rows: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Adds shard, the row's gapless position `slot` in its shard, and the map's
    version. A position is the rows of the shard's earlier virtual slots (known
    from the map) plus the rank within the virtual slot, so no task ever sorts a
    whole shard."""
    before, ahead = [0] * slot_map.n_shards, []
    for v, shard in enumerate(slot_map.owner):
        ahead.append((v, shard, before[shard], slot_map.version))
        before[shard] += slot_map.rows[v]
    spark = rows.sparkSession
    table = spark.createDataFrame(ahead, "virtual_slot int, shard int, _ahead long, map_version int")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "copy"))
    ranked = rows.withColumn("_rank", rank.cast("long") - 1)
    # the table has n_slots rows of 20 bytes, a fixed size
    return ranked.join(F.broadcast(table), "virtual_slot").withColumn("slot", F.col("_ahead") + F.col("_rank")).drop("_ahead", "_rank")


def shard(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Deal every row of docs to a shard so that shard sizes are near equal.

    Starts from the newest map at map_path (else a fresh one), measures bytes
    per slot, edits the map and, with map_path, stores the new version and reads
    it back: that table says where every record is. Returns doc_id, size, text_crc32, copy, virtual_slot, shard, slot, map_version.
    Empty input gives no rows; other columns of docs are not read.
    """
    spark = docs.sparkSession
    rows = cut(slotted(docs, id_col, text_col, n_slots), "slots")
    if map_path and _exists(spark, map_path):
        old = load_map(spark, map_path)
        if old.n_shards != n_shards or len(old.owner) != n_slots:
            raise ValueError(f"the stored map has {old.n_shards} shards and {len(old.owner)} slots; grow() it first")
    else:
        old = initial_map(n_shards, n_slots)
        if map_path:
            store_map(spark, old, map_path)
    new = rebalance(old, *slot_totals(rows, n_slots))
    if map_path:
        store_map(spark, new, map_path)
        new = load_map(spark, map_path)
    return place(rows, new)


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write whole records, all columns, into path/shard=k, and return the name
    of that column, which is free_name(docs, "shard").

    placed: the rows of shard() on the same docs. A record finds its shard by id,
    text checksum and size. Records equal in these are numbered, by their place
    in the input and not in one task, and the k-th takes the place of copy k."""
    name = free_name(docs, "shard")
    text = text_or_empty(f"_row.{text_col}")
    size = (F.octet_length(text) + 8).cast("long")
    rows = packed(docs).select("_row", F.col(f"_row.{id_col}").cast("long").alias("_id"), F.crc32(text.cast("binary")).alias("_crc"), size.alias("_size"))
    keys = ["_id", "_crc", "_size"]
    to = placed.select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size"), "copy", F.col("shard").alias("_shard"))
    every = to.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_shard").alias("_shard"))
    single = _join(rows, every.where("_n = 1").drop("_n"), keys)

    # alike in all keys: counted by the part of the input they stand in, then numbered within it
    alike = _join(rows, every.where("_n > 1").select(*keys), keys).withColumn("_at", F.monotonically_increasing_id())
    alike = cut(alike.withColumn("_part", F.shiftright("_at", 33)), "alike-rows")
    parts = alike.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")).drop("_n")
    nth = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_at"))
    numbered = _join(alike.withColumn("_nth", nth), parts, [*keys, "_part"]).withColumn("copy", F.col("_before") + F.col("_nth") - 1)
    numbered = _join(numbered, to, [*keys, "copy"]).select("_row", "_shard")

    found = single.select("_row", "_shard").unionAll(numbered).select("_row.*", F.col("_shard").alias(name))
    found.write.partitionBy(name).parquet(path)
    return name


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null; both sides grow with the input."""
    right = right.select(*(F.col(k).alias(f"{k}_") if k in keys else k for k in right.columns))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    return left.join(right.hint("merge"), same).drop(*(f"{k}_" for k in keys))
