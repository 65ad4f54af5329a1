"""Packing token pieces into fixed sequences by shortest-pack-first over the
histogram of lengths."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandemlab.llm.common import batches_by_bytes, cut, numbered_copies, word_memory, worker_cache
from tandemlab.llm.token_counts import tokenizer

LENGTH = 1024
END_ID = 0
#: Pieces of one length are ranked in parts of about so many, so that no length is one task.
PART = 100_000
#: The worker's memory of encoded words: its bytes in all, and the longest word kept.
REMEMBERED, REMEMBERED_BYTES = 64 << 20, 64
#: Three white-space characters in a row, or two at the end or before what may be
#: a special token (which ends the text as the tokenizer sees it): a byte-level
#: tokenizer then looks beyond the place where the text would be cut.
_AWKWARD = re.compile(r"\s\s(?:\s|$|<)")
#: Words encoded in one call, and about the bytes of text that are in work at once.
TOGETHER, TEXT_BYTES = 256, 8 << 20


def encode_texts(encoder, memory: dict[str, pa.Array], texts: list[str]) -> list[bytes]:
    """The ids of each text as little-endian 32-bit words.

    Texts are cut before every space and line feed. A byte-level tokenizer
    starts a new word there, whatever stands around it, unless white space runs
    on (_AWKWARD; such texts are encoded whole). Each distinct word, with the
    space or line feed before it, is encoded once by the tokenizer. Words stay
    in Arrow arrays, those remembered from earlier texts too: it finds the
    distinct ones, looks them up, and lays out their ids in text order."""
    known_words, known_ids = memory.get("words", pa.array([], pa.string())), memory.get("ids", pa.array([], pa.large_binary()))
    whole = [_AWKWARD.search(text) is not None for text in texts]
    column = pa.array(["" if w else text for text, w in zip(texts, whole, strict=True)], pa.string())
    cuts = pa.compute.split_pattern(pa.compute.replace_substring(column, "\n", " \n"), " ")
    coded, first = cuts.values.dictionary_encode(), cuts.offsets.to_numpy()
    places = pa.compute.index_in(coded.dictionary, value_set=known_words).fill_null(-1).to_numpy().copy()
    missing = np.flatnonzero(places < 0)
    order, new_ids = _encode_words(encoder, coded.dictionary.take(pa.array(missing)))
    places[missing[order]] = len(known_words) + np.arange(len(missing))
    # nothing stands before a text's first word: it, or an awkward text, has ids of its own
    firsts = coded.dictionary.take(coded.indices.take(pa.array(first[:-1]))).to_pylist()
    heads = [text if w else word for text, w, word in zip(texts, whole, firsts, strict=True)]
    own = pa.array([array("I", got.ids).tobytes() for got in encoder.encode_batch_fast(heads, add_special_tokens=False)], pa.large_binary())
    codes = places[coded.indices.to_numpy()]
    codes[first[:-1]] = len(known_words) + len(missing) + np.arange(len(texts))
    laid = pa.concat_arrays([known_ids, new_ids, own]).take(pa.array(codes))
    bounds, raw = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1)[first].tolist(), laid.buffers()[2]
    new_words = coded.dictionary.take(pa.array(missing[order]))
    short = pa.compute.less_equal(pa.compute.binary_length(new_words), REMEMBERED_BYTES)
    memory["words"] = pa.concat_arrays([known_words, new_words.filter(short)])
    memory["ids"] = pa.concat_arrays([known_ids, new_ids.filter(short)])
    if memory["words"].nbytes + memory["ids"].nbytes > REMEMBERED:
        memory.clear()
    return [raw[a:b].to_pybytes() for a, b in zip(bounds, bounds[1:], strict=False)]


def _encode_words(encoder, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(order, the ids of the words in that order). Words that begin with one
    space or line feed and hold no other at either end are encoded many in a
    call, and their ids told apart by the only tokens that begin with that
    character; the others one by one."""
    broken = pa.compute.starts_with(words, "\n")
    body = pa.compute.utf8_slice_codeunits(words, 1)
    body = pa.compute.if_else(broken, body, words)
    plain = pa.compute.and_(pa.compute.equal(pa.compute.utf8_trim_whitespace(body), body), pa.compute.not_equal(body, ""))
    plain, broken = plain.to_numpy(zero_copy_only=False), broken.to_numpy(zero_copy_only=False)
    groups = {" ": np.flatnonzero(plain & ~broken), "\n": np.flatnonzero(plain & broken)}
    others = np.flatnonzero(~plain)
    found = []
    for mark, which in groups.items():
        for at in range(0, len(which), TOGETHER):
            part = words.take(pa.array(which[at : at + TOGETHER])).to_pylist()
            text = "".join(part) if mark == "\n" else " " + " ".join(part)
            ids = np.array(encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(_marks(encoder)[mark][ids])
            if len(starts) != len(part):
                raise ValueError(f"the tokenizer doesn't start words at {mark!r}")
            bounds = np.append(starts, len(ids)) * 4
            found.append(pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(bounds), pa.py_buffer(ids)]))
    single = [word if word[:1] == "\n" else " " + word for word in words.take(pa.array(others)).to_pylist()]
    found.append(pa.array([array("I", encoder.encode(text, add_special_tokens=False).ids).tobytes() for text in single], pa.large_binary()))
    return np.concatenate([*groups.values(), others]), pa.concat_arrays(found)


def _marks(encoder) -> dict[str, np.ndarray]:
    """Per mark, which ids begin with it (their byte-level letters)."""
    made = worker_cache("marks")
    if id(encoder) not in made:
        vocabulary = encoder.get_vocab()
        found = {mark: np.zeros(max(vocabulary.values()) + 1, bool) for mark in (" ", "\n")}
        for piece, k in vocabulary.items():
            for mark, letter in ((" ", "\u0120"), ("\n", "\u010a")):
                found[mark][k] = piece.startswith(letter)
        made[id(encoder)] = found
    return made[id(encoder)]


def _pieces(path: str, length: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 6 if with_ids else 5]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, memory = tokenizer(path), word_memory(f"ids of {path}")
        for batch in batches:
            for part in batches_by_bytes(batch, "text", TEXT_BYTES):
                which, rows = [], []
                for d, ids in enumerate(encode_texts(encoder, memory, [t or "" for t in part.column("text").to_pylist()])):
                    ids += END_ID.to_bytes(4, "little")
                    total = len(ids) // 4
                    for start in range(0, total, length):
                        piece = ids[4 * start : 4 * (start + length)]
                        which.append(d)
                        rows.append((start, len(piece) // 4, zlib.crc32(piece), total, piece))
                columns = list(zip(*rows, strict=True))
                made = [pa.array(c, pa.int64()) for c in columns[:4]] + ([pa.array(columns[4], pa.binary())] if with_ids else [])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(which)), *made], names)
                pa.default_memory_pool().release_unused()

    return cut_up


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32,
    doc_tokens and, with with_ids, the ids (little-endian 32-bit words). A
    document is its ids and the end id; it is cut after each `length` ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    return rows.mapInArrow(_pieces(tokenizer_path, length, with_ids), schema)


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """(count, [(piece length, times)]) of each packing pattern. Lengths are
    placed longest first, each into the packs with the most room (the shortest
    packs), as many at once as there are; what fits nowhere opens new packs.

    A step either uses up a pattern, which one new pattern replaces, or ends its
    length and leaves two at most: there are no more patterns than twice the
    lengths. The different lengths of a pattern sum to `length` at most, so that
    it has fewer than sqrt(2 * length)."""
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            free = max((r for r, packs in room.items() if packs), default=-1)
            if free < size:
                # new packs take as many pieces of this length as they hold; the last one what remains
                per = length // size
                for count, times in ((left // per, per), (1, left % per)):
                    if count and times:
                        room.setdefault(length - size * times, []).append((count, [(size, times)]))
                break
            count, pattern = room[free].pop()
            used = min(left, count)
            if used < count:
                room[free].append((count - used, pattern))
            times = pattern[-1][1] + 1 if pattern[-1][0] == size else 1
            room.setdefault(free - size, []).append((used, [*(pattern[:-1] if times > 1 else pattern), (size, times)]))
            left -= used
    return [pack for packs in room.values() for pack in packs]


def pattern_places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, times, sequence of the first rank, offset)
    of each run of equal pieces in each pattern. The pieces of a length, by rank,
    fill the places of that length one after the other, `times` a sequence."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for size, times in pattern:
            first = rank.get(size, 0)
            rank[size] = first + count * times
            out.append((size, first, first + count * times, times, sequence, offset))
            offset += size * times
        sequence += count
    return out


def pack(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """found: the rows of pieces() without ids. Adds sequence_id (gapless from
    0) and offset. Equal rows are told apart by their number. The driver sees
    the histogram (at most `length` rows) and makes the table of places."""
    spark = found.sparkSession
    keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rows = cut(numbered_copies(found, keys), "pieces")
    histogram = {r[0]: r[1] for r in rows.groupBy("length").agg(F.count(F.lit(1))).collect()}
    # the parts of a length follow its count
    parts_of = F.element_at(F.array(*(F.lit(-(-histogram.get(size, 1) // PART)) for size in range(1, length + 1))), F.col("length").cast("int"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), parts_of))
    parts = rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")
    parts = cut(parts.select("length", "_part", before.alias("_before")), "parts")
    within = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*keys, "copy")) - 1
    ranked = rows.withColumn("_within", within).join(parts.hint("merge"), ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_within"))
    # at most 2 * length * sqrt(2 * length) rows of 48 bytes: 4.5 MB at a length of 1024
    places = spark.createDataFrame(
        pattern_places(shortest_pack_first(histogram, length)), "_length long, _first long, _end long, _times long, _sequence long, _offset long"
    )
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))
    nth = F.col("_rank") - F.col("_first")
    joined = ranked.join(F.broadcast(places), here).withColumn("_k", nth)
    return joined.select(*keys, (F.col("_sequence") + F.expr("_k div _times")).alias("sequence_id"), (F.col("_offset") + F.expr("_k % _times") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A null or empty text is the end id alone. Rows with
    the same id are packed each for itself. Empty input gives no rows."""
    return pack(pieces(docs, tokenizer_path, length, id_col, text_col), length)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer_path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, n_ids, ids): the sequences themselves, ids in order, padded
    with pad_id to `length` unless n_ids is a power of two. Each holds at most
    `length` pieces. placed: the rows of pack_documents on the same docs."""
    nth = Window.partitionBy("doc_id", "start", "ids_crc32").orderBy(F.lit(1))
    made = pieces(docs, tokenizer_path, length, id_col, text_col, with_ids=True).withColumn("_nth", F.row_number().over(nth))
    order = Window.partitionBy("doc_id", "start", "ids_crc32").orderBy("sequence_id", "offset")
    spot = placed.withColumn("_nth", F.row_number().over(order)).select(F.col("doc_id").alias("_id"), F.col("start").alias("_start"), F.col("ids_crc32").alias("_crc"), "_nth", "sequence_id", "offset")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (made["start"] == F.col("_start")) & (F.col("ids_crc32") == F.col("_crc")) & (made["_nth"] == spot["_nth"])
    joined = made.join(spot, same).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_all"), F.sum("length").alias("n_ids"))

    def padded(parts: pa.Array) -> pa.Array:
        out = []
        for part in parts:
            ids = b"".join(x["ids"] for x in part.as_py())
            n = len(ids) // 4
            out.append(ids if n & (n - 1) == 0 else ids + pad_id.to_bytes(4, "little") * (length - n))
        return pa.array(out, pa.binary())

    return joined.select("sequence_id", "n_ids", F.arrow_udf(padded, "binary")("_all").alias("ids"))
