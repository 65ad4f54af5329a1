"""Language-model scores: a unigram word baseline, and the marginal probability
of a text over all its segmentations into pieces of an existing vocabulary.

The vocabulary is taken as it is from a tokenizer file. Its own numbers are
merge ranks, not probabilities, so the pieces' unigram scores are made here: a
piece's score is the log of its smoothed share among the pieces of the training
documents' words. The first scores count the pieces as the tokenizer segments
the words; each round then counts what is expected of a piece over all
segmentations (forward and backward), weighted by the scores so far.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemlab.llm.common import cut, worker_cache

#: Words counted most often are looked up in a broadcast table of at most this
#: many rows, of words of at most SHORT bytes; all others are joined.
FREQUENT, SHORT = 1 << 18, 64
#: Bytes of text after which a worker hands on its counts, whatever their number.
COUNTED_BYTES = 1 << 26
#: Rounds of expected counts, and characters of words that are in work at once.
ROUNDS, TOGETHER = 2, 1 << 16
END = b""  # the end token: no word is empty
SMOOTH = 0.5


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves `fold`; a null id is text ''."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(ident.cast("binary")) % folds == fold


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, in training documents, in all documents), summed as far as
    FREQUENT distinct words or COUNTED_BYTES of text go."""
    trained, every = Counter(), Counter()
    held = 0

    def flush():
        words = list(every)
        columns = [pa.array(words, pa.binary()), pa.array([trained[w] for w in words], pa.int64()), pa.array([every[w] for w in words], pa.int64())]
        trained.clear()
        every.clear()
        return pa.RecordBatch.from_arrays(columns, ["word", "c", "total"])

    for batch in batches:
        for value, out in zip(batch.column("text"), batch.column("held_out").to_pylist(), strict=True):
            text = value.as_py() or ""
            words = words_of(text)
            words.append(END)
            every.update(words)
            if not out:
                trained.update(words)
            held += len(text)
            if len(every) > FREQUENT or held > COUNTED_BYTES:
                yield flush()
                held = 0
    if every:
        yield flush()


def _pieces_used(model_path: str):
    """(piece id, uses) over words weighted by their count, as the tokenizer
    itself segments them."""

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor, found = _processor(model_path), Counter()
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            for ids, n in zip(processor.encode(words, num_threads=1), batch.column("c").to_pylist(), strict=True):
                for piece in ids:
                    found[piece] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["piece", "uses"])

    return used


def _processor(model_path: str):
    loaded = worker_cache("sentencepiece")
    if model_path not in loaded:
        import sentencepiece

        loaded[model_path] = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return loaded[model_path]


class Lattice:
    """Unigram scores (natural logs) of pieces, of single bytes, and of the end.

    Words of one length are in work together: a substring's 64-bit hash finds its
    piece, and each step of the recursions is one array operation over the words.
    """

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: dict[str, float], bytes_: list[float], end: float):
        self.names, self.bytes, self.end = list(pieces), np.array(bytes_, float), end
        self.longest = max(map(len, pieces), default=1)
        hashes = np.zeros(len(pieces), np.uint64)
        for k in range(self.longest):
            longer = np.array([len(name) > k for name in self.names], bool)
            letters = np.array([ord(name[k]) + 1 for name in self.names if len(name) > k], np.uint64)
            hashes[longer] = hashes[longer] * self.FACTOR + letters
        order = np.argsort(hashes)
        self.hashes, self.places = np.append(hashes[order], np.uint64(0)), np.append(order, 0)
        # the last score is that of no piece
        self.scores = np.append(np.array(list(pieces.values()), float), -np.inf)

    def _edges(self, letters: np.ndarray) -> list[np.ndarray]:
        """letters: words by places. Per width from 1, the piece that begins at each place (-1: none)."""
        found, hashes = [], np.zeros(letters.shape, np.uint64)
        for width in range(1, min(self.longest, letters.shape[1]) + 1):
            hashes = hashes[:, : letters.shape[1] - width + 1] * self.FACTOR + letters[:, width - 1 :] + np.uint64(1)
            at = np.searchsorted(self.hashes[:-1], hashes)
            found.append(np.where(self.hashes[at] == hashes, self.places[at], -1) if len(self.names) else np.full(hashes.shape, -1))
        return found

    def _spelt(self, letters: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Where characters are no piece and are spelt in bytes; their scores."""
        missing = single < 0
        codes, which = np.unique(letters[missing], return_inverse=True)
        raw = [chr(int(c)).encode("utf-8", "replace") for c in codes]
        cost = np.array([self.bytes[list(x)].sum() for x in raw])
        return missing, which, raw, cost

    def _forward(self, letters: np.ndarray):
        edges = self._edges(letters)
        weights = [self.scores[e] for e in edges]
        missing, which, raw, cost = self._spelt(letters, edges[0])
        weights[0][missing] = cost[which]
        n, length = letters.shape
        ahead = np.full((n, length + 1), -np.inf)
        ahead[:, 0] = 0
        for j in range(1, length + 1):
            ahead[:, j] = _log_sum([ahead[:, j - w] + weights[w - 1][:, j - w] for w in range(1, min(len(edges), j) + 1)])
        return edges, weights, (missing, which, raw), ahead

    def log_marginals(self, words: list[str]) -> np.ndarray:
        """Log of the summed probabilities of all segmentations of each word with
        its leading mark; a character that is no piece is spelt in bytes. Marks
        only begin pieces, so a text's lattice falls apart into those of its words
        and its marginal is their sum."""
        out = np.zeros(len(words))
        for at, letters in _by_length(words):
            out[at] = self._forward(letters)[-1][:, -1]
        return out

    def log_marginal(self, word: str) -> float:
        return float(self.log_marginals([word])[0])

    def expected(self, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Uses of each piece and of each byte that are expected over all
        segmentations of the words, each counted so many times."""
        uses, spelt = np.zeros(len(self.names)), np.zeros(256)
        for at, letters in _by_length(words):
            edges, weights, (missing, which, raw), ahead = self._forward(letters)
            n, length = letters.shape
            behind = np.full((n, length + 1), -np.inf)
            behind[:, -1] = 0
            for i in range(length - 1, -1, -1):
                behind[:, i] = _log_sum([weights[w - 1][:, i] + behind[:, i + w] for w in range(1, min(len(edges), length - i) + 1)])
            for w, (pieces, weight) in enumerate(zip(edges, weights, strict=True), 1):
                # impossible paths are -inf on both sides
                share = np.exp(ahead[:, : length - w + 1] + weight + behind[:, w:] - ahead[:, -1:]) * counts[at][:, None]
                held = pieces >= 0
                uses += np.bincount(pieces[held], share[held], minlength=len(uses))
                if w == 1 and len(raw):
                    for letter, total in zip(raw, np.bincount(which, share[missing], minlength=len(raw)), strict=True):
                        np.add.at(spelt, list(letter), total)
        return uses, spelt


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    if len(terms) == 1:
        return terms[0]
    held = np.stack(terms)
    top = held.max(axis=0)
    top[np.isneginf(top)] = 0
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(held - top).sum(axis=0))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words, their characters with the mark before them) of words of one length."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths):
        same = np.flatnonzero(lengths == length)
        step = max(1, TOGETHER // int(length + 1))
        for k in range(0, len(same), step):
            at = same[k : k + step]
            raw = "".join("▁" + words[i] for i in at).encode("utf-32-le", "surrogatepass")
            yield at, np.frombuffer(raw, "<u4").reshape(len(at), length + 1).astype(np.uint64)


def make_lattice(model_path: str, uses: dict[int, float], ends: int) -> tuple[Lattice, list[int], list[int]]:
    """Scores from the uses of each piece (one row per piece of the vocabulary,
    whose size is fixed) and the number of training documents; the ids of the
    lattice's pieces and of the 256 bytes (-1: none)."""
    processor = _processor(model_path)
    known = [k for k in range(processor.get_piece_size()) if not (processor.is_control(k) or processor.is_unknown(k))]
    total = sum(uses.get(k, 0) for k in known) + ends + SMOOTH * (len(known) + 1)
    score = {k: math.log((uses.get(k, 0) + SMOOTH) / total) for k in known}
    spelt, pieces, of_piece, of_byte = [math.log(SMOOTH / total)] * 256, {}, [], [-1] * 256
    for k in known:
        if processor.is_byte(k):
            byte = int(re.fullmatch("<0x(..)>", processor.id_to_piece(k))[1], 16)
            spelt[byte], of_byte[byte] = score[k], k
        elif "▁" not in (piece := processor.id_to_piece(k))[1:]:
            pieces[piece] = score[k]
            of_piece.append(k)
    return Lattice(pieces, spelt, math.log((ends + SMOOTH) / total)), of_piece, of_byte


def _expected(lattice: Lattice, of_piece: list[int], of_byte: list[int]):
    """(piece id, expected uses) over words weighted by their count."""

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses, spelt = np.zeros(len(of_piece)), np.zeros(256)
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            a, b = lattice.expected(words, np.asarray(batch.column("c"), float))
            uses, spelt = uses + a, spelt + b
        ids, found = np.array([*of_piece, *of_byte], np.int64), np.concatenate([uses, spelt])
        there = (found > 0) & (ids >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[there]), pa.array(found[there])], ["piece", "uses"])

    return expected


def _scoring(lattice: Lattice):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            marginal = lattice.log_marginals([w.decode("utf-8", "replace") for w in words])
            marginal[[w == END for w in words]] = lattice.end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marginal, pa.float64())], [*batch.schema.names, "marginal"])

    return scored


def _documents(table: dict[bytes, tuple[float, float, int]]):
    """Per document one row with the sums over frequent words, and one row per
    other word. A document's own row has a join key with a space in front: it
    matches no word and spreads over the partitions."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "held_out", "word", "times", "documents", "n_tokens", "base", "marginal", "known"]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                which, columns = [], [[] for _ in names[3:]]
                for d, text in enumerate(part.column("text")):
                    words = words_of(text.as_py())
                    counts = Counter(words)
                    counts[END] += 1
                    base = marginal = 0.0
                    known = 0
                    rare = []
                    for word, n in counts.items():
                        if (hit := table.get(word)) is None:
                            rare.append((word, n, 0, 0, 0.0, 0.0, 0))
                        else:
                            base += n * hit[0]
                            marginal += n * hit[1]
                            known += n * hit[2]
                    own = b" %d %d" % (d, part.column("text_key")[d].as_py())
                    for row in [(own, 0, 1, len(words) + 1, base, marginal, known), *rare]:
                        which.append(d)
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
                index = pa.array(which, pa.int64())
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
                made = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(index) for c in names[:3]), *made], names)

    return rows


def score(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens (words and the end),
    n_known (tokens with a count in training), train_tokens, base_score (log10
    of the smoothed word unigram) and score (log10 of the lattice marginal).

    Counts come from all documents not held out; every word of every document
    is scored. Null texts are empty: they hold the end alone. A null id counts
    as the text ''. Rows equal in id and text get a row each. Without training
    documents all counts are 0; empty input gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("held_out", held_out("doc_id", folds, fold))
    counts = rows.select("text", "held_out").mapInArrow(_counting, "word binary, c long, total long")
    counts = cut(counts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total")), "word-counts")
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("c"))), F.lit(0))).first()

    trained = counts.where("c > 0 and octet_length(word) > 0")
    uses = trained.mapInArrow(_pieces_used(model_path), "piece long, uses long").groupBy("piece").agg(F.sum("uses").alias("uses"))
    lattice, *ids = make_lattice(model_path, {r.piece: r.uses for r in uses.collect()}, ends)
    for _ in range(ROUNDS):
        uses = trained.select("word", "c").mapInArrow(_expected(lattice, *ids), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        lattice, *ids = make_lattice(model_path, {r.piece: r.uses for r in uses.collect()}, ends)

    base = F.log10((F.col("c") + SMOOTH) / (n + SMOOTH * (v + 1)))
    words = counts.mapInArrow(_scoring(lattice), "word binary, c long, total long, marginal double")
    words = cut(words.select("word", "total", base.alias("_base"), F.col("marginal").alias("_marginal"), (F.col("c") > 0).cast("int").alias("_known")), "word-scores")
    often = _threshold(words)
    is_frequent = (F.col("total") >= often) & (F.octet_length("word") <= SHORT)
    frequent = words.where(is_frequent).select("word", "_base", "_marginal", "_known").toArrow()
    table = {w: (b, m, k) for w, b, m, k in zip(*(c.to_pylist() for c in frequent.columns), strict=True)}

    tokens = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "held_out", "text").mapInArrow(
        _documents(table), "doc_id long, text_key long, held_out boolean, word binary, times long, documents long, n_tokens long, base double, marginal double, known long"
    )
    joined = tokens.join(words.where(~is_frequent).drop("total"), "word", "left")
    share = lambda own, per: F.sum(F.col(own) + F.coalesce(F.col("times") * F.col(per), F.lit(0)))
    summed = joined.groupBy("doc_id", "text_key", "held_out").agg(
        F.sum("documents").alias("_rows"), F.sum("n_tokens").alias("_n"), share("known", "_known").alias("_k"), share("base", "_base").alias("_b"), share("marginal", "_marginal").alias("_m")
    )
    each = summed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
    return each.select(
        "doc_id",
        "held_out",
        (F.col("_n") / F.col("_rows")).cast("long").alias("n_tokens"),
        (F.col("_k") / F.col("_rows")).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("_b") / F.col("_rows")).alias("base_score"),
        (F.col("_m") / F.col("_rows") / math.log(10)).alias("score"),
    )


def _threshold(words: DataFrame) -> int:
    """The least count such that at most FREQUENT words reach it, from a
    histogram of 8 classes per doubling (at most a few hundred rows)."""
    level = F.floor(F.log2("total") * 8)
    seen, previous = 0, 1 << 62
    for _, n, low in sorted(words.groupBy(level.alias("k")).agg(F.count(F.lit(1)), F.min("total")).collect(), reverse=True):
        seen += n
        if seen > FREQUENT:
            return previous
        previous = low
    return previous
