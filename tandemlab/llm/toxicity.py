"""Toxicity by a classifier chain of linear models over words and their beginnings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemlab.llm.common import free_name

#: At most this many labelled documents are used to fit, those with the least hash of their id.
FIT_ROWS = 16_384
FOLDS, RIDGE = 5, 1.0
#: Words and beginnings of fewer documents of the fit than this are no features; all others are.
LEAST_DOCUMENTS = 4
#: Bytes of the beginnings that are features besides whole words, so that inflected forms share weight.
BEGINNINGS = (4, 5, 6)
#: A worker remembers the features of so many words.
WORDS_KEPT = 100_000
#: The chain, in order: earlier categories inform later ones. The labels hold two
#: columns; the last category is a document that is both, and informs no other.
CATEGORIES = ("low_quality", "toxic", "toxic_low_quality")

_SPACE_OUT = bytes(b if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> set[bytes]:
    """Distinct words, A-Z lower-cased, ASCII punctuation as white space."""
    return set((text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACE_OUT).split())


def features_of(word: bytes) -> list[bytes]:
    """The word and its beginnings; b"*" is in no word, so the two never meet."""
    return [word, *(word[:k] + b"*" for k in BEGINNINGS if len(word) > k)]


@dataclass
class Chain:
    """weights[k] belongs to category k: bias, earlier categories' probabilities,
    features. cuts[k] is the probability from which on a document is said to be
    of category k."""

    categories: tuple[str, ...]
    words: dict[bytes, int]
    weights: list[np.ndarray]
    cuts: tuple[float, ...]

    def probabilities(self, found: list[list[int]]) -> np.ndarray:
        """found: per document the places of its features. One column per category."""
        earlier = np.zeros((len(found), 0))
        for weights in self.weights:
            k = earlier.shape[1]
            own = weights[1 + k :]
            logit = weights[0] + earlier @ weights[1 : 1 + k] + np.array([own[places].sum() for places in found])
            earlier = np.column_stack([earlier, _sigmoid(logit)])
        return earlier


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Rows:
    """A sparse 0/1 matrix: per document the places of its features, and per
    feature its documents. Products are sums over runs, a part at a time, so that
    what they hold for a while stays small."""

    def __init__(self, found: list[np.ndarray], width: int):
        self.n, self.width = len(found), width
        lengths = np.array([len(x) for x in found], np.int64)
        at = np.concatenate([*found, np.zeros(0, np.int32)])
        document = np.repeat(np.arange(self.n, dtype=np.int32), lengths)
        self.by_document = _parts(at, lengths)
        self.by_feature = _parts(document[np.argsort(at, kind="stable")], np.bincount(at, minlength=width))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return _sums(self.by_document, w, self.n)

    def turned(self, r: np.ndarray) -> np.ndarray:
        """The transposed matrix times r."""
        return _sums(self.by_feature, r, self.width)


def _parts(at: np.ndarray, lengths: np.ndarray, size: int = 1 << 18) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs that are not empty, in parts of about `size`: the places in them, where each run starts, whose it is."""
    whose = np.flatnonzero(lengths)
    ends = np.cumsum(lengths[whose])
    out, a = [], 0
    while a < len(whose):
        start = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, start + size, "right")))
        out.append((at[start : ends[b - 1]].astype(np.intp), np.concatenate([[0], ends[a : b - 1] - start]).astype(np.intp), whose[a:b]))
        a = b
    return out


def _sums(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    for at, starts, whose in parts:
        out[whose] = np.add.reduceat(values.take(at), starts)
    return out


def fit_logistic(rows: Rows, earlier: np.ndarray, y: np.ndarray, used: np.ndarray, ridge: float = RIDGE, steps: int = 30) -> np.ndarray:
    """Bias, weights of `earlier` and of the features, from the documents where
    `used` is 1: Newton's method by conjugate gradients with an L2 penalty; with
    one class only, a bias alone. Before the penalty, features are scaled by the
    absolute log ratio of their rates in the two classes, so that the many which
    tell nothing can't drown the few which do."""
    k, n, hits = earlier.shape[1], used.sum(), (used * y).sum()
    w = np.zeros(1 + k + rows.width)
    share = (hits + 0.5) / (n + 1)
    w[0] = np.log(share / (1 - share))
    if hits in (0, n):
        return w
    inside, total = rows.turned(used * y), rows.turned(used)
    scale = np.abs(np.log((inside + 1) / (hits + 2)) - np.log((total - inside + 1) / (n - hits + 2)))
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6

    def times(v):
        return v[0] + earlier @ v[1 : 1 + k] + rows.dot(v[1 + k :] * scale)

    def back(r):
        return np.concatenate([[r.sum()], earlier.T @ r, scale * rows.turned(r)])

    def loss(w, z):
        return (used * (np.logaddexp(0, z) - y * z)).sum() + (penalty * w * w).sum() / 2

    z = times(w)
    now, first = loss(w, z), None
    for _ in range(steps):
        p = _sigmoid(z)
        left = back(used * (y - p)) - penalty * w
        size = left @ left
        first = first or size
        if size <= 1e-6 * first:
            break
        step, way, until = np.zeros(len(w)), left.copy(), 0.01 * size
        for _ in range(60):
            bent = back(used * p * (1 - p) * times(way)) + penalty * way
            far = size / (way @ bent)
            step += far * way
            left = left - far * bent
            size, before = left @ left, size
            if size <= until:
                break
            way = left + size / before * way
        moved = times(step)
        while (then := loss(w + step, z + moved)) > now and np.abs(step).max() > 1e-6:
            step, moved = step / 2, moved / 2
        if then > now:
            break
        w, z, now = w + step, z + moved, then
    w[1 + k :] *= scale
    return w


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on saying yes gives the best F1, half-way to
    the next lower one; of equally good ones the highest. 0.5 with one class only."""
    if len(y) == 0 or y.min() == y.max():
        return 0.5
    values, at = np.unique(-p, return_inverse=True)
    said = np.cumsum(np.bincount(at))
    right = np.cumsum(np.bincount(at, y))
    best = int(np.argmax(2 * right / (said + y.sum())))
    return float(-(values[best] + values[min(best + 1, len(values) - 1)]) / 2)


def numbered(documents: Iterable[list[bytes]]) -> tuple[dict[bytes, int], list[np.ndarray]]:
    """All features of enough documents by place, in order of their bytes, and
    each document's places."""
    known: dict[bytes, int] = {}
    ids: dict[bytes, list[int]] = {}
    found = []
    for words in documents:
        own: set[int] = set()
        for word in words:
            if word not in ids:
                ids[word] = [known.setdefault(f, len(known)) for f in features_of(word)]
            own.update(ids[word])
        found.append(np.fromiter(sorted(own), np.int32, len(own)))
    del ids
    counts = np.zeros(len(known), np.int64)
    for own in found:
        counts[own] += 1
    chosen = sorted(f for f, k in known.items() if counts[k] >= LEAST_DOCUMENTS)
    place = np.full(len(known), -1, np.int32)
    place[[known[f] for f in chosen]] = np.arange(len(chosen))
    for k, own in enumerate(found):
        at = place[own]
        found[k] = np.sort(at[at >= 0])
    return {f: k for k, f in enumerate(chosen)}, found


def fit_chain(documents: Iterable[bytes], y: np.ndarray, categories: tuple[str, ...] = CATEGORIES, folds: int = FOLDS) -> Chain:
    """documents: the terms of each, joined by spaces; y: a 0/1 column per category. Each link is
    fitted on the features and on out-of-fold probabilities of the earlier links,
    so that it sees earlier outputs as good as those it will get later on. Those
    probabilities also set the link's cut. Documents of equal terms share a fold.
    What is a feature depends on no label; how features are scaled does, and is
    fitted inside the fold."""
    folds_of: list[int] = []

    def split() -> Iterator[list[bytes]]:
        for own in documents:
            folds_of.append(crc32(own) % folds)
            yield own.split()

    words, found = numbered(split())
    rows = Rows(found, len(words))
    fold, weights, cuts = np.array(folds_of, np.int64), [], []
    earlier = np.zeros((rows.n, 0))
    for k in range(y.shape[1]):
        out = np.zeros(rows.n)
        for f in range(folds):
            w = fit_logistic(rows, earlier, y[:, k], (fold != f).astype(float))
            out = np.where(fold == f, _sigmoid(w[0] + earlier @ w[1 : 1 + k] + rows.dot(w[1 + k :])), out)
        weights.append(fit_logistic(rows, earlier, y[:, k], np.ones(rows.n)))
        cuts.append(best_cut(out, y[:, k]))
        earlier = np.column_stack([earlier, out])
    return Chain(categories, words, weights, tuple(cuts))


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [b" ".join(sorted(terms(text.as_py()))) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "quality", "toxic")), pa.array(found, pa.binary())], ["doc_id", "quality", "toxic", "terms"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Chain:
    """Fit the chain on at most `rows` labelled documents. Labels without an id
    or with a null label are left out; a document labelled twice counts by each
    label. Only the distinct words of those documents reach the driver."""
    whole = labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", "quality", "toxic")
    chosen = whole.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(rows)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # at most `rows` rows of three numbers
    sample = source.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "toxic", "text")
    table = sample.mapInArrow(_terms_of, "doc_id long, quality int, toxic int, terms binary").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending"), ("toxic", "ascending")])
    low, toxic = 1 - np.asarray(table.column("quality"), float), np.asarray(table.column("toxic"), float)
    documents = (x.as_py() for x in table.column("terms"))
    return fit_chain(documents, np.column_stack([low, toxic, low * toxic]).reshape(len(low), 3))


def _classified(chain: Chain):
    def classified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory: dict[bytes, list[int]] = {}

        def places(text: str | None) -> list[int]:
            own: set[int] = set()
            for word in terms(text):
                if word not in memory:
                    if len(memory) >= WORDS_KEPT:
                        memory.clear()
                    memory[word] = [chain.words[f] for f in features_of(word) if f in chain.words]
                own.update(memory[word])
            return sorted(own)

        for column in batches:
            found = [places(text.as_py()) for text in column]
            p = chain.probabilities(found)
            yield pa.StructArray.from_arrays([pa.array(p[:, k], pa.float64()) for k in range(p.shape[1])], list(chain.categories))

    return classified


def with_toxicity(docs: DataFrame, chain: Chain, text_col: str = "text", into: str = "_toxicity") -> DataFrame:
    """docs with a struct column of one probability per category, read from the
    whole text; null texts count as empty. The column is free_name(docs, into).
    Row-local: no shuffle, all other columns pass through."""
    schema = ", ".join(f"{name} double" for name in chain.categories)
    return docs.withColumn(free_name(docs, into), F.arrow_udf(_classified(chain), schema)(F.col(text_col).cast("string")))
