"""Token counts of whole texts, huge ones by overlap resynchronisation."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemlab.llm.common import batches_by_bytes, free_name, word_memory, worker_cache

#: Texts over CHUNK characters are encoded in chunks that overlap by OVERLAP.
CHUNK, OVERLAP = 1 << 15, 1 << 9
_AFTER_SPACE = re.compile(r"(?<=[ \t\n\x0b\x0c\r])[^\s]")
#: The worker's memory of counted words: entries, and the longest word kept.
REMEMBERED, REMEMBERED_BYTES = 800_000, 64
COUNTS = "n_bytes long, n_tokens long, n_chunks long"


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    loaded = worker_cache("tokenizers")
    if path not in loaded:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        loaded[path] = made
    return loaded[path]


def resynchronised(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[int], int]:
    """(ids of the whole text, chunks encoded). encode(text) gives an object
    with ids and offsets (character spans).

    Neighbouring chunks are spliced at a position p that follows ASCII white
    space, holds no white space itself, and starts a token in both encodings.
    That is proven stable for tokenizers that drop or split at white space and
    whose normaliser doesn't compose across it: no token spans p - 1 and p, and
    nothing on one side changes the other. Where an overlap has no such place
    (a run without white space), the left chunk is encoded anew with twice the
    overlap, up to the text's end, so that every text ends exact.
    """
    ids: list[int] = []
    begin, skip, chunks = 0, 0, 1  # tokens that start before `skip` are already there
    left = encode(text[:chunk])
    while True:
        end, extra = begin + chunk, 0
        while True:
            stop = min(end + extra, len(text))
            if extra:
                left = encode(text[begin:stop])
                chunks += 1
            keep = [(a + begin, token) for token, (a, _) in zip(left.ids, left.offsets, strict=True)]
            if stop == len(text):
                return ids + [token for a, token in keep if a >= skip], chunks
            start = max(begin + 1, end - overlap)
            if not extra:
                right = encode(text[start : min(start + chunk, len(text))])
                chunks += 1
            ahead = {a + start for a, _ in right.offsets}
            both = ahead.intersection(a for a, _ in keep)
            # the last shared start that is proven stable; the chunk's own last word may be cut
            places = [m.start() for m in _AFTER_SPACE.finditer(text, start, stop) if m.start() > max(start, skip) and m.start() in both]
            if places:
                break
            extra = max(2 * extra, overlap)
        place = places[-1]
        ids += [token for a, token in keep if skip <= a < place]
        begin, skip, left = start, place, right


def count_tokens(encoder, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP, memory: dict[bytes, int] | None = None) -> list[tuple[int, int]]:
    """(tokens, chunks) of each text. Texts of up to `chunk` characters need no
    splice: white space bounds their tokens everywhere, so each distinct word
    between ASCII white space is encoded once, and counts add up. A tokenizer
    that doesn't drop white space is refused."""
    _drops_white_space(encoder)
    memory = {} if memory is None else memory
    if len(memory) > REMEMBERED:
        memory.clear()
    words = [text.encode("utf-8", "surrogatepass").split() if len(text) <= chunk else None for text in texts]
    missing = list(set().union(*(w for w in words if w)).difference(memory))
    encoded = encoder.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in missing], add_special_tokens=False)
    memory.update((w, len(got.ids)) for w, got in zip(missing, encoded, strict=True))
    out = []
    for text, own in zip(texts, words, strict=True):
        if own is None:
            ids, chunks = resynchronised(lambda piece: encoder.encode(piece, add_special_tokens=False), text, chunk, overlap)
            out.append((len(ids), chunks))
        else:
            out.append((sum(map(memory.__getitem__, own)), 1))
    for word in missing:
        if len(word) > REMEMBERED_BYTES:
            del memory[word]
    return out


#: Pairs of ends of words between which a tokenizer could look across white space.
_ENDS = (("ab", "cd"), ("1", "2"), ("don", "'t"), (".", "."), ("é", "\u0301x"), ("<", "|endoftext|>"), ("中", "文"))


def _drops_white_space(encoder) -> None:
    """Raises where words on both sides of white space don't encode as they do
    alone, or white space has tokens of its own."""
    seen = worker_cache("drops white space")
    if id(encoder) not in seen:
        ids = lambda text: encoder.encode(text, add_special_tokens=False).ids
        for space in " \t\n\x0b\x0c\r":
            for a, b in _ENDS:
                if ids(a + space + b) != ids(a) + ids(b) or ids(space + a + space) != ids(a):
                    raise ValueError(f"the tokenizer doesn't drop {space!r} between words")
        seen[id(encoder)] = True


def _counting(path: str):
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, memory = tokenizer(path), word_memory(f"counts of {path}")
        for column in batches:
            sizes, found = [], []
            for part in batches_by_bytes(pa.RecordBatch.from_arrays([column], ["text"]), "text", 1 << 19):
                texts = [text or "" for text in part.column(0).to_pylist()]
                sizes += [len(text.encode()) for text in texts]
                found += count_tokens(encoder, texts, memory=memory)
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64())],
                ["n_bytes", "n_tokens", "n_chunks"],
            )

    return counted


def with_token_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", into: str = "_tokens") -> DataFrame:
    """docs with a struct column `into`: n_bytes (UTF-8), n_tokens, n_chunks
    (1 for texts encoded whole). No special tokens are added; those that stand
    in a text are read as the library does. Null counts as empty: no tokens,
    one chunk. The column is free_name(docs, into). Row-local, no shuffle; all
    other columns pass through."""
    return docs.withColumn(free_name(docs, into), F.arrow_udf(_counting(tokenizer_path), COUNTS)(F.col(text_col).cast("string")))
