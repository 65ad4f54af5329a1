"""Quality rules as a ledger: measurements and one bit per failed rule, so that
policies and ablations are bit arithmetic over a table computed once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemlab.llm.common import WHITE, free_name, packed, word_memory

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, n_upper long"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
WINDOW = 5

#: name, condition on the measurements that means failure. A rule's bit is its place here;
#: rules are only ever added at the end, so stored bits keep their meaning.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("symbol_rich", "100 * n_symbols > 10 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("shouting", "100 * n_upper > 50 * word_chars"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]


@dataclass(frozen=True)
class Policy:
    """A version of what to reject: documents with any failed rule of mask."""

    version: int
    mask: int


POLICIES = {
    1: Policy(1, BASE),
    2: Policy(2, sum(BIT.values())),
}


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES; a null text
    measures as an empty one. Words are runs without ASCII white space, so
    bytes.split finds exactly them."""
    if not text:
        return (0,) * 7
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    white = len(raw) - len(raw.translate(None, WHITE))
    count = lambda which: len(raw) - len(raw.translate(None, which))
    lines = [line for line in raw.split(b"\n") if line.translate(None, WHITE)]
    return len(words), len(text) - white, count(SYMBOLS), len(lines) - len(set(lines)), len(lines), repeated_words(words), count(UPPER)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 5-word window that occurs twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = until = 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + WINDOW - max(at, until)
            until = at + WINDOW
    return covered


def _measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = [part.split()[0] for part in MEASURES.split(", ")]
    word_memory()
    for texts in batches:
        rows = [measure_text(text.as_py()) for text in texts]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def ledger(docs: DataFrame, text_col: str = "text", into: str = "_ledger") -> DataFrame:
    """docs with a struct column free_name(docs, into): the measurements and
    `failed`, the bits of failed rules. Every rule is evaluated once; empty and
    null texts fail few_words alone. Row-local: no shuffle, any other column
    passes through."""
    into = free_name(docs, into)
    measured = F.arrow_udf(_measured, MEASURES)(F.col(text_col).cast("string"))
    out = docs.withColumn(into, measured)
    bits = [F.when(F.expr(_qualified(rule, into)), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return out.withColumn(into, F.col(into).withField("failed", failed.cast("long")))


def _qualified(rule: str, into: str) -> str:
    return " ".join(f"{into}.{token}" if token.isidentifier() else token for token in rule.split())


def passes(policy: Policy, into: str = "_ledger"):
    return F.col(f"{into}.failed").bitwiseAND(F.lit(policy.mask)) == 0


def ablation(table: DataFrame, policy: Policy, failed_col: str = "failed") -> DataFrame:
    """Per rule of the policy: rule, n_failed (documents that fail it),
    n_only (documents rejected by it alone: what dropping the rule would let
    back in). The table is first counted by its bits, at most 2^rules rows."""
    masked = table.groupBy(F.col(failed_col).bitwiseAND(F.lit(policy.mask)).alias("_bits")).agg(F.count(F.lit(1)).alias("_n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name, _ in RULES if BIT[name] & policy.mask]
    each = masked.withColumn("_rule", F.explode(F.array(*rules)))
    hit = F.col("_bits").bitwiseAND(F.col("_rule.bit")) != 0
    return each.groupBy(F.col("_rule.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("_n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("_bits") == F.col("_rule.bit"), F.col("_n"))), F.lit(0)).alias("n_only"),
    )


def quality_columns(docs: DataFrame, policy: Policy = POLICIES[2], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the measurements, `failed`, `base_failed`, `kept`
    under the policy (base failures are never kept)."""
    rows = ledger(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text")
    base = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return (
        rows.select("doc_id", "_ledger.*")
        .withColumn("base_failed", base)
        .withColumn("policy_version", F.lit(policy.version))
        .withColumn("kept", ~base & (F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0))
    )


def keep_documents(docs: DataFrame, policy: Policy = POLICIES[2], text_col: str = "text") -> DataFrame:
    """The rows of docs that the policy and the base rules let through."""
    full = Policy(policy.version, policy.mask | BASE)
    return ledger(packed(docs), f"_row.{text_col}").where(passes(full)).select("_row.*")
