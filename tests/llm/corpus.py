"""Small documents with every awkward case, and brute-force twins."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, slot string, copy string, `_key` string, `_row` string, digest string, node string, rank string, `_tokens` string, `_ledger` string, `_toxicity` string, `_n` string, `_id` string"
EXTRA = ("x",) * 14


def words(rng, n):
    return [rng.choice(["alpha", "beta", "Gamma", "the", "of", "é", "omega,", "12", "x-y"]) + str(rng.randrange(40)) for _ in range(n)]


def rows():
    rng = random.Random(4)
    base = words(rng, 120)
    near = [*base[:60], "changed", *base[61:]]
    passage = words(rng, 60)
    texts = [
        (0, " ".join(base)), (1, " ".join(near)), (2, " ".join(base).upper()), (3, None), (4, ""), (5, " \t\n "), (6, "one two"), (7, "One two"), (7, "one  two"),
        (8, " ".join(words(rng, 30) + passage)), (9, " ".join(passage + words(rng, 30))), (10, " ".join(passage)), (None, " ".join(passage)), (None, None), (11, "w " * 30000), (12, "z" * 70000),
        (13, "ÄÖ <|endoftext|> \x1c\xa0 emoji 😀 <|startoftext|>x"), (14, "\n".join(["same line here"] * 9)), (15, "### $$$ %%% " * 20), (16, " ".join(words(rng, 9000))),
    ]
    texts += [(20, "again and again it says")] * 3
    texts += [(21 + k, " ".join(words(rng, rng.randrange(5, 200)))) for k in range(30)]
    return [(i, t, "en", None if k % 7 == 0 else f"s{k % 5}", len(t or ""), *EXTRA) for k, (i, t) in enumerate(texts)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return (text or "").encode().lower()


def split(text):
    return (text or "").encode().split()


def by_pair(found, *columns):
    """Rows of a result as a sorted list of tuples, None first."""
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=lambda r: tuple((x is not None, x) for x in r))
