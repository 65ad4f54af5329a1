import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tandemlab.llm import mixing, packing, quality, token_counts
from tandemlab.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

from corpus import lowered
from test_training_operators import linked_components

DIR = "/root/testdata/sf0.001"



@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    want = con.sql(ORACLE_SQL[name])
    found = QUERIES[name](spark, DIR).select(*want.columns)
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())


def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def test_op1_rows_and_law(spark):
    """Sizes and checksums by hand, slots gapless, and shard sizes nearer than the least record."""
    docs, found = documents(spark), QUERIES["op1_virtual_slots"](spark, DIR).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in found} == {i: (len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for i, d in docs.items()}
    assert len(found) == len(docs) and all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24 for r in found)
    slots, loads = {}, Counter()
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    # no slot that could move from the fullest shard to the emptiest would narrow the gap
    held = Counter()
    for r in found:
        held[r.shard, r.virtual_slot] += r.size
    gap, full = max(loads.values()) - min(loads.values()), max(loads, key=loads.get)
    assert not any(size < gap for (shard, _), size in held.items() if shard == full)


def test_op4_and_op9_equal_the_library(spark):
    docs = documents(spark)
    encoder = token_counts.tokenizer(tokenizer_path("word_bpe_49k.json"))
    want = {i: len(encoder.encode(d.text or "", add_special_tokens=False).ids) for i, d in docs.items()}
    found = QUERIES["op4_token_counts"](spark, DIR).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in found} == {i: (len((docs[i].text or "").encode()), n, n > 2048) for i, n in want.items()}
    encoder = token_counts.tokenizer(tokenizer_path("byte_bpe_50k.json"))
    pieces = Counter()
    for i, d in docs.items():
        ids = np.array([*encoder.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 1024):
            pieces[i, at, len(ids[at : at + 1024]), zlib.crc32(ids[at : at + 1024].tobytes()), len(ids)] += 1
    found = QUERIES["op9_histogram_packing"](spark, DIR).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == pieces
    ends = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert sorted(ends) == list(range(len(ends))) and max(ends.values()) <= 1024
    # little padding: hardly more sequences than the ids fill
    assert len(ends) <= 1.01 * sum(r.length for r in found) / 1024 + 1


def test_op8_baseline_equals_sql(spark):
    """All columns but the score; crc32 comes from Python."""
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    held = [(i, zlib.crc32(str(i).encode()) % 5 == 1) for i in documents(spark)]
    con.execute("create table held (doc_id bigint, out boolean)")
    con.executemany("insert into held values (?, ?)", held)
    want = con.sql(
        r"""with w as (select doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') as w, out from documents join held using (doc_id)),
        t as (select doc_id, out, unnest(w) as token from w), c as (select token, count(*) as c from t where not out group by token), n as (select sum(c) as n, count(*) as v from c)
        select doc_id, out, count(*) as n_tokens, count(c) as n_known, any_value(n) as train_tokens, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) as base from t left join c using (token), n group by doc_id, out"""
    ).fetchall()
    found = {r.doc_id: r for r in QUERIES["op8_lattice_scores"](spark, DIR).collect()}
    assert len(found) == len(want) and all(r.score < 0 for r in found.values())
    for i, out, n, known, train, base in want:
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, train) and abs(r.base_score - base) < 1e-6 * abs(base)


def test_op10_names_every_document_once(spark):
    found = QUERIES["op10_classifier_chain"](spark, DIR).collect()
    assert sorted(r.doc_id for r in found) == sorted(documents(spark))
    assert all(isinstance(r.toxic, bool) and all(0 <= r[f"p_{c}"] <= 1 for c in ("low_quality", "toxic", "toxic_low_quality")) for r in found)


def test_pipeline_equals_brute_force(spark):
    """Filter, exact and near dedup, and the packed ids, stage by stage."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    good = [r for r in rows if quality_ok(r[1])]
    last = {}
    for r in good:
        key = lowered(r[1])
        last[key] = max(last.get(key, r), r)
    single = sorted(last.values())
    kept = sorted(r[0] for r, (i, _, least) in zip(single, linked_components(single, 5), strict=True) if least == i)
    stage = docs
    for _, f in corpus_pipeline.STAGES[:3]:
        stage = f(spark, stage, DIR)
        assert stage.columns == docs.columns
    assert sorted(r.doc_id for r in stage.collect()) == kept
    taken = {r.doc_id: r.copies for r in mixing.mix(stage).collect()}
    encoder = token_counts.tokenizer(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for r in single:
        if taken.get(r[0]):
            ids = np.array([*encoder.encode(r[1], add_special_tokens=False).ids, 0], "<u4")
            for at in range(0, len(ids), packing.LENGTH):
                piece = ids[at : at + packing.LENGTH]
                want[r[0], at, len(piece), zlib.crc32(piece.tobytes())] += taken[r[0]]
    found = corpus_pipeline.run(spark, DIR)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in found.collect()) == want


def quality_ok(text):
    names = [part.split()[0] for part in quality.MEASURES.split(", ")]
    measured = dict(zip(names, quality.measure_text(text), strict=True))
    return not any(eval(rule, {}, measured) for _, rule in quality.RULES)


def test_pipeline_on_nothing(spark):
    none = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        none = f(spark, none, DIR)
    assert none.count() == 0
