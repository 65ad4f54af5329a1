"""The operators of this subpackage as queries over whole tables, with the
digest columns that identify their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlab.llm import exact_dedup, lm_scoring, minhash_dedup, mixing, packing, quality, sharding, substring_dedup, token_counts, toxicity
from tandemlab.llm.common import scratch_path

N_SHARDS, OVER = 24, 2048


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; every operator takes it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map lives in the shared folder: version 1 deals the slots round robin,
    version 2 is edited to the bytes of this table."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), N_SHARDS, map_path=scratch_path(spark, "slot-map"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", "copies")


def op3_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_columns(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed", "base_failed", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(docs, tokenizer_path("word_bpe_49k.json"))
    return counted.select("doc_id", "_tokens.n_bytes", "_tokens.n_tokens", (F.col("_tokens.n_tokens") > OVER).alias("over_limit"))


def op5_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.equal_texts(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.strip_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", (F.col("n_words") - F.col("n_kept")).alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 1024)


def op10_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    cut = chain.cuts[chain.categories.index("toxic")]
    scored = toxicity.with_toxicity(docs.select("doc_id", "text"), chain)
    return scored.select(
        "doc_id", *(F.round(f"_toxicity.{c}", 6).alias(f"p_{c}") for c in chain.categories), (F.col("_toxicity.toxic") >= cut).alias("toxic")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_virtual_slots,
        op2_pareto_mix,
        op3_rule_ledger,
        op4_token_counts,
        op5_radix_dedup,
        op6_super_kmers,
        op7_minhash,
        op8_lattice_scores,
        op9_histogram_packing,
        op10_classifier_chain,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op3_rule_ledger": rf"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
measured as (
  select r, doc_id, text, w, cast(len(w) as bigint) as n_words,
    cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as bigint) as n_upper,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from docs),
windows as (
  select r, i, unnest([i, i + 1, i + 2, i + 3, i + 4]) as word_at, count(*) over (partition by r, g) as n
  from (select r, i, w[i:i + 4] as g from (select r, w, unnest(range(1, len(w) - 3)) as i from measured))),
covered as (select r, cast(count(distinct word_at) as bigint) as n_repeat_words from windows where n > 1 group by r),
rules as (
  select m.doc_id, m.n_words, m.word_chars, m.n_symbols, cast(len(l) as bigint) as n_lines,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(c.n_repeat_words, 0) as n_repeat_words, n_upper
  from measured m left join covered c using (r)),
bits as (
  select *, n_words < 10 as b0, 100 * n_repeat_words > 20 * n_words as b1, 100 * n_dup_lines > 40 * n_lines as b2,
    100 * n_symbols > 10 * n_words as b3, word_chars > 20 * n_words as b4, word_chars < 2 * n_words as b5, 100 * n_upper > 50 * word_chars as b6
  from rules)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  cast(b0::int + 2 * b1::int + 4 * b2::int + 8 * b3::int + 16 * b4::int + 32 * b5::int + 64 * b6::int as bigint) as failed,
  b0 or b1 as base_failed, not (b0 or b1 or b2 or b3 or b4 or b5 or b6) as kept
from bits""",
    "op2_pareto_mix": rf"""
with rows as (
  select doc_id, source, cast(len({_WORDS}) as bigint) as size, md5(coalesce(text, '')) as digest from documents),
sizes as (select source, cast(sum(size) as bigint) as source_size from rows group by source),
ordered as (
  select *, 3.0 * source_size as cap, [5.0, 2.0, 1.0][cast((row_number() over (order by source is null, source) - 1) % 3 + 1 as int)]::double as w from sizes),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as level
  from ordered window before as (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding)),
targets as (
  select source, source_size, least(cap, w * (select level from levels where cap / w >= level order by cap / w, source is null, source limit 1)) as target from levels),
classes as (
  select r.source, target, length(bin(size)) as g, cast(sum(size) as double) as words
  from rows r join targets t on r.source is not distinct from t.source where size > 0 group by all),
steps as (
  select *, (target - 3 * coalesce(sum(words) over above, 0)) / sum(g * words) over upto as rate
  from classes window above as (partition by source order by g desc rows between unbounded preceding and 1 preceding),
    upto as (partition by source order by g rows between unbounded preceding and current row)),
rates as (select source, arg_max(rate, g) filter (rate * g <= 3 + 1e-9) as rate from steps group by source),
wanted as (
  select r.*, source_size, target, case when size > 0 then least(3.0, rate * length(bin(size))) else 0.0 end as e
  from rows r join targets t on r.source is not distinct from t.source left join rates x on r.source is not distinct from x.source),
split as (select *, floor(e + 1e-9) as whole, case when e - floor(e + 1e-9) > 1e-9 then e - floor(e + 1e-9) end as f from wanted),
drawn as (
  select *, sum(whole * size) over (partition by source) as certain,
    (('0x' || substr(md5('17:' || doc_id || ':' || digest || ':0'), 1, 13))::bigint + 0.5) / 4503599627370496.0 as u from split),
ranked as (select *, u / (1 - u) * (1 - f) / f as q, target - certain as rest from drawn),
first as (
  select *, q is not null and size > 0 and sum(case when q is not null then size else 0 end) over (partition by source order by q nulls last, doc_id) <= rest as one from ranked),
again as (select *, rest - coalesce(sum(size) filter (one) over (partition by source), 0) as open from first),
second as (
  select *, not one and q is not null and size > 0 and size <= open
    and sum(case when not one and q is not null and size <= open then size else 0 end) over (partition by source order by q nulls last, doc_id) <= open as two from again)
select doc_id, size, source_size, round(target, 4) as target, cast((whole + one::int + two::int) * size as bigint) as taken, cast(whole + one::int + two::int as bigint) as copies
from second""",
    "op5_radix_dedup": """
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, cast(count(*) as bigint) as group_size from n group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from n join g using (t)""",
    "op6_super_kmers": rf"""
with docs as (select doc_id, {_WORDS} as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from docs)),
least as (select g, min(doc_id) as first_doc from win group by g),
gone as (select distinct doc_id, i + k as at from win join least using (g), range(0, 50) as o(k) where first_doc < doc_id),
each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as at from docs),
kept as (
  select e.doc_id, string_agg(e.word, ' ' order by e.at) as t, count(*) as n
  from each e left join gone x on x.doc_id = e.doc_id and x.at = e.at where x.at is null group by e.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from docs d left join kept k using (doc_id)""",
    "op7_minhash": rf"""
with docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from docs),
parts as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (
  select a.doc_id as a, b.doc_id as b from parts a join parts b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (with recursive r(a, b) as (select a, b from links union select r.a, l.b from r join links l on r.b = l.a) select a, min(b) as least from r group by a)
select doc_id, cast(len(s) as bigint) as n_shingles, least(doc_id, coalesce(least, doc_id)) as component_id, doc_id <= coalesce(least, doc_id) as kept
from sets left join reach on a = doc_id""",
}
