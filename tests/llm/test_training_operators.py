import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemlab.llm import exact_dedup, lm_scoring, minhash_dedup, mixing, packing, quality, sharding, substring_dedup, token_counts, toxicity
from tandemlab.llm.queries import tokenizer_path

from corpus import EXTRA, by_pair, empty, frame, lowered, rows, split


def order(r):
    return tuple((x is not None, x) for x in r)


# ---- sharding


def test_shards_are_near_equal_and_gapless(spark):
    found = sharding.shard(frame(spark), 4).collect()
    assert sorted((r.doc_id is not None, r.doc_id, r.size, r.text_crc32) for r in found) == sorted(
        (i is not None, i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows()
    )
    places = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.virtual_slot, *order((r.doc_id, r.size, r.text_crc32, r.copy)))):
        places[r.shard].append(r.slot)
    # by virtual slot, then id, size, checksum and copy
    assert all(v == list(range(len(v))) for v in places.values())
    assert sharding.shard(empty(spark), 4).count() == 0


def test_loads_of_shards(spark):
    """bytes near equal: the gap between the fullest and the emptiest shard is under the least record."""
    data = [(k, "x" * (k * 37 % 900), "en", "s", 0, *EXTRA) for k in range(3000)]
    loads = Counter()
    for r in sharding.shard(frame(spark, data), 7).collect():
        loads[r.shard] += r.size
    assert len(loads) == 7 and max(loads.values()) - min(loads.values()) <= 8


def test_repeated_rows_spread_over_slots(spark):
    found = sharding.shard(spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text")), 3)
    assert {r[1] for r in found.groupBy("shard").count().collect()} == {1000}


def test_map_versions_and_growth(spark, tmp_path):
    old = sharding.initial_map(3, 12)
    new = sharding.rebalance(old, [9, 1, 1] * 4, [1] * 12)
    assert new.version == 2 and max(new.loads()) - min(new.loads()) <= 8 < 32
    grown = sharding.grow(new)
    assert grown.n_shards == 4 and all(b in (a, 3) for a, b in zip(new.owner, grown.owner, strict=True)) and 3 in grown.owner
    for version in (new, grown):
        sharding.store_map(spark, version, str(tmp_path / "map"))
    assert sharding.load_map(spark, str(tmp_path / "map")) == grown
    assert sharding.load_map(spark, str(tmp_path / "map"), 2) == new
    with pytest.raises(ValueError):
        sharding.store_map(spark, grown, str(tmp_path / "map"))


def test_a_second_run_edits_the_stored_map(spark, tmp_path):
    """Only records of slots that the new version gives another shard move."""
    path = str(tmp_path / "map")
    data = [(k, "x" * (k * 37 % 900), "en", "s", 0, *EXTRA) for k in range(1500)]
    first = {r.doc_id: (r.virtual_slot, r.shard) for r in sharding.shard(frame(spark, data[:1200]), 5, n_slots=64, map_path=path).collect()}
    second = {r.doc_id: (r.virtual_slot, r.shard, r.map_version) for r in sharding.shard(frame(spark, data), 5, n_slots=64, map_path=path).collect()}
    old, new = sharding.load_map(spark, path, 2), sharding.load_map(spark, path)
    assert new.version == 3 and {v for *_, v in second.values()} == {3}
    moved = {v for v in range(64) if old.owner[v] != new.owner[v]}
    assert 0 < len(moved) < 32
    for k, (slot, shard) in first.items():
        assert second[k][0] == slot and (second[k][1] != shard) == (slot in moved) and shard == old.owner[slot]
    assert new.loads() == [sum(len(t) + 8 for k, t, *_ in data if second[k][1] == s) for s in range(5)]
    with pytest.raises(ValueError):
        sharding.shard(frame(spark, data), 6, n_slots=64, map_path=path)


def test_write_shards_keeps_every_row(spark, tmp_path):
    data = rows()
    data += [(1000, "same", "en", s, 0, *EXTRA) for s in ("a", "b", None, "b")]
    docs = frame(spark, data)
    placed = sharding.shard(docs, 4)
    assert sharding.write_shards(docs, placed, str(tmp_path / "out")) == "_shard"
    found = spark.read.parquet(str(tmp_path / "out"))
    assert by_pair(found, *docs.columns) == by_pair(docs, *docs.columns)
    want = Counter((r.doc_id, r.text_crc32, r.shard) for r in placed.collect())
    assert Counter((r.doc_id, zlib.crc32((r.text or "").encode()), r["_shard"]) for r in found.collect()) == want
    plain = docs.drop("shard")
    assert sharding.write_shards(plain, placed, str(tmp_path / "plain")) == "shard"
    assert sharding.write_shards(empty(spark), sharding.shard(empty(spark), 4), str(tmp_path / "none")) == "_shard"


# ---- mixing


def targets_by_loop(sizes):
    total, left = sum(sizes.values()), dict(sizes)
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    out = {}
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        full = [s for s in left if level * weight[s] > 3 * sizes[s]]
        if not full:
            out.update({s: level * weight[s] for s in left})
            break
        for s in full:
            out[s] = 3.0 * left.pop(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, "c": 3, None: 90, "d": 0}, {"a": 1}, {"a": 100, "b": 100, "c": 100, "d": 1}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(table).collect()}
    assert found == pytest.approx(targets_by_loop(sizes))


def mixed_by_loop(rows):
    """rows: (doc_id, size, source, text digest). Copies by id, with wants found by bisection."""
    import hashlib

    size_of = defaultdict(int)
    for _, n, s, _ in rows:
        size_of[s] += n
    target, out = targets_by_loop(dict(size_of)), {}
    for source, t in target.items():
        own = [(i, n, d) for i, n, s, d in rows if s == source]
        wanted = lambda c: sum(min(c * n.bit_length(), 3.0) * n for _, n, _ in own)
        low, high = 0.0, 3.0
        for _ in range(200):
            low, high = ((low + high) / 2, high) if wanted((low + high) / 2) < t else (low, (low + high) / 2)
        whole = {i: math.floor(min(high * n.bit_length(), 3.0) + 1e-9) for i, n, _ in own}
        ranked = []
        for i, n, d in own:
            f = min(high * n.bit_length(), 3.0) - whole[i]
            if f > 1e-9:
                u = (int(hashlib.md5(f"17:{i}:{d}:0".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranked.append((u / (1 - u) / (f / (1 - f)), i, n))
        rest, taken = t - sum(whole[i] * n for i, n, _ in own), set()
        for turn in (1, 2):
            words, open_now = 0, rest
            for _, i, n in sorted(ranked):
                if i in taken or (turn == 2 and n > open_now):
                    continue
                if words + n > open_now:
                    break
                words += n
                taken.add(i)
            rest -= words
        out.update({i: whole[i] + (i in taken) for i, _, _ in own})
    return out, target


def test_mix_is_pareto_order_sampling(spark, monkeypatch):
    import hashlib

    rng = np.random.default_rng(8)
    data = [(k, " ".join(["w"] * int(1 + rng.pareto(1.1) * 9)), "en", f"s{k % 3}" if k % 11 else None, 0, *EXTRA) for k in range(1500)]
    monkeypatch.setattr(mixing, "BINS", 8)
    first, second = (mixing.mix(frame(spark, data)).collect() for _ in range(2))
    assert sorted(map(str, first)) == sorted(map(str, second)) and len(first) == 1500
    size = {k: len(t.split()) for k, t, *_ in data}
    want, target = mixed_by_loop([(k, size[k], s, hashlib.md5(t.encode()).hexdigest()) for k, t, _, s, *_ in data])
    assert {r.doc_id: r.copies for r in first} == want
    taken = Counter()
    for r in first:
        assert r.size == size[r.doc_id] and r.taken == r.copies * r.size <= 3 * r.size and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())


def test_long_documents_come_oftener(spark):
    """Inclusion probabilities differ within a source, and the sample keeps to them."""
    data = [(k, " ".join(["w"] * (3 if k % 2 else 60)), "en", "ab"[k % 5 == 0], 0, *EXTRA) for k in range(4000)]
    found = mixing.mix(frame(spark, data)).where("source = 'a'").groupBy("size").agg(F.avg("copies").alias("copies")).collect()
    by_size = {r["size"]: r.copies for r in found}
    assert by_size[60] / by_size[3] == pytest.approx(6 / 2, rel=0.1)


def test_mixed_documents(spark):
    docs = frame(spark)
    plan = mixing.mix(docs).groupBy("doc_id", "text_crc32").agg(F.sum("copies").alias("n")).collect()
    found = Counter((r.doc_id, zlib.crc32((r.text or "").encode())) for r in mixing.mixed_documents(docs).collect())
    assert found == Counter({(r.doc_id, r.text_crc32): r.n for r in plan if r.n})
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(empty(spark)).count() == 0 == mixing.mixed_documents(empty(spark)).count()


# ---- quality


def test_ledger_measures(spark):
    found = quality.quality_columns(frame(spark)).collect()
    assert len(found) == len(rows())
    want = []
    for i, t, *_ in rows():
        w = split(t)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        twice = {x for x, n in Counter(windows).items() if n > 1}
        covered = {k + j for k, x in enumerate(windows) if x in twice for j in range(5)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        want.append((i, len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)))
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found]
    assert sorted(got, key=order) == sorted(want, key=order)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept <= (not r.base_failed) for r in found)


def test_policies_and_ablation(spark):
    table = quality.quality_columns(frame(spark))
    policy = quality.POLICIES[2]
    bits = [r.failed & policy.mask for r in table.collect()]
    found = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(table, policy).collect()}
    assert found == {name: (sum(bool(b & bit) for b in bits), bits.count(bit)) for name, bit in quality.BIT.items()}
    kept = quality.keep_documents(frame(spark))
    assert kept.columns == frame(spark).columns and kept.count() == sum(r.kept for r in table.collect())
    assert quality.quality_columns(empty(spark)).count() == 0


# ---- token counts


def test_counts_equal_the_library(spark):
    path = tokenizer_path("word_bpe_49k.json")
    encoder = token_counts.tokenizer(path)
    found = token_counts.with_token_counts(frame(spark), path).select("doc_id", "__tokens.*").collect()
    want = [(i, len((t or "").encode()), len(encoder.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows()]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in found), key=order) == sorted(want, key=order)
    assert max(r.n_chunks for r in found) > 1


def test_resynchronisation_widens_where_no_space_is():
    encoder = token_counts.tokenizer(tokenizer_path("word_bpe_49k.json"))
    encode = lambda s: encoder.encode(s, add_special_tokens=False)
    rng = np.random.default_rng(1)
    alphabet = ["a", "é", " ", "\n", "'s", "1", "!?", "<|endoftext|>", "́", "İ", "中", "x" * 30, " "]
    for _ in range(300):
        text = "".join(rng.choice(alphabet, rng.integers(1, 90)))
        for chunk, overlap in ((16, 4), (40, 12)):
            assert token_counts.resynchronised(encode, text, chunk, overlap)[0] == encode(text).ids


def test_remembered_counts_equal_the_library():
    path = tokenizer_path("word_bpe_49k.json")
    encoder = token_counts.tokenizer(path)
    rng = np.random.default_rng(2)
    alphabet = ["a", "é", " ", " ", "\n", "'s", "1", "!?", "<|endoftext|>", "\u0301", "İ", "中", "x" * 30, "\xa0", "\x1c", "\t"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 25))) for _ in range(4000)]
    found, memory = [], {}
    for at in range(0, len(texts), 500):
        found += token_counts.count_tokens(encoder, texts[at : at + 500], memory=memory)
    assert [n for n, _ in found] == [len(encoder.encode(t, add_special_tokens=False).ids) for t in texts]
    with pytest.raises(ValueError):
        token_counts.count_tokens(token_counts.tokenizer(tokenizer_path("byte_bpe_50k.json")), ["a b"])


# ---- exact dedup


def test_equal_texts(spark):
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[lowered(t)].append(i)
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: i != keep)):
            want.append((i, keep, len(ids), k == 0, hashlib.sha256(text).hexdigest()))
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for first_digit in (1, 64):
        assert by_pair(exact_dedup.equal_texts(frame(spark), first_digit=first_digit), *columns) == sorted(want, key=order)
    kept = exact_dedup.drop_copies(frame(spark))
    assert kept.count() == len(groups) and kept.columns == frame(spark).columns
    assert exact_dedup.equal_texts(empty(spark)).count() == 0


# ---- substring dedup


def stripped_by_windows(data):
    last, first, out = 1 << 63, {}, []
    for i, t, *_ in data:
        w = split(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, last), last if i is None else i)
    for i, t, *_ in data:
        w = split(t)
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < (last if i is None else i) for j in range(50)}
        left = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(left), b" ".join(left).decode()))
    return sorted(out, key=order)


def passages():
    """A passage in many documents, between words of their own, copies of some, and lines and words repeated over and over in two documents each."""
    rng = np.random.default_rng(6)
    passage = [f"p{k}" for k in range(70)]
    texts = [" ".join([*(f"a{i}_{k}" for k in range(rng.integers(0, 80))), *passage[: rng.integers(40, 71)], *(f"b{i}_{k}" for k in range(rng.integers(0, 80)))]) for i in range(60)]
    texts += texts[:12] + ["one line of seven words is repeated\n" * 300, "before " + "one line of seven words is repeated\n" * 200, "w " * 500, "x " + "w " * 400]
    return [(i, t, "en", "s", 0, *EXTRA) for i, t in enumerate(texts)]


@pytest.mark.parametrize("bucket", [substring_dedup.BUCKET, 3, 1])
@pytest.mark.parametrize("data", [rows(), passages()], ids=["awkward", "passages"])
def test_repeated_passages_go(spark, data, bucket):
    want = stripped_by_windows(data)
    assert by_pair(substring_dedup.strip_repeats(frame(spark, data), bucket=bucket), "doc_id", "n_words", "n_kept", "kept_text") == want
    assert any(n != k for _, n, k, _ in want)


def test_nothing_to_strip(spark):
    assert substring_dedup.strip_repeats(empty(spark)).count() == 0


def test_packed_strings_are_bounded():
    for words in (np.full(30_000, 7, np.uint64), np.tile(np.arange(10, dtype=np.uint64), 3000), np.arange(5000, dtype=np.uint64)):
        starts, least = substring_dedup.super_kmers(words)
        assert np.diff(starts).max() <= substring_dedup.LONGEST and starts[-1] == len(words) - 49 and len(least) == len(starts) - 1


# ---- near dedup


def linked_components(data, size, percent=80):
    sets = []
    for _, t, *_ in data:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, *_) in enumerate(data):
        least[root(k)].append(i)
    return [(data[k][0], len(sets[k]), min((i for i in least[root(k)] if i is not None), default=None)) for k in range(len(data))]


def near_family(n):
    """A template and copies with more and more words changed: some link, some don't, some through others."""
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(150)]
    out = []
    for i in range(n):
        w = list(base)
        for at in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            w[at] = f"c{i}_{at}"
        out.append((i, " ".join(w), "en", "s", 0, *EXTRA))
    return out


@pytest.mark.parametrize("data", [rows(), near_family(60)], ids=["awkward", "family"])
def test_near_duplicates(spark, data, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    found = by_pair(minhash_dedup.near_duplicates(frame(spark, data), shingle=4), "doc_id", "n_shingles", "component_id")
    assert found == sorted(linked_components(data, 4), key=order)


def test_low_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        minhash_dedup.near_duplicates(frame(spark), percent=60)


def test_recall_against_brute_force(spark):
    """Documents with an id divisible by 50 against all documents, on whole sets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    least = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert true_links_found([(r.doc_id, r.text) for r in docs.collect()], least, 50) == 1.0


def true_links_found(data, component, every):
    holders, sizes, sets = defaultdict(list), {}, {}
    for i, t in data:
        w = lowered(t).split()
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sizes[i] = len(own)
        if i % every == 0:
            sets[i] = own
        for g in own:
            holders[g].append(i)
    found = links = 0
    for i, own in sets.items():
        both = Counter(j for g in own for j in holders[g] if j != i)
        near = [j for j, n in both.items() if 100 * n >= 80 * (len(own) + sizes[j] - n)]
        links += len(near)
        found += sum(component[i] == component[j] for j in near)
    return found / links if links else 1.0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = {r.node: r.root for r in minhash_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_keep_one(spark):
    docs = frame(spark)
    kept = minhash_dedup.keep_one(docs, shingle=4)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 0 in ids and 1 not in ids and ids.count(20) == 1 and ids.count(7) == 0 and 6 in ids
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0


# ---- language model


def test_lattice_sums_all_segmentations():
    pieces = {"▁": math.log(0.1), "▁a": math.log(0.2), "a": math.log(0.15), "b": math.log(0.05), "ab": math.log(0.3)}
    model = lm_scoring.Lattice(pieces, [math.log(0.01)] * 256, 0.0)

    def total(text):
        return 1.0 if not text else sum(math.exp(s) * total(text[len(p) :]) for p, s in pieces.items() if text.startswith(p))

    for word in ("a", "ab", "aab", "abab"):
        assert math.exp(model.log_marginal(word)) == pytest.approx(total("▁" + word))
    assert model.log_marginal("c") == pytest.approx(math.log(0.1) + math.log(0.01))
    many = ["ab", "c", "a", "abab", "éa", "", "b" * 300]
    assert model.log_marginals(many) == pytest.approx([model.log_marginal(w) for w in many])


def test_expected_uses_of_all_segmentations():
    pieces = {"▁": 0.1, "▁a": 0.2, "a": 0.15, "b": 0.05, "ab": 0.3}
    model = lm_scoring.Lattice({p: math.log(s) for p, s in pieces.items()}, [math.log(0.01)] * 256, 0.0)

    def segmentations(text):
        if not text:
            yield 1.0, []
        for p, s in [*pieces.items(), *([(text[0], 0.01 ** len(text[0].encode()))] if text and text[0] not in pieces else [])]:
            if text.startswith(p):
                for q, rest in segmentations(text[len(p) :]):
                    yield s * q, [p, *rest]

    words, counts = ["ab", "aab", "cé", "b", "abab"], np.array([3.0, 1, 2, 5, 1])
    want, spelt = Counter(), Counter()
    for word, n in zip(words, counts, strict=True):
        ways = list(segmentations("▁" + word))
        for q, used in ways:
            for p in used:
                share = n * q / sum(x for x, _ in ways)
                if p in pieces:
                    want[p] += share
                else:
                    spelt.update({b: share for b in p.encode()})
    uses, bytes_ = model.expected(words, counts)
    assert dict(zip(model.names, uses, strict=True)) == {p: pytest.approx(want[p]) for p in pieces}
    assert {b: v for b, v in enumerate(bytes_) if v} == {b: pytest.approx(v) for b, v in spelt.items()}


def test_rounds_raise_the_likelihood(spark, monkeypatch):
    """Of training documents, and of held-out ones as well."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    means = []
    for rounds in (0, 2):
        monkeypatch.setattr(lm_scoring, "ROUNDS", rounds)
        found = lm_scoring.score(docs, tokenizer_path("piece_bpe_32k.model"))
        means.append({r.held_out: r.mean for r in found.groupBy("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("mean")).collect()})
    assert means[1][False] > means[0][False] and means[1][True] > means[0][True], means


def score_by_segmentations(text, held):
    """log10 of the probability summed over all segmentations, from the uses of pieces in training words."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    uses, ends = Counter(), 0
    for i, t, *_ in rows():
        if not held(i):
            ends += 1
            for w in lm_scoring.words_of(t):
                uses.update(model.encode(w.decode()))
    known = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k))]
    total = sum(uses[k] for k in known) + ends + 0.5 * (len(known) + 1)
    share = {model.id_to_piece(k): (uses[k] + 0.5) / total for k in known}

    def summed(rest):
        ways = [0.0] * len(rest) + [1.0]
        for a in reversed(range(len(rest))):
            for b in range(a + 1, len(rest) + 1):
                if rest[a:b] in share and not re.fullmatch("<0x..>", rest[a:b]):
                    ways[a] += share[rest[a:b]] * ways[b]
            if rest[a] not in share:
                ways[a] += math.prod(share[f"<0x{b:02X}>"] for b in rest[a].encode()) * ways[a + 1]
        return ways[0]

    return math.log10((ends + 0.5) / total) + sum(math.log10(summed("▁" + w.decode())) for w in lm_scoring.words_of(text))


@pytest.mark.parametrize("frequent", [1 << 18, 3])
def test_scores(spark, frequent, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    monkeypatch.setattr(lm_scoring, "ROUNDS", 0)  # the pieces' uses are then those of the tokenizer
    found = lm_scoring.score(frame(spark), tokenizer_path("piece_bpe_32k.model")).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    counts = Counter()
    for i, t, *_ in rows():
        if not held(i):
            counts.update([*lm_scoring.words_of(t), b""])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, *_ in rows():
        tokens = [*lm_scoring.words_of(t), b""]
        want.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=order)
    for a, b in zip(got, sorted(want, key=order), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
    for r, text in [(r, t) for r in found for i, t, *_ in rows() if i == r.doc_id and i in (0, 3, 6, 13, 14)]:
        assert r.score == pytest.approx(score_by_segmentations(text, held))
    assert lm_scoring.score(empty(spark), tokenizer_path("piece_bpe_32k.model")).count() == 0


# ---- packing


@pytest.mark.parametrize("part", [packing.PART, 3])
def test_packing_places_each_id_once(spark, part, monkeypatch):
    monkeypatch.setattr(packing, "PART", part)
    path = tokenizer_path("byte_bpe_50k.json")
    encoder = token_counts.tokenizer(path)
    found = packing.pack_documents(frame(spark), path, 256)
    want = Counter()
    for i, t, *_ in rows():
        ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 256):
            piece = ids[at : at + 256]
            want[i, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    pieces = found.collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces) == want
    places = defaultdict(list)
    for r in pieces:
        places[r.sequence_id].append((r.offset, r.length))
    assert sorted(places) == list(range(len(places)))
    # little padding: a sequence more than the ids fill, if there are short pieces enough
    assert len(places) <= -(-sum(r.length for r in pieces) // 256) + 1
    for spans in places.values():
        spans.sort()
        assert [a for a, _ in spans] == list(np.cumsum([0, *(n for _, n in spans)])[:-1]) and sum(n for _, n in spans) <= 256
    whole = packing.sequences(frame(spark), found, path, 256).collect()
    assert len(whole) == len(places) and sum(r.n_ids for r in whole) == sum(r.length for r in pieces)
    assert all(len(r.ids) == 4 * (r.n_ids if r.n_ids & (r.n_ids - 1) == 0 else 256) for r in whole)
    assert packing.pack_documents(empty(spark), path).count() == 0


def test_cached_encoding_equals_the_library():
    encoder = token_counts.tokenizer(tokenizer_path("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    alphabet = ["a", "é", " ", " ", "\n", "\n", "'s", "12", "!?", "<|endoftext|>", "\t", "\xa0", "中", " ", "\r", "x" * 70]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 25))) for _ in range(4000)]
    found = packing.encode_texts(encoder, {}, texts)
    assert all(np.array(encoder.encode(t, add_special_tokens=False).ids, "<u4").tobytes() == f for t, f in zip(texts, found, strict=True))


def test_shortest_pack_first():
    patterns = packing.shortest_pack_first({700: 3, 300: 2, 24: 5, 1024: 1}, 1024)
    assert sum(n * times for n, p in patterns for _, times in p) == 11 and all(sum(s * times for s, times in p) <= 1024 for _, p in patterns)
    ranks = defaultdict(list)
    for size, first, end, *_ in packing.pattern_places(patterns):
        ranks[size] += range(first, end)
    assert {s: sorted(r) for s, r in ranks.items()} == {700: [0, 1, 2], 300: [0, 1], 24: [0, 1, 2, 3, 4], 1024: [0]}


def test_patterns_stay_few_and_full():
    """No more patterns than lengths, and hardly more sequences than the ids fill."""
    rng = np.random.default_rng(5)
    for sizes in (rng.integers(1, 1025, 100_000), np.minimum(1024, (rng.pareto(1, 100_000) * 40 + 1).astype(int)), np.ones(5000, int), np.full(50, 600)):
        histogram = dict(Counter(sizes.tolist()))
        patterns = packing.shortest_pack_first(histogram)
        assert len(patterns) <= 2 * len(histogram) and all(len(p) <= 45 for _, p in patterns)
        made, least = sum(n for n, _ in patterns), -(-int(sizes.sum()) // 1024)
        assert made == 50 if len(sizes) == 50 else made <= least * 1.01 + 1


# ---- toxicity


def test_chain_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    chain = toxicity.fit(docs, train)
    scored = toxicity.with_toxicity(docs, chain).join(test, "doc_id").select("toxic", F.col("_toxicity.toxic").alias("p")).collect()
    right = sum((r.p >= 0.5) == bool(r.toxic) for r in scored) / len(scored)
    clean = [r for r in scored if not r.toxic]
    assert right > 0.95 and sum(r.p >= 0.5 for r in clean) / len(clean) < 0.01
    again = toxicity.fit(docs, train)
    assert again.words == chain.words and all(np.allclose(a, b) for a, b in zip(chain.weights, again.weights, strict=True))


def test_chain_finds_toxic_documents_of_each_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.fit(docs, labels.where("doc_id % 4 <> 0"))
    p = F.col("_toxicity.toxic") >= chain.cuts[chain.categories.index("toxic")]
    scored = toxicity.with_toxicity(docs, chain).join(labels.where("doc_id % 4 = 0"), "doc_id").select("lang", "toxic", p.alias("said")).collect()
    for lang in ("en", "es", "de", "fr"):
        toxic = [r.said for r in scored if r.lang == lang and r.toxic]
        assert toxic and sum(toxic) >= 0.85 * len(toxic), (lang, sum(toxic), len(toxic))
    clean = [r.said for r in scored if not r.toxic]
    assert sum(clean) < 0.01 * len(clean)


def test_equal_documents_share_a_fold():
    """What is said of a text of which there are copies isn't learnt from them: noise stays noise."""
    rng = np.random.default_rng(0)
    texts = [b" ".join(b"w%d" % k for k in rng.choice(400, 12, replace=False)) for _ in range(60)]
    y = rng.integers(0, 2, 60).astype(float)
    chain = toxicity.fit_chain(texts * 4, np.column_stack([np.tile(y, 4)]), ("a",))
    out = []
    for fold in range(toxicity.FOLDS):
        outside = [k for k in range(240) if toxicity.crc32(texts[k % 60]) % toxicity.FOLDS != fold]
        inside = [k for k in range(60) if toxicity.crc32(texts[k]) % toxicity.FOLDS == fold]
        words, found = toxicity.numbered([texts[k % 60].split() for k in range(240)])
        rows_ = toxicity.Rows(found, len(words))
        used = np.zeros(240)
        used[outside] = 1
        w = toxicity.fit_logistic(rows_, np.zeros((240, 0)), np.tile(y, 4), used)
        out += [(w[0] + w[1:][found[k]].sum() > 0) == y[k] for k in inside]
    said = (chain.probabilities([f.tolist() for f in found[:60]])[:, 0] >= chain.cuts[0]) == y
    assert 0.25 < np.mean(out) < 0.75 and len(out) == 60 and 0 < chain.cuts[0] < 1 and len(said) == 60


def test_cut_is_the_best_f1():
    p, y = np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 0, 1, 1])
    assert toxicity.best_cut(p, y) == 0.25
    assert toxicity.best_cut(p, y * 0) == 0.5 and toxicity.best_cut(p[:0], y[:0]) == 0.5


def test_chain_edges(spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 1), (None, 0, 1), (6, 0, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(frame(spark), labels)
    scored = toxicity.with_toxicity(frame(spark), chain).select("doc_id", "__toxicity.*").collect()
    assert len(scored) == len(rows()) and all(0 <= r.toxic <= 1 for r in scored)
    none = toxicity.fit(frame(spark), labels.limit(0))
    assert toxicity.with_toxicity(empty(spark), none).count() == 0
    assert all(0 <= r[0] <= 1 for r in toxicity.with_toxicity(frame(spark), none).select("__toxicity.toxic").collect())
