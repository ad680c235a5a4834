"""Operators that compare documents: dedup, Jaccard join, decontamination, counts, shards."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskmap.llm import decontaminate, exact_dedup, jaccard_join, language_model, sharding
from tests.llm import brute
from tests.llm.conftest import DOCS


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in texts], DOCS).repartition(3)


# ---- exact dedup

@pytest.mark.parametrize("block", [4096, 7])
def test_dedup_equals_grouping(documents, texts, block):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[brute.lower(t)].append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    rows = exact_dedup.dedup_decisions(documents, block_bytes=block).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in rows} == want and len(rows) == len(want)


def test_dedup_odd_rows(spark, odd, nothing):
    rows = exact_dedup.dedup_decisions(odd).collect()
    assert len(rows) == 12
    kept = Counter(r["text_sha256"] for r in rows if r["kept"])
    assert set(kept.values()) == {1} and set(kept) == {r["text_sha256"] for r in rows}
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["keep_id"] == 2 and by[6]["keep_id"] == 7 and by[5]["group_size"] == 3 and by[None]["kept"]
    assert exact_dedup.dedup_decisions(nothing).count() == 0
    left = exact_dedup.drop_duplicates(odd)
    assert left.columns == odd.columns and left.count() == len(kept)
    assert exact_dedup.drop_duplicates(nothing).count() == 0
    nulls = frame(spark, [(None, "x"), (None, "X"), (None, "y")])
    assert exact_dedup.drop_duplicates(nulls).count() == 2
    assert exact_dedup.dedup_decisions(odd.withColumn("name", F.lit(1)).withColumn("_sha", F.lit(2))).count() == 12


def test_dedup_key_collision_keeps_texts_apart(documents, texts, monkeypatch):
    def few(*cols):  # three keys for all blocks
        return F.pmod(F.length(cols[0]), F.lit(3)).cast("long") if cols == ("_block",) else real(*cols)
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", few)
    rows = exact_dedup.dedup_decisions(documents, block_bytes=64).collect()
    assert {r["doc_id"] for r in rows if r["kept"]} == {
        max(i for i in texts if brute.lower(texts[i]) == t) for t in {brute.lower(t) for t in texts.values()}}


# ---- Jaccard join

def test_signatures_are_dealt_once_and_in_bounded_batches(spark, monkeypatch):
    packed = [(i, b"".join((7 * i + j).to_bytes(6, "little") for j in range(20))) for i in range(40)] + [(99, b"")]
    known = spark.createDataFrame(packed, "_id long, _sigs binary").repartition(3)
    count = Counter(7 * i + j for i in range(40) for j in range(20))
    shared = jaccard_join._shared(jaccard_join._listed(known))
    got = sorted(map(tuple, shared.collect()))
    assert got == sorted((7 * i + j, i, count[7 * i + j]) for i in range(40) for j in range(20) if count[7 * i + j] > 1)
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning(sig") == 1
    monkeypatch.setattr(jaccard_join, "LISTED_BYTES", 600)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in packed]), pa.array([x for _, x in packed])], names=["_id", "_sigs"])
    out = list(jaccard_join._unpacked([batch]))
    assert max(len(x) for x in out) <= 100 and sum(len(x) for x in out) == 800
    assert [(r["_id"], r["sig"]) for x in out for r in x.to_pylist()] == [(i, 7 * i + j) for i in range(40) for j in range(20)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.mark.parametrize("theta,width,deletions", [(90, 3, None), (80, 5, None), (80, 1, 2), (90, 2, 1)])
def test_components_equal_all_pairs(spark, theta, width, deletions):
    rng = random.Random(theta + width)
    texts = {}
    for g in range(25):
        words = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([5, 9, 10, 12, 20, 21, 33, 60, 150]))]
        for _ in range(rng.choice([1, 2, 6])):
            texts[len(texts) * 3 % 1009] = edited(rng, words, rng.choice([0, 0, 1, 1, 2, 3]))
    rows = jaccard_join.components(frame(spark, list(texts.items())), theta=theta, width=width, deletions=deletions).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute.jaccard_components(texts, theta, width)


def test_components_of_a_chain_without_a_centre(spark):
    words = [f"a{i}" for i in range(60)]
    texts = {i: " ".join(words[:3] + [f"z{i}x{k}" if k < 2 * i % 7 else w for k, w in enumerate(words)]) for i in range(40)}
    texts |= {100 + i: " ".join(words[i:] + [f"t{k}" for k in range(i)]) for i in range(0, 30, 2)}
    rows = jaccard_join.components(frame(spark, list(texts.items())), theta=80, width=1).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute.jaccard_components(texts, 80, 1)


def test_signatures_meet_for_every_link():
    """The pigeonhole alone, without the join: linked sets share a signature."""
    rng = np.random.default_rng(3)
    for theta, deletions in ((90, None), (80, None), (90, 1), (80, 3)):
        bands = jaccard_join.Bands(theta, deletions=deletions)
        for n in (9, 10, 11, 12, 19, 20, 38, 39, 57, 120, 300):
            for _ in range(15):
                a = np.unique(rng.integers(1, 1 << 63, n).astype(np.uint64))
                far = len(a) * (100 - theta) // theta
                cut = rng.integers(0, far + 1)
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[:len(a) - cut]],
                                              rng.integers(1, 1 << 63, rng.integers(0, far + 1)).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both < theta * (len(a) + len(b) - both):
                    continue
                flat, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
                sigs, docs, _ = jaccard_join.signatures(flat, bounds, bands)
                assert np.array_equal(a, b) or set(sigs[docs == 0].tolist()) & set(sigs[docs == 1].tolist())


def test_components_odd_rows(spark, odd, nothing):
    rows = jaccard_join.components(odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 12 and by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[3]["component_id"] == 3
    assert by[7]["component_id"] == 6 and by[5]["component_id"] == 4 and by[None]["component_id"] is None
    assert jaccard_join.components(nothing).count() == 0
    left = jaccard_join.keep_one(odd.withColumn("root", F.lit(1)).withColumn("sig", F.lit(2)))
    assert {r["doc_id"] for r in left.collect()} == {1, 2, 3, 4, 6, 8, 9, None}


def test_connected_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {v: v for p in pairs for v in p}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v
    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = {r["node"]: r["root"] for r in jaccard_join.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: root(v) for v in parent if root(v) != v}


# ---- decontamination

@pytest.mark.parametrize("block_words", [10 ** 6, 60])
def test_contamination_equals_brute_force(spark, documents, texts, sf_small, block_words):
    bench = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    items |= {"short": "erlyea the", "one": "zzyzx", "none": "..."}
    bench = spark.createDataFrame([(str(i), t) for i, t in items.items()] + [(None, None), ("none", None)], "item_id string, text string")
    rows = decontaminate.find_contamination(documents, bench, keep=["doc_id"], block_words=block_words).collect()
    want = brute.contamination(texts, {str(i): t for i, t in items.items()})
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in rows}
    assert got == {i: (n, h, len(f), h > 0) for i, (n, h, f) in want.items()}
    assert sum(h > 0 for _, h, _ in want.values()) >= 3


def test_contamination_longest_matches(spark, odd, nothing):
    words = [f"q{i}" for i in range(40)]
    docs = frame(spark, [(1, "x y " + " ".join(words[5:25]).upper() + " z"), (2, "q1 q2"), (3, None)])
    bench = spark.createDataFrame([("a", " ".join(words))], "item_id string, text string")
    rows = {r["doc_id"]: r for r in decontaminate.find_contamination(docs, bench).collect()}
    assert [tuple(m) for m in rows[1]["matches"]] == [(2, "a", 5, 20)] and rows[1]["n_hit"] == 20
    assert not rows[2]["contaminated"] and rows[3]["n_words"] == 0
    assert [r["doc_id"] for r in decontaminate.remove_contaminated(docs, bench).orderBy("doc_id").collect()] == [2, 3]
    clash = odd.withColumn("n_hit", F.lit("x")).withColumn("row", F.lit("y"))
    left = decontaminate.remove_contaminated(clash, bench)
    assert left.columns == clash.columns and left.count() == 12
    assert decontaminate.find_contamination(clash, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_contamination(nothing, bench).count() == 0


# ---- language model

def test_language_model_base_and_mixture(documents, texts, monkeypatch):
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 50_000)
    rows = {r["doc_id"]: r for r in language_model.score_documents(documents).collect()}
    for i, (n, known, total, score) in brute.base_scores(texts).items():
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert math.isclose(r["base_score"], score, rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_probabilities(spark, monkeypatch):
    """Scores equal the formula with the learned weights, and P(.|v) adds up to one."""
    learned = {}
    real = language_model.learn_weights
    monkeypatch.setattr(language_model, "learn_weights",
                        lambda *a: learned.setdefault("w", real(*a)))
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30))) for i in range(120)}
    rows = {r["doc_id"]: r for r in language_model.score_documents(frame(spark, list(texts.items()))).collect()}
    pairs, words = brute.bigram_counts(texts)
    total, vocab, weights = sum(words.values()) - words["\0start"], len(words) - 1, learned["w"]

    def p(v, w):
        c = words[v]
        l2, l1, l0 = weights[min(math.ceil(math.log2(c + 1)), language_model.CONTEXT_BUCKETS - 1)]
        return l2 * pairs[v, w] / max(1, c) + l1 * words[w] / total + l0 / (vocab + 1)

    for i, t in texts.items():
        w = [*t.split(), "\0end"]
        assert math.isclose(rows[i]["score"], sum(math.log10(p(a, b)) for a, b in zip(["\0start", *w], w)), rel_tol=1e-9)
    for v in ("a", "\0start"):
        c = words[v]
        rest = weights[min(math.ceil(math.log2(c + 1)), 39)][2] / (vocab + 1)  # one unknown word
        assert math.isclose(sum(p(v, w) for w in words if w != "\0start") + rest, 1.0, rel_tol=1e-9)


def test_em_raises_the_likelihood():
    cells = np.array([(5 * 193 + a) * 193 + b for a in (4, 40, 192) for b in (20, 60)])
    counts = np.array([50.0, 30, 20, 10, 5, 5])
    one, many = (language_model.learn_weights(cells, counts, 1000, rounds=r)[5] for r in (1, 40))

    def likelihood(w):
        value = lambda x: np.where(x < 192, 2.0 ** (-x / 4), 0.0)
        return (counts * np.log(w[0] * value(cells // 193 % 193) + w[1] * value(cells % 193) + w[2] / 1001)).sum()
    assert likelihood(many) >= likelihood(one) - 1e-9 and math.isclose(many.sum(), 1.0)


def test_language_model_odd_rows(odd, nothing):
    rows = language_model.score_documents(odd.withColumn("score", F.lit("x")).withColumn("chunk", F.lit(1))).collect()
    assert len(rows) == 12 and all(r["n_tokens"] >= 1 and math.isfinite(r["score"]) for r in rows)
    assert language_model.score_documents(nothing).count() == 0


# ---- sharding

def test_shards_equal_the_sequential_ring(documents, texts):
    rows = sharding.shard_documents(documents).collect()
    owners = sharding.ring_owners(8, 64)
    want = brute.ring_shards(list(texts.items()), 8, owners, sharding.GRID_BITS, sharding.quotas(len(texts), 8, 1.0))
    assert {r["doc_id"]: r["shard"] for r in rows} == want
    for s in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1
               and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows)


def test_shards_balance_and_movement(spark):
    docs = frame(spark, [(i, "x") for i in range(4000)])
    exact = Counter(r["shard"] for r in sharding.shard_documents(docs, n_shards=7).collect())
    assert max(exact.values()) - min(exact.values()) <= 1
    old, new = ({r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, n_shards=n, load_factor=1.25).collect()}
                for n in (8, 9))
    assert max(Counter(old.values()).values()) <= math.ceil(1.25 * 4000 / 8)
    assert sum(old[i] != new[i] for i in old) < 0.35 * 4000  # a modulus would move 8 of 9


def test_shards_odd_rows(spark, odd, nothing):
    rows = sharding.shard_documents(odd.withColumn("shard", F.lit("x")).withColumn("cell", F.lit(1))).collect()
    assert len(rows) == 12 and {r["size"] for r in rows if r["doc_id"] == 1} == {1}
    counts = Counter(r["shard"] for r in rows)
    assert sorted(counts.values()) == [1, 1, 1, 1, 2, 2, 2, 2]
    assert sharding.shard_documents(nothing).count() == 0
    same = frame(spark, [(5, "repeated")] * 1000 + [(i, "y") for i in range(20)])
    rows = sharding.shard_documents(same).collect()
    assert len(rows) == 1020 and len({(r["shard"], r["slot"]) for r in rows}) == 1020
