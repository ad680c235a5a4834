"""Importance resampling, Merkle manifest and SimHash against plain versions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmap.llm import merkle, resampling, simhash
from tests.llm import brute
from tests.llm.conftest import DOCS


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], DOCS).repartition(3)


# ---- resampling

def test_shift_and_features_match_zlib():
    rng = random.Random(5)
    sizes = np.array([0, 1, 5, 63, 64, 65, 1000, 70_001])
    head, tails = b"some head", [bytes(rng.randrange(256) for _ in range(n)) for n in sizes]
    crc = np.full(len(sizes), zlib.crc32(head), dtype=np.uint32)
    both = resampling.shift(crc, sizes) ^ np.array([zlib.crc32(t) for t in tails], dtype=np.uint32)
    assert both.tolist() == [zlib.crc32(head + t) for t in tails]
    texts = ["One two,THREE two " + "é" * 90, "", None, "x", "a " * 500 + "b" * 300 + " c"]
    crcs, owner, n_words = resampling.features(texts, 3)
    for i, t in enumerate(texts):
        w = brute.lower(t).replace(",", " ").split()
        expect = [" ".join(w[k:k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]
        assert n_words[i] == len(w)
        assert sorted(crcs[owner == i].tolist()) == sorted(zlib.crc32(f.encode()) for f in expect)


def test_resampling_equals_plain(spark, documents, texts, sf_small):
    target = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    names = ("doc_id", "n_features", "weight", "score", "rank")
    got = rows_of(resampling.resample(documents, target), *names)
    assert got == sorted(brute.resampled(list(texts.items()), [r["text"] for r in target.collect()]), key=repr)
    assert sum(r[4] is not None for r in got) > 20
    other = resampling.resample(documents, target, width=3, buckets=97, percent=50, least_words=5, seed=1)
    assert other.where("rank IS NOT NULL").count() > 50


def test_resampling_of_odd_rows(spark, odd, nothing):
    names = ("doc_id", "n_features", "weight", "score", "rank")
    target = odd.where("doc_id IN (4, 8)")
    clash = odd.withColumn("rank", F.lit("x")).withColumn("n", F.lit(1)).withColumn("_id", F.lit(2)).withColumn("_text", F.lit("y"))
    source = [(r["doc_id"], r["text"]) for r in odd.collect()]
    expect = brute.resampled(source, [r["text"] for r in target.collect()], percent=60, least=5)
    got = rows_of(resampling.resample(clash, target, percent=60, least_words=5), *names)
    assert got == sorted(expect, key=repr)
    assert resampling.resample(nothing, target).count() == 0
    assert rows_of(resampling.resample(odd, nothing), *names) == sorted(brute.resampled(source, []), key=repr)
    assert all(r["rank"] is None for r in resampling.resample(odd, target, least_words=10 ** 9).collect())


# ---- manifest

def later(row):
    i, source, lang, n, text = row
    hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
    return (i, source, lang, n + 1 if hit and n is not None else n, text)


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def tampered(docs):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.prove(docs, tampered={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})


def plain(docs):
    return sorted(brute.merkle([tuple(r) for r in docs.select(*merkle.FIELDS).collect()], later), key=repr)


@pytest.mark.parametrize("bits", [8, 2])
def test_manifest_equals_plain(spark, documents, monkeypatch, bits):
    for name in ("_LEVELS", "_BAND_PATH"):
        old = getattr(merkle, name)
        monkeypatch.setattr(merkle, name, old.replace("sequence(1, 8)", f"sequence(1, {bits})")
                            .replace("sequence(0, 7)", f"sequence(0, {bits - 1})"))
    monkeypatch.setattr(merkle, "BITS", bits)
    got = rows_of(tampered(documents), *NAMES)
    assert got == plain(documents)
    assert 0 < sum(not r[6] for r in got) < len(got) / 3


def test_manifest_of_odd_rows(spark, odd, nothing):
    clash = odd.withColumn("start", F.lit(1)).withColumn("_rank", F.lit(2)).withColumn("leaf", F.lit("x")).withColumn("id", F.lit(3))
    assert rows_of(tampered(clash), *NAMES) == plain(odd)
    assert tampered(nothing).count() == 0
    for one in (odd.where("doc_id = 8"), odd.where("doc_id IN (8, 9)"), odd.where("doc_id IN (2, 3, 6)")):
        assert rows_of(tampered(one), *NAMES) == plain(one)


def test_manifest_nodes_cover_their_children(spark):
    docs = frame(spark, [(i, f"t{i}") for i in range(300)])
    leaves = docs.select(F.lit("x").alias("tree"), F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"),
                         F.struct("doc_id").alias("extra"))
    bands, crown, _ = merkle.manifest(leaves)
    by_level = {}
    for r in merkle.nodes(bands).collect():
        by_level.setdefault(r["level"], []).append((r["lo"], r["hi"], r["digest"]))
    assert [len(by_level[k]) for k in sorted(by_level)] == [300, 150, 75, 38, 19, 10, 5, 3, 2, 1]
    for k in range(9):
        below, above = sorted(by_level[k]), sorted(by_level[k + 1])
        for i, (lo, hi, d) in enumerate(above):
            run = below[2 * i:2 * i + 2]
            assert (lo, hi) == (run[0][0], run[-1][1]) and d == brute.sha(*(x[2] for x in run))
    assert merkle.roots(crown).count() == 1


# ---- SimHash

def near(rng, base, n, bits):
    return [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits))) for _ in range(n)]


def plain_components(points, distance):
    parent = list(range(len(points)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= distance:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(points))]


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 5])
def test_forest_spans_all_links(distance):
    rng = random.Random(distance)
    points = {rng.getrandbits(64) for _ in range(300)} | set(near(rng, 0, 20, 1))
    for _ in range(60):
        points |= set(near(rng, rng.getrandbits(64), rng.randint(2, 8), 6))
    points |= set(near(rng, rng.getrandbits(64), 300, 3))
    points = sorted(points)
    array = np.array(points, dtype=np.uint64)
    expect = plain_components(points, distance)

    def merged(edges):
        parent = list(range(len(points)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i
        for a, b in edges.T.tolist():
            assert (points[a] ^ points[b]).bit_count() <= distance
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        return [root(i) for i in range(len(points))]

    edges = simhash.forest(array, distance, leaf=16)
    assert edges.shape[1] < 3 * len(points)
    assert merged(edges) == expect
    tree = simhash.ShardTree(array[::5], 8, -(-distance // 2))
    assert tree.size > 3
    rows, shards = tree.shards(array)
    found = [rows[shards == s][simhash.forest(array[rows[shards == s]], distance, leaf=16)] for s in range(tree.size)]
    assert merged(np.concatenate(found, axis=1)) == expect


def test_simhash_equals_all_pairs(documents, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.components(documents).collect()}
    assert got == brute.simhash(texts)
    wide = {r["doc_id"]: r["component_id"] for r in simhash.components(documents, width=1, distance=6).collect()}
    assert wide == {i: c for i, (_, c) in brute.simhash(texts, 1, 6).items()}


def test_fingerprints_are_those_of_the_engine(spark, documents, texts):
    """XXH64 with seed 42 is what the SQL function computes."""
    one = texts[min(i for i, t in texts.items() if t and len(t.split()) > 3)]
    words = brute.lower(one).split()
    runs = [(" ".join(words[k:k + 3]),) for k in range(len(words) - 2)]
    h = [r[0] % (1 << 64) for r in spark.createDataFrame(runs, "s string").select(F.xxhash64("s")).collect()]
    bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert int(simhash.fingerprints([one])[0]) == bits


def test_simhash_of_odd_rows(spark, odd, nothing):
    clash = odd.withColumn("print", F.lit(1)).withColumn("node", F.lit(2)).withColumn("n", F.lit(3)).withColumn("_id", F.lit(4))
    got = rows_of(simhash.components(clash), "doc_id", "fingerprint", "component_id")
    assert len(got) == 12 and rows_of(simhash.components(odd.repartition(7)), "doc_id", "fingerprint", "component_id") == got
    by_id = {}
    for i, p, c in got:
        by_id.setdefault(i, set()).add((p, c))
    assert by_id[1] == by_id[2] | {("0" * 16, 1)} == {("0" * 16, 1)} and len(by_id[4]) == 2
    assert len({c for _, c in by_id[4]}) == 1 and {c for _, c in by_id[5]} == {4} and by_id[6] == by_id[7]
    assert {c for _, c in by_id[7]} == {6} and {c for _, c in by_id[None]} == {None}
    assert simhash.components(nothing).count() == 0


def test_simhash_of_many_near_copies(spark):
    rng = random.Random(3)
    words = [f"v{rng.randrange(500)}" for _ in range(400)]
    texts = {}
    for i in range(120):
        copy = list(words)
        copy[rng.randrange(len(copy))] = f"w{i}"
        texts[i * 7 % 1009] = " ".join(copy)
    texts |= {2000 + i: "" for i in range(5)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.components(frame(spark, texts.items())).collect()}
    assert got == brute.simhash(texts)


def test_shard_tree_of_many_prints_is_shallow_and_even():
    """As many prints as a sample of three million classes gives: the tree can be grown and
    sent, and no shard holds most rows."""
    import pickle

    points = np.unique(np.random.default_rng(8).integers(0, 2**64, 10_500, dtype=np.uint64))
    tree = pickle.loads(pickle.dumps(simhash.ShardTree(points, 150, 1)))
    rows, shards = tree.shards(points)
    assert len(np.unique(rows)) == len(points)
    assert np.bincount(shards, minlength=tree.size).max() < len(points) / 20
    assert len(rows) < 10 * len(points)
