"""SimHash near-duplicates: fingerprints linked at a small Hamming distance.

A text's shingles are runs of ``width`` words (all of it, if shorter), repeats
included; a fingerprint bit is set where more than half of the shingles' XXH64 hashes
have it.

Equal fingerprints are one class, so copies meet in a partial aggregate.  The distinct
fingerprints are searched with vantage-point trees.  A node has a vantage point v and a
radius m: fingerprints with d(x, v) <= m go to the inner branch, the others to the
outer one.  Two linked fingerprints have a point halfway between them, at most
``reach`` = ceil(distance / 2) bits from both; so by the triangle inequality it is
enough that every fingerprint visits the branches that its ball of ``reach`` bits
meets: inner if d <= m + reach, outer if d > m - reach.  A branch beyond these bounds is
pruned.  The first levels of the tree, fitted on a bounded sample, cut the space into
shards (a fingerprint near a boundary goes to all shards it overlaps); inside a shard a
tree of its own narrows the search to leaves, which are compared exactly.

A leaf yields the edges of a spanning forest, not all pairs, so a group of near copies
costs a linear number of rows.  Every link is tested in some leaf, hence components are
those of all links.  Fingerprints that no vantage point separates are walked from
neighbour to neighbour, taking out what has been reached.

Bounds: the tree is fitted on at most ``SAMPLE`` fingerprints (8 bytes each), any
fingerprint is indexed whatever the sample; shards grow in number with the
fingerprints (about ``SHARD_ROWS`` each, ``MAX_SHARDS`` at most).

Defined cases: a null or empty text, or one without words, has fingerprint zero and is
linked like any other; rows that share an id are one node; a null id has component
null and links nothing; repeated rows give equal rows; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmap.llm.common import attached, checkpointed, map_text, table
from riskmap.llm.jaccard_join import connected

SHINGLE = 3
DISTANCE = 2
SEED = 42
SAMPLE = 1 << 18
SHARD_ROWS = 20_000
MAX_SHARDS = 1 << 14
LEAF = 96
_ROUND = 1 << 18  # shingles whose bits are unpacked at once


def fingerprints(texts: list, width: int = SHINGLE) -> np.ndarray:
    """Fingerprint (uint64) of every text."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), dtype=np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "replace").lower().split() if text else []
        if not words:
            continue
        joined = b" ".join(words)
        stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        span = min(width, len(words))
        starts = np.concatenate([[0], stops])[:len(words) - span + 1].tolist()
        ends = (stops[span - 1:] - 1).tolist()
        n = len(starts)
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)), dtype="<u8", count=n)
        ones = np.zeros(64, dtype=np.int64)
        for k in range(0, n, _ROUND):
            part = hashes[k:k + _ROUND].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = weights[2 * ones > n].sum(dtype=np.uint64)
    return out


def distances(points: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(points ^ v).astype(np.int64)


def _searched(n: np.ndarray) -> np.ndarray:
    """Work of a branch that a tree searches on."""
    return n * np.log2(np.maximum(n, 2))


def _compared(n: np.ndarray) -> np.ndarray:
    """Work of a branch whose rows are compared with each other."""
    return n.astype(float) ** 2


def vantage(points: np.ndarray, reach: int, tries: int = 12, work=_searched) -> tuple[int, int, float]:
    """(vantage point, radius, cost): the split, of a few candidates, whose branches cause
    the least ``work``, both counted with what overlaps, as a share of the work without a
    split; cost 1 separates nothing."""
    best = (0, 0, 1.0)
    at = np.linspace(0, len(points) - 1, min(tries, len(points))).astype(np.int64)
    some = points[::max(1, len(points) // 4096)]
    for v in points[at]:
        counts = np.bincount(distances(some, v), minlength=65)
        upto = np.cumsum(counts)
        radius = np.arange(65)
        inner = upto[np.minimum(radius + reach, 64)]
        outer = len(some) - np.where(radius >= reach, upto[radius - reach], 0)
        # rows in both branches, weighed against how evenly they are cut
        cost = (work(inner) + work(outer)) / work(np.array(len(some)))
        cost[(inner == len(some)) | (outer == len(some))] = np.inf
        m = int(np.argmin(cost))
        if cost[m] < best[2]:
            best = (int(v), m, float(cost[m]))
    return best


class ShardTree:
    """The first levels of a vantage-point tree; leaves are numbered shards.  Branches are
    weighed by comparisons, so that cuts through the middle are preferred to taking off
    small groups one after the other.  Nodes lie in a list, hence a tree of any depth can
    be grown and sent: (vantage point, radius, inner node, outer node), or a shard."""

    def __init__(self, sample: np.ndarray, leaves: int, reach: int):
        self.reach, self.size = reach, 0
        self.nodes: list = [None]
        small = max(8, len(sample) // max(1, leaves))
        todo = [(0, np.unique(sample))]
        while todo:
            at, points = todo.pop()
            v, m, cost = vantage(points, reach, work=_compared) if len(points) > small else (0, 0, 1.0)
            if cost < 1.0:
                inside = distances(points, np.uint64(v)) <= m
                self.nodes[at] = (v, m, len(self.nodes), len(self.nodes) + 1)
                todo += [(len(self.nodes), points[inside]), (len(self.nodes) + 1, points[~inside])]
                self.nodes += [None, None]
            else:
                self.nodes[at] = self.size
                self.size += 1

    def shards(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in points, shard) for all shards that a point's ball overlaps."""
        rows, shards, todo = [], [], [(0, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(self.nodes[node], int):
                rows.append(at)
                shards.append(np.full(len(at), self.nodes[node], dtype=np.int32))
                continue
            v, m, inner, outer = self.nodes[node]
            d = distances(points[at], np.uint64(v))
            todo += [(inner, at[d <= m + self.reach]), (outer, at[d > m - self.reach])]
        if not rows:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        return np.concatenate(rows), np.concatenate(shards)


def _walk(points: np.ndarray, at: np.ndarray, distance: int) -> list[np.ndarray]:
    """Spanning forest of the links among ``points[at]``, by breadth-first search in which
    a point, once reached, is not compared again."""
    edges, rest = [], at
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = distances(points[rest], points[x]) <= distance
            if near.any():
                found = rest[near]
                edges.append(np.stack([np.full(len(found), x), found]))
                front.extend(found.tolist())
                rest = rest[~near]
    return edges


def forest(points: np.ndarray, distance: int = DISTANCE, leaf: int = LEAF) -> np.ndarray:
    """(2, n) places of linked distinct points whose components are those of all links."""
    reach, edges, todo = -(-distance // 2), [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) > leaf:
            v, m, cost = vantage(points[at], reach)
            if cost < 0.97:
                d = distances(points[at], np.uint64(v))
                inner, outer = at[d <= m + reach], at[d > m - reach]
                if max(len(inner), len(outer)) < len(at):
                    todo += [inner, outer]
                    continue
            edges += _walk(points, at, distance)
        elif len(at) > 1:
            near = np.bitwise_count(points[at][:, None] ^ points[at][None, :]) <= distance
            linked = np.flatnonzero(near.sum(axis=1) > 1)
            if len(linked):
                edges += _walk(points, at[linked], distance)
    return np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), dtype=np.int64)


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(_id, print): the fingerprint as a signed 64-bit number."""
    def start():
        return lambda texts: [pa.array(fingerprints(texts, width).view(np.int64))]

    return map_text(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")),
                    "_text", ["_id"], [T.StructField("print", T.LongType())], start)


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of nodes from ``classes`` (print, node; prints distinct) that span all
    links at up to ``distance`` bits."""
    spark = classes.sparkSession
    n, reach = classes.count(), -(-distance // 2)
    leaves = min(MAX_SHARDS, max(8, n // SHARD_ROWS))
    wanted = min(SAMPLE, leaves * 64)
    share = min(1.0, 1.1 * wanted / max(1, n))
    sample = (classes.select("print").where(F.pmod(F.xxhash64(F.lit("vantage"), "print"), F.lit(1 << 40)) < int(share * (1 << 40)))
              .limit(SAMPLE).toArrow().column(0).to_numpy().view(np.uint64))
    tree = spark.sparkContext.broadcast(ShardTree(sample, leaves, reach))

    def deal(batches):
        for batch in batches:
            rows, shards = tree.value.shards(batch.column(0).to_numpy().view(np.uint64))
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(shards), *taken.columns], names=["shard", "print", "node"])

    node = classes.schema["node"].dataType
    dealt = classes.select("print", "node").mapInArrow(
        deal, T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("print", T.LongType()),
                            T.StructField("node", node)]))

    def search(shard: pa.Table) -> pa.Table:
        points = shard.column("print").to_numpy().view(np.uint64)
        a, b = forest(points, distance)
        nodes = shard.column("node").combine_chunks()
        return pa.table([nodes.take(pa.array(a)), nodes.take(pa.array(b))], names=["a", "b"])

    return dealt.groupBy("shard").applyInArrow(search, T.StructType([T.StructField("a", node), T.StructField("b", node)]))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
               distance: int = DISTANCE) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id."""
    prints = checkpointed(describe(docs, id_col, text_col, width))
    known = prints.where("_id IS NOT NULL")
    classes = checkpointed(known.groupBy("print").agg(F.min("_id").alias("node"), F.count(F.lit(1)).alias("n")))
    # rows of one id with several texts are one node: their prints are linked through the id
    several = known.groupBy("_id").agg(F.min("print").alias("x"), F.max("print").alias("y")).where("x <> y").select("_id")
    through = (known.join(several, "_id").distinct().join(classes.select("print", "node"), "print")
               .select(F.col("_id").alias("a"), F.col("node").alias("b")))
    roots = connected(links(classes, distance).union(through))
    named = (classes.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
             .select("print", F.coalesce("root", "node").alias("_component"), "n"))
    return (attached(prints, named, "print", "n", ["_component"])
            .select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
                    F.when(F.col("_id").isNotNull(), F.col("_component")).alias("component_id")))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
