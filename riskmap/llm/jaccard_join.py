"""N-gram Jaccard join by universe-partition pigeonhole, with connected components.

A document's set holds its distinct word shingles (64-bit hashes).  Set sizes fall
into bands.  In a band, two sets with Jaccard >= theta differ in at most H shingles,
so the shingle universe is split by hash into segments whose weights add up to
H + 1 + slack: a segment of weight 1 must agree exactly, one of weight 2 up to one
shingle.  By the pigeonhole at least 1 + slack weight agrees, hence linked sets
share a signature: the hash of a segment, or of a segment with one shingle deleted.
The slack lets a set leave out signatures: first those of empty segments, which would
meet by chance, then, as far as the slack reaches, those of weight 1 that most sets have
(a shared passage, a licence line).  That is safe: of the 1 + slack segments that linked
sets agree on, the rarest has ``slack`` agreed ones before it in the order of frequency
on either side, so neither set leaves it out.  The slack and the number of segments with
deletions are chosen per band by estimated cost (signatures plus expected chance
candidates), and a share of the segments is added for common passages.  A set emits its
own band and, if it may have partners there, the next lower.

Sets that are equal form one class first.  Sets that share a signature are verified
exactly, not as all pairs: first against one centre a signature, the member whose
signatures are most widely shared, so a group of copies of one text costs a linear
number of checks.  Where the members of a centre still lie in several components, those
outside the centre's component are compared with all its members by their sketches, in
blocks of bounded size; only pairs that the sketches allow have their texts read.  Pairs
left out lie in one component already, so the components are those of all links.

Broadcasts are made behind a count of their rows, with a shuffle join beyond it.
Defined cases: documents without words have an empty set, link with nothing and are
their own component; rows that share an id are one node; a null id has component
null; repeated rows give equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmap.llm.common import checkpointed, map_text, pieces, small, table

SHINGLE = 3
THETA = 90
SLACKS = range(1, 49)
BAND_RATIO = 1.5
BLOCK_BYTES = 4 << 20       # of sketches compared with each other
TEXT_BYTES = 1 << 20        # described at once: signatures and their sorting take many times that
LISTED_BYTES = 1 << 20      # of packed signatures that become rows at once
COMMON_SHARE = 0.12         # slack for common passages, of a band's segments
SIGNATURE_BYTES = 6         # a chance meeting of two signatures is only one more check


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word):
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_sets(texts: list, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted by (text, hash), and text bounds."""
    hashes, docs = _WordHashes(), []
    out, sizes = [], []
    multiply = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
    for text in texts:
        words = text.encode("utf-8", "replace").lower().split() if text else []
        docs.append(np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words)))
    with np.errstate(over="ignore"):
        for h in docs:
            n = len(h)
            if n == 0:
                sizes.append(0)
                continue
            span = min(width, n)
            x = np.full(n - span + 1, span, dtype=np.uint64)
            for k in range(span):
                x = _mix(x + h[k:n - span + 1 + k] * multiply[k % 3])
            x = np.unique(x)
            out.append(x)
            sizes.append(len(x))
    flat = np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class Bands:
    """Bands of set sizes and the plan of each: (segments, segments with deletions, slack)."""

    def __init__(self, theta: int = THETA, counts: dict[int, int] | None = None,
                 largest: int = 1 << 34, deletions: int | None = None):
        self.theta = theta
        self.smallest = max(1, -(-theta // (100 - theta)))  # smaller sets only link with equal ones
        self.low, self.high = [], []
        lo = self.smallest
        while lo <= largest:
            hi = max(lo, int(lo * BAND_RATIO))
            self.low.append(lo)
            self.high.append(hi)
            lo = hi + 1
        self.low, self.high = np.array(self.low), np.array(self.high)
        counts = counts or {}
        self.plan = [self._allocate(int(hi), counts.get(b, 0), deletions) for b, hi in enumerate(self.high)]
        self.segments = np.array([p[0] for p in self.plan], dtype=np.int64)
        self.deleting = np.array([p[1] for p in self.plan], dtype=np.int64)
        self.slack = np.array([p[2] for p in self.plan], dtype=np.int64)

    def distance(self, hi: int) -> int:
        """Largest symmetric difference of a link whose smaller set has at most hi shingles."""
        return (hi + hi * 100 // self.theta) * (100 - self.theta) // (100 + self.theta)

    def _allocate(self, hi: int, n: int, forced: int | None) -> tuple[int, int, int]:
        best = (math.inf, 1, 0, 0)
        for slack in SLACKS:
            weight = self.distance(hi) + 1 + slack + self.common(hi)
            for deleting in range(0, min(64, weight // 2) + 1) if forced is None else [min(forced, weight // 2)]:
                m = weight - deleting
                mean = hi / m
                empty = math.exp(-mean)
                trivial = (m - deleting) * empty + deleting * (2 + mean) * empty
                # about the chance that they weigh more than the slack
                over = math.exp(min(0.0, (slack + 1) * math.log(max(trivial, 1e-300)) - math.lgamma(slack + 2)))
                cost = m + deleting * mean + n * over ** 2 * m
                if cost < best[0]:
                    best = (cost, m, deleting, slack + self.common(hi))
        return best[1:]

    def common(self, hi: int) -> int:
        """Slack that common passages may use up."""
        return int(COMMON_SHARE * (self.distance(hi) + 1) + 0.5)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """Band of each size; -1 below the smallest."""
        return np.searchsorted(self.low, sizes, side="right") - 1


def signatures(flat: np.ndarray, bounds: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, text) arrays over all texts, and per text how many signatures it may
    leave out in its own and in the next lower band.  Of a signature bit 0 says that it
    may not be left out, and bit 1 is the parity of its band."""
    sizes = np.diff(bounds)
    own = bands.of(sizes)
    least = -(-sizes * bands.theta // 100)  # the smallest partner
    sigs, docs = [], []
    allowed = np.zeros((len(sizes), 2), dtype=np.int64)
    for lower in (0, 1):
        band = own - lower
        use = (band >= 0) if lower == 0 else (band >= 0) & (least <= bands.high[np.maximum(band, 0)])
        if not use.any():
            continue
        shingle_doc = np.repeat(np.arange(len(sizes)), sizes)
        keep = use[shingle_doc]
        doc, u = shingle_doc[keep], flat[keep]
        m, k = bands.segments[np.maximum(band, 0)], bands.deleting[np.maximum(band, 0)]
        with np.errstate(over="ignore"):
            seg = (_mix(u + (band[doc].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                   % m[doc].astype(np.uint64)).astype(np.int64)
            group = (doc << 32) | seg
            order = np.argsort(group, kind="stable")
            group, u, doc, seg = group[order], u[order], doc[order], seg[order]
            first = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1]).astype(np.int64)
            total = np.add.reduceat(u, first)
            size = np.diff(np.concatenate([first, [len(u)]]))
            g_doc, g_seg = doc[first], seg[first]

            def sign(value, d, s, fixed):
                place = (band[d].astype(np.uint64) << np.uint64(40)) + s.astype(np.uint64) + np.uint64(1)
                marks = (band[d].astype(np.uint64) & np.uint64(1)) << np.uint64(1) | fixed.astype(np.uint64)
                return _mix(value * np.uint64(0xC2B2AE3D27D4EB4F) + _mix(place)) >> np.uint64(16) & ~np.uint64(3) | marks

            sigs.append(sign(total, g_doc, g_seg, g_seg < k[g_doc]))
            docs.append(g_doc)
            # segments of weight 2: also without one shingle each (a single one leaves the empty set)
            two = seg < k[doc]
            if two.any():
                of = np.repeat(np.arange(len(first)), size)[two]
                real = size[of] > 1
                sigs.append(sign(total[of][real] - u[two][real], doc[two][real], seg[two][real], real[real]))
                docs.append(doc[two][real])
            # weight of what meets the empty set; left out unless it exceeds the slack
            filled = np.bincount(g_doc, minlength=len(sizes))
            filled_two = np.bincount(g_doc[g_seg < k[g_doc]], minlength=len(sizes))
            lone = np.bincount(g_doc[(g_seg < k[g_doc]) & (size == 1)], minlength=len(sizes))
            weight = (m - filled) + (k - filled_two) + lone
            allowed[use, lower] = np.maximum(0, bands.slack[np.maximum(band, 0)] - weight)[use]
            for d in np.flatnonzero(use & (weight > bands.slack[np.maximum(band, 0)])):
                mine = (g_doc == d)
                meets = np.ones(m[d], dtype=bool)
                meets[g_seg[mine & ~((g_seg < k[d]) & (size == 1))]] = False
                s = np.flatnonzero(meets)
                sigs.append(sign(np.zeros(len(s), dtype=np.uint64), np.full(len(s), d), s, np.ones(len(s), dtype=bool)))
                docs.append(np.full(len(s), d))
    if not sigs:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), allowed
    return np.concatenate(sigs), np.concatenate(docs), allowed


def _describe(bands: Bands, width: int):
    def start():
        def fn(texts):
            flat, bounds = shingle_sets(texts, width)
            sizes = np.diff(bounds)
            sigs, docs, allowed = signatures(flat, bounds, bands)
            parity = bands.of(sizes) & 1
            order = np.argsort(docs, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=len(texts)))]).astype(np.int64)
            packed = sigs[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIGNATURE_BYTES]
            cells = counters(sizes)
            shift = (64 - np.log2(cells)).astype(np.uint64)
            base = np.concatenate([[0], np.cumsum(cells)])
            cell = np.repeat(base[:-1], sizes) + (flat >> np.repeat(shift, sizes)).astype(np.int64)
            sketch = np.minimum(np.bincount(cell, minlength=base[-1]), 65535).astype(np.uint16)
            digest = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds, bounds[1:])]
            return [sizes.tolist(), digest,
                    [packed[a:b].tobytes() for a, b in zip(offsets, offsets[1:])],
                    [sketch[a:b].tobytes() for a, b in zip(base, base[1:])],
                    # by the parity of the band
                    np.where(parity == 0, allowed[:, 0], allowed[:, 1]).tolist(),
                    np.where(parity == 0, allowed[:, 1], allowed[:, 0]).tolist()]
        return fn

    return [T.StructField("_n", T.LongType()), T.StructField("_digest", T.BinaryType()),
            T.StructField("_sigs", T.BinaryType()), T.StructField("_sketch", T.BinaryType()),
            T.StructField("_even", T.IntegerType()), T.StructField("_odd", T.IntegerType())], start


def counters(sizes: np.ndarray) -> np.ndarray:
    """Counters of a set's sketch: a power of two, about one for eight shingles."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(sizes, 1) / 8)), 6, 14).astype(np.int64)


def sketch_distance(x: np.ndarray, y: np.ndarray) -> int:
    """L1 distance of two sketches, the finer one folded: a lower bound of the
    symmetric difference of the sets (counters are cells of the hash range)."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    y = np.minimum(y.reshape(len(x), -1).sum(axis=1), 65535)
    return int(np.abs(x - y).sum())


def _near(theta: int):
    """Pairs that the sketches do not rule out."""
    def run(batches):
        for batch in batches:
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            most = total * (100 - theta) // (100 + theta)
            ok = [sketch_distance(*(np.frombuffer(v, dtype=np.uint16).astype(np.int64) for v in p)) <= d
                  for p, d in zip(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()), most)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _linked(theta: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= theta * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _compare_blocks(theta: int):
    """Pairs of outsiders and members of one pair of blocks, of different components,
    that sizes and sketches do not rule out."""
    def run(rows):
        import pandas as pd

        members, outside = rows[rows["role"] == 1], rows[rows["role"] == 0]
        found: dict[str, list] = {"a": [], "b": []}
        lengths = members["_sketch"].map(len).to_numpy()
        groups = {}
        for n in np.unique(lengths):
            mine = members[lengths == n]
            groups[n // 2] = (np.stack([np.frombuffer(x, dtype=np.uint16) for x in mine["_sketch"]]).astype(np.int32),
                              mine["_id"].to_numpy(), mine["_n"].to_numpy(), mine["comp"].to_numpy())
        folded: dict = {}
        for i, comp, n, x in zip(outside["_id"], outside["comp"], outside["_n"], outside["_sketch"]):
            x = np.frombuffer(x, dtype=np.uint16).astype(np.int32)
            for cells, (table, ids, sizes, comps) in groups.items():
                least = min(cells, len(x))
                if (cells, least) not in folded:
                    folded[cells, least] = np.minimum(table.reshape(len(table), least, -1).sum(axis=2), 65535)
                mine = np.minimum(x.reshape(least, -1).sum(axis=1), 65535)
                may = np.flatnonzero((100 * n >= theta * sizes) & (100 * sizes >= theta * n) & (comps != comp))
                if not len(may):
                    continue
                apart = np.abs(folded[cells, least][may] - mine).sum(axis=1)
                for j in may[apart <= (n + sizes[may]) * (100 - theta) // (100 + theta)]:
                    found["a"].append(min(i, ids[j]))
                    found["b"].append(max(i, ids[j]))
        return pd.DataFrame(found)
    return run


class _Verifier:
    """Exact checks of class representatives."""

    def __init__(self, docs: DataFrame, known: DataFrame, width: int, theta: int):
        self.docs, self.known, self.width, self.theta = docs, known, width, theta
        kind = known.schema["_id"].dataType
        self.schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def sets(self, needed: DataFrame) -> DataFrame:
        """(_id, set) of the ids in ``needed``, from their texts."""
        width = self.width

        def start():
            def fn(texts):
                flat, bounds = shingle_sets(texts, width)
                return [[flat[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]]
            return fn

        texts = self.docs.join(small(checkpointed(needed.distinct())), "_id", "left_semi")
        return map_text(texts, "_text", ["_id"], [T.StructField("set", T.BinaryType())], start)

    def links(self, pairs: DataFrame) -> DataFrame:
        """The linked pairs among candidates (a, b)."""
        facts = self.known.select("_id", "_n", "_sketch")
        n, m = F.col("x._n"), F.col("y._n")
        near = checkpointed(
            pairs.join(facts.alias("x"), F.col("a") == F.col("x._id"))
            .join(facts.alias("y"), F.col("b") == F.col("y._id"))
            .where((n * 100 >= m * self.theta) & (m * 100 >= n * self.theta))
            .select("a", "b", n.alias("n"), m.alias("m"), F.col("x._sketch").alias("p"), F.col("y._sketch").alias("q"))
            .mapInArrow(_near(self.theta), self.schema))
        sets = checkpointed(self.sets(near.select(F.col("a").alias("_id")).union(near.select("b"))))
        full = (near.join(sets.select(F.col("_id").alias("a"), F.col("set").alias("x")), "a")
                .join(sets.select(F.col("_id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y"))
        return full.mapInArrow(_linked(self.theta), self.schema).distinct()

    def block_links(self, rows: DataFrame) -> DataFrame:
        """Links between different components among the members (centre, _id, comp) of
        each centre that involve a member outside the centre's own component."""
        rows = rows.join(self.known.select("_id", "_n", "_sketch"), "_id")
        main = rows.where("_id = centre").select("centre", F.col("comp").alias("main"))
        parts = rows.groupBy("centre").agg(F.ceil(F.sum(F.length("_sketch")) / BLOCK_BYTES).cast("int").alias("parts"))
        rows = rows.join(main, "centre").join(parts, "centre").select(
            "centre", "_id", "comp", "_n", "_sketch", "parts", F.pmod(F.xxhash64("_id"), F.col("parts")).cast("int").alias("part"),
            (F.col("comp") != F.col("main")).alias("outside"))
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        kept = ["_id", "comp", "_n", "_sketch"]
        as_member = rows.select("centre", every.alias("i"), F.col("part").alias("j"), F.lit(1).alias("role"), *kept)
        as_outsider = rows.where("outside").select("centre", F.col("part").alias("i"), every.alias("j"), F.lit(0).alias("role"), *kept)
        near = (as_member.unionByName(as_outsider).groupBy("centre", "i", "j")
                .applyInPandas(_compare_blocks(self.theta), self.schema).distinct())
        return self.links(checkpointed(near))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, by large-star and small-star rounds.
    Nodes without an edge are absent."""
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def star(e: DataFrame) -> DataFrame:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        return (moved.select("u", F.col("m").alias("v")).union(moved.select(F.col("v").alias("u"), F.col("m").alias("v")))
                .where("u <> v").distinct())

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")),
                           F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30)))).first())

    seen = mark(edges)
    while seen[0]:
        edges = checkpointed(star(edges))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def describe_documents(docs: DataFrame, theta: int, width: int, deletions: int | None) -> DataFrame:
    words = F.length("_text") - F.length(F.replace(F.col("_text"), F.lit(" "), F.lit(""))) + 1
    sizes = Bands(theta)
    edges = [int(x) for x in sizes.low]
    band = sum((words >= x).cast("int") for x in edges[:40]) - 1
    counts = {r["b"]: r["n"] for r in docs.groupBy(band.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    fields, start = _describe(Bands(theta, counts, deletions=deletions), width)
    return checkpointed(map_text(docs, "_text", ["_id"], fields, start, TEXT_BYTES))


def _unpacked(batches):
    """Batches of (_id, sig) from those of (_id, packed signatures), a bounded number of bytes at a time."""
    for batch in batches:
        for part in pieces(batch, 1, LISTED_BYTES):
            packed = part.column(1).to_pylist()
            count = np.array([len(x) // SIGNATURE_BYTES for x in packed], dtype=np.int64)
            wide = np.zeros((int(count.sum()), 8), dtype=np.uint8)
            wide[:, :SIGNATURE_BYTES] = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(-1, SIGNATURE_BYTES)
            owner = pa.array(np.repeat(np.arange(len(count)), count))
            yield pa.RecordBatch.from_arrays([part.column(0).take(owner), pa.array(wide.view("<i8").ravel())], names=["_id", "sig"])


def _listed(known: DataFrame) -> DataFrame:
    """(_id, sig), a row per signature."""
    return known.select("_id", "_sigs").mapInArrow(
        _unpacked, T.StructType([known.schema["_id"], T.StructField("sig", T.LongType())]))


def _shared(listed: DataFrame) -> DataFrame:
    """(sig, _id, n): the signatures that occur more than once.  They are dealt once, by value;
    a join with their counts would deal them a second time."""
    n = F.count(F.lit(1)).over(Window.partitionBy("sig"))
    return listed.select("sig", "_id", n.alias("n")).where("n > 1")


def candidates(known: DataFrame) -> DataFrame:
    """(sig, _id, n): the signatures that sets still share once each has left out its most
    frequent ones, and how many sets do."""
    every = _shared(_listed(known))
    odd = F.col("sig").bitwiseAND(F.lit(2)) != 0
    rows = (every.join(known.select("_id", "_even", "_odd"), "_id")
            .select("sig", "_id", F.when(odd, F.col("_odd")).otherwise(F.col("_even")).alias("allowed"),
                    F.when(F.col("sig").bitwiseAND(F.lit(1)) == 0, F.col("n")).otherwise(F.lit(0)).alias("n"), odd.alias("odd")))
    # those that may not be left out come last in the order
    place = F.row_number().over(Window.partitionBy("_id", "odd").orderBy(F.desc("n"), "sig"))
    kept = checkpointed(rows.withColumn("place", place).where("place > allowed OR n = 0").select("sig", "_id"))
    again = kept.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return checkpointed(kept.join(again, "sig").select("sig", "_id", "n"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", theta: int = THETA,
               width: int = SHINGLE, deletions: int | None = None) -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    docs = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    every = describe_documents(docs, theta, width, deletions)
    filled = every.where("_n > 0 AND _id IS NOT NULL")
    classes = checkpointed(filled.groupBy("_n", "_digest").agg(F.min("_id").alias("_class")))
    heads = small(classes.select(F.col("_class").alias("_id"), "_n", "_digest"))
    known = filled.join(heads, ["_id", "_n", "_digest"], "left_semi")
    if known.count() > classes.count():  # repeated rows: only then are the signatures moved to drop them
        known = known.dropDuplicates(["_id", "_n", "_digest"])
    members = candidates(known)
    typical = members.groupBy("_id").agg(F.sum("n").alias("typical"))
    centres = (members.select("sig", "_id").join(typical, "_id").groupBy("sig")
               .agg(F.max_by("_id", F.struct("typical", "_id")).alias("centre")))
    stars = checkpointed(members.select("sig", "_id").join(centres, "sig").select("centre", "_id").distinct())
    verify = _Verifier(docs, known, width, theta)
    links = checkpointed(verify.links(stars.where("_id <> centre").select(
        F.least("centre", "_id").alias("a"), F.greatest("centre", "_id").alias("b")).distinct()))
    roots = connected(links)
    placed = (stars.join(roots, F.col("_id") == F.col("node"), "left")
              .select("centre", "_id", F.coalesce("root", "_id").alias("comp")))
    split = placed.groupBy("centre").agg(F.min("comp").alias("x"), F.max("comp").alias("y"),
                                         F.count(F.lit(1)).alias("n")).where("x <> y AND n > 2")
    open_ = checkpointed(placed.join(split.select("centre"), "centre", "left_semi"))
    if not open_.isEmpty():
        found = checkpointed(verify.block_links(open_))
        if not found.isEmpty():
            roots = connected(links.union(found))
    named = (classes.join(roots, F.col("_class") == F.col("node"), "left")
             .select("_n", "_digest", F.coalesce("root", "_class").alias("_component")))
    return (every.select("_id", "_n", "_digest").join(named, ["_n", "_digest"], "left")
            .select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"),
                    F.when(F.col("_id").isNull() | (F.col("_n") == 0), F.col("_id"))
                    .otherwise(F.col("_component")).alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The document with the smallest id of each component, all columns untouched;
    rows with a null id stay."""
    gone = (components(docs, id_col, text_col, **options)
            .where(f"component_id <> `{id_col}`").select(F.col(id_col).alias("_gone")).distinct())
    return docs.join(small(checkpointed(gone)), F.col(f"`{id_col}`") == F.col("_gone"), "left_anti")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
