"""Merkle manifest of a dataset, with an inclusion proof for every row.

Leaves are row digests; the leaves of a group (by default, a language) form a binary
tree in the order of their ids, and the group roots form one tree above them.

Every node carries the interval [lo, hi) of leaf ranks that it covers.  The levels are
built in bands of ``BITS``: the nodes of a band that lie in one block of 2**BITS ranks
meet in one grouping, so a band is one small shuffle and no task holds more than a
block.  Paths come from the top down: a block is joined with the block above that
contains its interval (an equality of tree and level bucket, so a containment join
that never compares all nodes).  In a parent's interval, what a node's own interval
leaves over is its sibling: [parent.lo, node.lo) to the left or [node.hi, parent.hi)
to the right; nothing left over means a run of one.

Ranks come from a range sort, one count per partition on the driver, so a language
may hold any share of the rows.

Defined cases: a null in any field is written ``-``; a null language is a group of its
own, before all others; null ids come last in their group; rows that share an id are
leaves each, ordered by their digest; a lone leaf is its group's root, a lone group's
root is the root; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmap.llm.common import checkpointed, globally_ranked, table

BITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated strings."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _height(n: Column) -> Column:
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1)))


#: one level up: neighbours of the last level in pairs, a lone last one by itself
_PAIRED = """
transform(filter(sequence(0, size(element_at(built, -1)) - 1), j -> j % 2 = 0), j -> named_struct(
    'lo', get(element_at(built, -1), j).lo,
    'hi', coalesce(get(element_at(built, -1), j + 1).hi, get(element_at(built, -1), j).hi),
    'digest', sha2(concat(get(element_at(built, -1), j).digest,
                          coalesce(get(element_at(built, -1), j + 1).digest, '')), 256)))
"""
_LEVELS = f"""
aggregate(filter(sequence(1, {BITS}), k -> k <= rise),
          array(transform(members, x -> named_struct('lo', x.lo, 'hi', x.hi, 'digest', x.digest))),
          (built, k) -> concat(built, array({_PAIRED})))
"""
#: inside a band, what a parent's interval holds beside the node's own, level by level
_BAND_PATH = f"""
transform(filter(sequence(0, {BITS - 1}), k -> k < rise), k -> named_struct(
    'left', if(get(get(levels, k + 1), shiftright(place, k + 1)).lo < get(get(levels, k), shiftright(place, k)).lo,
               get(get(levels, k), shiftright(place, k) - 1).digest, ''),
    'right', if(get(get(levels, k + 1), shiftright(place, k + 1)).hi > get(get(levels, k), shiftright(place, k)).hi,
                get(get(levels, k), shiftright(place, k) + 1).digest, '')))
"""
PATH_TYPE = "array<struct<left:string,right:string>>"


def build(leaves: DataFrame) -> list[DataFrame]:
    """The bands of a forest, bottom first.  ``leaves``: start and n (first rank and
    leaf count of the tree), lo (rank), digest, and optionally a struct ``extra``."""
    nodes, bands = leaves.withColumn("hi", F.col("lo") + 1), []
    while True:
        done = BITS * len(bands)
        inside = [c for c in ("lo", "hi", "digest", "extra") if c in nodes.columns]
        band = (nodes.groupBy("start", "n", F.shiftright(F.col("lo") - F.col("start"), done + BITS).alias("block"))
                .agg(F.array_sort(F.collect_list(F.struct(*inside))).alias("members"))
                .withColumn("rise", F.least(F.lit(BITS), _height(F.col("n")) - done))
                .withColumn("levels", F.expr(_LEVELS)))
        band = checkpointed(band.withColumn("top", F.element_at("levels", -1)[0])
                            .withColumn("whole", _height(F.col("n")) <= done + BITS))
        bands.append(band)
        above = band.where(~F.col("whole"))
        if above.isEmpty():
            return bands
        nodes = above.select("start", "n", "top.lo", "top.hi", "top.digest")


def roots(bands: list[DataFrame]) -> DataFrame:
    """(start, n, digest) of every tree."""
    out = [b.where("whole").select("start", "n", "top.digest") for b in bands]
    for band in out[1:]:
        out[0] = out[0].unionByName(band)
    return out[0]


def nodes(bands: list[DataFrame]) -> DataFrame:
    """All nodes: start, level, lo, hi, digest."""
    out = None
    for s, band in enumerate(bands):
        # the top of a block is the bottom of the next band
        listed = band.select("start", "whole", F.size("levels").alias("m"), F.posexplode("levels").alias("k", "level_nodes"))
        part = (listed.where((F.col("k") < F.col("m") - 1) | F.col("whole"))
                .select("start", (F.col("k") + BITS * s).alias("level"), F.inline("level_nodes")))
        out = part if out is None else out.unionByName(part)
    return out


def paths(bands: list[DataFrame], above: DataFrame) -> DataFrame:
    """Every leaf with its siblings up to the root: start, lo, digest, [extra], path and
    the further columns of ``above`` (start, path: what lies above each tree's root)."""
    kept = [c for c in above.columns if c not in ("start", "path")]
    context = None
    for s in range(len(bands) - 1, -1, -1):
        band = bands[s].select("start", "block", "members", "rise", "levels", "top", "whole")
        placed = band.where("whole").join(above, "start")
        if context is not None:
            outer = context.select(F.col("start").alias("_start"), F.col("block").alias("_block"), "_lo", "_hi", "_levels",
                                   "_rise", F.col("path").alias("_path"), *kept)
            bucket = F.shiftright("block", BITS)
            below = (band.where("NOT whole")
                     .join(outer, (F.col("start") == F.col("_start")) & (bucket == F.col("_block"))
                           & (F.col("_lo") <= F.col("top.lo")) & (F.col("top.hi") <= F.col("_hi"))))
            place = F.col("block") - F.shiftleft(bucket, BITS)
            inner = (_BAND_PATH.replace("levels", "_levels").replace("rise", "_rise"))
            below = below.withColumn("place", place.cast("int")).withColumn("path", F.concat(F.expr(inner), "_path"))
            placed = placed.select(*band.columns, "path", *kept).unionByName(below.select(*band.columns, "path", *kept))
        if s:
            context = placed.select("start", "block", F.col("top.lo").alias("_lo"), F.col("top.hi").alias("_hi"),
                                    F.col("levels").alias("_levels"), F.col("rise").alias("_rise"), "path", *kept)
    # each leaf takes the part of its own band with it, so that the levels are not repeated
    inner = f"transform(members, (x, place) -> named_struct('leaf', x, 'inner', {_BAND_PATH}))"
    rows = placed.select("start", "path", *kept, F.inline(F.expr(inner)))
    return rows.select("start", "leaf.*", F.concat("inner", "path").alias("path"), *kept)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and its path give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def siblings(path: Column) -> Column:
    """The path's digests in one string, level by level."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def ranked_leaves(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, id, digest, extra) with their global rank ``lo`` and their tree's
    ``start`` and ``n``.  Runs of a tree inside a partition carry the join, so a tree
    with most of the rows is no hot key."""
    ranked = globally_ranked(leaves, [F.col("tree").asc_nulls_first(), F.col("id").asc_nulls_last(), F.col("digest")])
    runs = ranked.groupBy("_part", "tree").agg(F.min("_rank").alias("lo"), F.count(F.lit(1)).alias("n"))
    trees = runs.groupBy(F.col("tree").alias("t")).agg(F.min("lo").alias("start"), F.sum("n").alias("n"))
    runs = (runs.select(F.col("_part").alias("p"), "tree").join(trees, F.col("tree").eqNullSafe(F.col("t")))
            .select("p", "t", "start", "n"))
    return (ranked.join(runs, (F.col("_part") == F.col("p")) & F.col("tree").eqNullSafe(F.col("t")))
            .select("start", "n", F.col("_rank").alias("lo"), "digest", "extra"))


def manifest(leaves: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """(bands of the trees, bands of the tree over their roots, proofs).  ``leaves``: tree,
    id, digest, extra.  Proofs: one row a leaf with lo, digest, extra, path, subroot, root."""
    bands = build(ranked_leaves(leaves))
    tops = checkpointed(roots(bands))
    order = globally_ranked(tops, [F.col("start")])
    crown = build(order.select(F.lit(0).cast("long").alias("start"), F.lit(max(1, tops.count())).cast("long").alias("n"),
                               F.col("_rank").alias("lo"), "digest", F.struct(F.col("start").alias("tree_start")).alias("extra")))
    top = roots(crown).select("start", F.col("digest").alias("root"), F.array().cast(PATH_TYPE).alias("path"))
    above = checkpointed(paths(crown, top).select(F.col("extra.tree_start").alias("start"), "path",
                                                  F.col("digest").alias("subroot"), "root"))
    return bands, crown, paths(bands, above)


def prove(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = FIELDS,
          tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: id, leaf, subroot, root, proof_sha256, folded_root, verified.
    ``tampered`` gives columns other values, for the row as it is found later."""
    found = {c: (tampered or {}).get(c) for c in fields}
    own = digest(*[field(F.col(f"`{c}`")) for c in fields])
    later = digest(*[field(F.col(f"`{c}`") if found[c] is None else found[c]) for c in fields])
    changed = F.lit(False)
    for c, value in found.items():
        if value is not None:
            changed = changed | ~value.cast("string").eqNullSafe(F.col(f"`{c}`").cast("string"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{tree_col}`").alias("tree"), own.alias("digest"),
                       F.when(changed, later).alias("later"))
    rows = rows.select("tree", "id", "digest", F.struct("id", "later").alias("extra"))
    _, _, proofs = manifest(rows)
    out = proofs.select(F.col("extra.id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root",
                        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
                        folded(F.coalesce("extra.later", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    return prove(table(spark, sf_dir, "documents"), tampered={"n_chars": more})


#: CRC-32 by nibbles; trees and paths by recursion, a level a step.
ORACLE = """
WITH RECURSIVE nibbles AS (
    SELECT list(list_reduce([n::BIGINT, 0, 0, 0, 0],
        lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS t
    FROM (SELECT unnest(range(16)) AS n)),
docs AS (
    SELECT doc_id, lang, n_chars, row_number() OVER () AS id,
           concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                  coalesce(strlen(lang) || ':' || lang, '-')) AS head,
           coalesce(strlen(text) || ':' || text, '-') AS tail,
           CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(range(2 * strlen(doc_id::VARCHAR)), lambda i: CASE WHEN i % 2 = 0
                   THEN substr(doc_id::VARCHAR, (i // 2 + 1)::INT, 1)::BIGINT ELSE 3::BIGINT END)),
               lambda a, b: xor(nibbles.t[(xor(a, b) & 15) + 1], a >> 4)), 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS more
    FROM documents, nibbles),
leaves AS (
    SELECT id, doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
           sha256(head || coalesce(strlen((n_chars + more)::VARCHAR) || ':' || (n_chars + more), '-') || tail) AS found
    FROM docs),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS place,
                  count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree FROM leaves),
grown(tree, level, i, n, d) AS (
    SELECT tree, 0, place, n, leaf FROM placed
    UNION ALL
    SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(d || coalesce(follower, ''))
    FROM (SELECT *, lead(d) OVER (PARTITION BY tree ORDER BY i) AS follower FROM grown WHERE n > 1) WHERE i % 2 = 0),
subroots AS (SELECT tree, d AS subroot FROM grown WHERE n = 1),
crown(level, i, n, d) AS (
    SELECT 0, tree - 1, count(*) OVER (), subroot FROM subroots
    UNION ALL
    SELECT level + 1, i // 2, (n + 1) // 2, sha256(d || coalesce(follower, ''))
    FROM (SELECT *, lead(d) OVER (ORDER BY i) AS follower FROM crown WHERE n > 1) WHERE i % 2 = 0),
inner_paths(id, tree, level, i, n, proof, node) AS (
    SELECT id, tree, 0, place, n, '', found FROM placed
    UNION ALL
    SELECT p.id, p.tree, p.level + 1, p.i // 2, (p.n + 1) // 2, proof || coalesce(g.d, ''),
           sha256(CASE WHEN p.i % 2 = 1 THEN g.d || node ELSE node || coalesce(g.d, '') END)
    FROM inner_paths p LEFT JOIN grown g ON g.tree = p.tree AND g.level = p.level AND g.i = xor(p.i, 1) WHERE p.n > 1),
outer_paths(id, level, i, n, proof, node) AS (
    SELECT id, 0, tree - 1, (SELECT count(*) FROM subroots), proof, node FROM inner_paths WHERE n = 1
    UNION ALL
    SELECT p.id, p.level + 1, p.i // 2, (p.n + 1) // 2, proof || coalesce(g.d, ''),
           sha256(CASE WHEN p.i % 2 = 1 THEN g.d || node ELSE node || coalesce(g.d, '') END)
    FROM outer_paths p LEFT JOIN crown g ON g.level = p.level AND g.i = xor(p.i, 1) WHERE p.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM (SELECT id, proof, node FROM outer_paths WHERE n = 1) JOIN placed USING (id) JOIN subroots USING (tree),
     (SELECT d AS root FROM crown WHERE n = 1)
"""
