"""Exact deduplication by deterministic block naming.

Each normalised text is cut into blocks of ``block_bytes`` bytes.  The distinct
blocks are sorted into integer names; then the names of adjacent blocks are paired
and the distinct pairs are sorted into names again, level by level, until every
document has one name.  Two texts are equal exactly when their block counts and
final names are equal.

Names are (bucket, rank in bucket) numbers: a bucket is a slice of the key space
and the rank comes from sorting the distinct blocks (or pairs) inside it, so a name
depends on the data alone, never on partitioning.  Blocks are grouped by a 64-bit
key; the block texts of a key are compared, and a key that holds several texts
gives each its own name, so a collision cannot merge documents.

Block texts are shuffled once, distinct per task; everything after that moves
integers.  Copies meet only in partial aggregates and joins that split hot keys.

Defined cases: a null text is the empty text; of equal rows that also share the id,
exactly one is kept; a null id sorts below all others (a group of null ids has
keep_id null and keeps one row); an empty table gives an empty result.  Only the id
and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskmap.llm.common import checkpointed, lower_ascii, small, table

BLOCK_BYTES = 4096
KEYS_PER_BUCKET = 100_000


def _named(keys: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """Distinct ``columns`` rows plus an integer ``name``, sorted within buckets."""
    bucket = F.pmod(F.xxhash64(*columns), F.lit(buckets))
    within = Window.partitionBy("_bucket").orderBy(*columns)
    return (keys.withColumn("_bucket", bucket)
            .withColumn("name", F.shiftleft(F.col("_bucket"), 36) + F.row_number().over(within))
            .drop("_bucket"))


def _buckets(n_rows: int) -> int:
    return max(64, n_rows // KEYS_PER_BUCKET)


def _blocks(df: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(_id, _sha, n_blocks, pos, _block).  The text is normalised, hashed and cut once per
    row, so the time is linear in its length; the whole text stays behind.  It is bound
    to a lambda's variable: as a column, the optimizer would put its expression into
    every use, and each block would be cut from a text normalised anew."""
    norm = lower_ascii(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("binary")

    def cut(text):
        n = F.greatest(F.lit(1), F.ceil(F.length(text) / block_bytes)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n - 1),
                             lambda pos: F.substring(text, pos * block_bytes + 1, F.lit(block_bytes)))
        return F.struct(F.sha2(text, 256).alias("_sha"), n.alias("n_blocks"), blocks.alias("_cut"))

    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.inline(F.transform(F.array(norm), cut)))
    return rows.select("_id", "_sha", "n_blocks", F.posexplode("_cut").alias("pos", "_block"))


def _level_zero(df: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    blocks = _blocks(df, id_col, text_col, block_bytes)
    key = F.xxhash64("_block").alias("_key")
    texts = blocks.select(key, "_block").groupBy("_key").agg(
        F.array_sort(F.collect_set("_block")).alias("_texts"))
    # the block texts stay behind, but for keys that several texts share
    keys = checkpointed(texts.select(
        "_key", F.when(F.size("_texts") > 1, F.col("_texts")).alias("_texts")))
    variants = keys.select("_key", "_texts", F.explode(F.sequence(
        F.lit(0), F.coalesce(F.size("_texts"), F.lit(1)) - 1)).alias("_variant"))
    names = _named(variants.select("_key", "_variant"), ["_key", "_variant"], _buckets(keys.count()))
    shared = keys.where(F.col("_texts").isNotNull())
    row = ["_id", "_sha", "n_blocks", "pos", key]
    if shared.isEmpty():
        rows = blocks.select(*row).withColumn("_variant", F.lit(0))
    else:  # exact: rows of a shared key compare their block with the key's texts
        rows = (blocks.select(*row, "_block").join(shared, "_key", "left")
                .withColumn("_variant", F.coalesce(F.array_position("_texts", F.col("_block")) - 1,
                                                   F.lit(0)).cast("int")))
    return (rows.select("_id", "_sha", "n_blocks", "pos", "_key", "_variant")
            .join(names, ["_key", "_variant"])
            .select("_id", "_sha", "n_blocks", "pos", "name", F.lit(1).cast("long").alias("_copies")))


def identify(df: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Distinct (_id, _sha) with its identity (n_blocks, name) and row count _copies."""
    even = F.col("pos") % 2 == 0
    row = ["_id", "_sha", "n_blocks"]
    pairs = (_level_zero(df, id_col, text_col, block_bytes)
             .groupBy(*row, F.shiftright("pos", 1).alias("pos"))
             .agg(F.max(F.when(even, F.col("name"))).alias("a"), F.max(F.when(~even, F.col("name"))).alias("b"),
                  F.sum(F.when(even, F.col("_copies"))).alias("_copies")))
    done, span = [], 1
    while True:  # one level a turn: log2 of the longest text in blocks
        pairs = checkpointed(pairs)
        done.append(pairs.where(F.col("n_blocks") <= span).select(*row, F.col("a").alias("name"), "_copies"))
        todo = pairs.where(F.col("n_blocks") > span)
        distinct = todo.groupBy("a", "b").agg(F.lit(1).alias("_one")).select("a", "b")
        n = todo.count()
        if n == 0:
            break
        names = _named(distinct, ["a", "b"], _buckets(n))
        same = [F.col("l.a") == F.col("r.a"), F.col("l.b").eqNullSafe(F.col("r.b"))]
        pairs = (todo.alias("l").join(names.alias("r"), same)
                 .select(*row, "pos", "name", "_copies")
                 .groupBy(*row, F.shiftright("pos", 1).alias("pos"))
                 .agg(F.max(F.when(even, F.col("name"))).alias("a"),
                      F.max(F.when(~even, F.col("name"))).alias("b"),
                      F.sum(F.when(even, F.col("_copies"))).alias("_copies")))
        span *= 2
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _grouped(df: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    named = identify(df, id_col, text_col, block_bytes)
    groups = named.groupBy("n_blocks", "name").agg(
        F.max("_id").alias("keep_id"), F.sum("_copies").alias("group_size"))
    return named.join(groups, ["n_blocks", "name"])


def dedup_decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    return (_grouped(df, id_col, text_col, block_bytes).withColumn("_copy", copy)
            .select(F.col("_id").alias(id_col), "keep_id", "group_size",
                    (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
                    F.col("_sha").alias("text_sha256")))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that stay, with all columns of ``df``.  The texts move only if the
    dropped keys are too many to broadcast, or if rows repeat an id and a text."""
    groups = checkpointed(_grouped(df, id_col, text_col, block_bytes)
                          .select("_id", "_sha", "keep_id", "_copies"))
    stays = F.col("_id").eqNullSafe(F.col("keep_id"))
    gone = checkpointed(groups.where(~stays).select(F.col("_id").alias("_gone_id"), F.col("_sha").alias("_gone_sha")))
    sha = F.sha2(lower_ascii(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("binary"), 256)
    rest = (df.withColumn("_row_sha", sha)
            .join(small(gone), F.col(f"`{id_col}`").eqNullSafe(F.col("_gone_id"))
                  & (F.col("_row_sha") == F.col("_gone_sha")), "left_anti"))
    if not groups.where(stays & (F.col("_copies") > 1)).isEmpty():
        rest = rest.dropDuplicates([id_col, "_row_sha"])
    return rest.drop("_row_sha")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_decisions(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""
