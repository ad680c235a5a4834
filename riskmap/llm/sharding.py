"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``2**GRID_BITS`` cells.  Each shard owns ``vnodes`` cells, and a key
belongs to the next owned cell clockwise of its hash (its *arc*).  Keys of an arc
are ordered by hash; a shard first takes the keys at home in it, in ring order, up
to its quota; the rest continue clockwise to the next shard with room.  Only the
row counts of the arcs (shards x vnodes numbers) reach the driver, which turns them
into rank intervals; every key then finds its shard from its rank in its arc.

With ``load_factor=1.0`` the quotas are the exact equal split, so the law is
``rows``: shard counts differ by at most one.  A larger factor leaves room, and
adding a shard then moves fewer rows.

Defined cases: a null id hashes as the empty text; a null text has size 1 and crc
0; repeated rows are ranked together and get distinct slots; an empty table gives
an empty result.  Only the id and text columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskmap.llm.common import checkpointed, table

GRID_BITS = 14
HASH_BITS = 52


def ring_owners(n_shards: int, vnodes: int) -> dict[int, int]:
    """Owned cell -> shard.  A cell already taken passes the newcomer on by one."""
    size, owners = 1 << GRID_BITS, {}
    for replica in range(vnodes):
        for shard in range(n_shards):
            digest = hashlib.md5(f"shard-{shard}-{replica}".encode()).hexdigest()
            cell = int(digest[:13], 16) >> (HASH_BITS - GRID_BITS)
            while cell in owners:
                cell = (cell + 1) % size
            owners[cell] = shard
    return owners


def ring_arcs(owners: dict[int, int]) -> list[tuple[int, int, int]]:
    """(cell, arc, order): the arc is the owned cell at or clockwise of the cell;
    order counts the cells of an arc in ring direction."""
    size, points = 1 << GRID_BITS, sorted(owners)
    out = []
    for i, point in enumerate(points):
        before = points[i - 1] - (size if i == 0 else 0)
        out += [(c % size, point, c - before) for c in range(before + 1, point + 1)]
    return out


def quotas(total: int, n_shards: int, load_factor: float) -> list[int]:
    if load_factor <= 1.0:
        return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    return [math.ceil(load_factor * total / n_shards)] * n_shards


def assign_arcs(counts: dict[int, int], owners: dict[int, int], room: list[int]) -> list[tuple]:
    """(arc, rank_from, rank_to, shard, slot_from) intervals, ends exclusive."""
    used, out, left = [0] * len(room), [], {}

    def give(arc: int, start: int, n: int, shard: int) -> None:
        if n:
            out.append((arc, start, start + n, shard, used[shard]))
            used[shard] += n

    points = sorted(owners)
    for arc in points:
        n, shard = counts.get(arc, 0), owners[arc]
        taken = min(n, room[shard] - used[shard])
        give(arc, 0, taken, shard)
        if n > taken:
            left[arc] = [taken, n - taken]
    carried: deque = deque()
    for lap in range(2):
        for point in points:
            shard = owners[point]
            while carried and used[shard] < room[shard]:
                arc, start, n = carried.popleft()
                taken = min(n, room[shard] - used[shard])
                give(arc, start, taken, shard)
                if n > taken:
                    carried.appendleft((arc, start + taken, n - taken))
            if lap == 0 and point in left:
                carried.append((point, *left[point]))
    return out


def _literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(",")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    kind = "array<struct<" + ",".join(":".join(c.split()) for c in schema.split(",")) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    n_shards: int = 8, vnodes: int = 64, load_factor: float = 1.0) -> DataFrame:
    """One row per input row: id, size, text_crc32, home_shard, shard, slot."""
    spark = df.sparkSession
    owners = ring_owners(n_shards, vnodes)
    cells = _literal_table(spark, ring_arcs(owners), "cell int,arc int,cell_order int")
    text = F.col(f"`{text_col}`")
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    # equal rows meet once, counted, so that a row repeated without end is one record
    rows = (df.select(F.col(f"`{id_col}`").alias("_id"),
                      (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_size"),
                      F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("_crc"),
                      F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long").alias("_pos"))
            .groupBy("_id", "_size", "_crc", "_pos").agg(F.count(F.lit(1)).alias("_copies")))
    rows = checkpointed(rows.withColumn(
        "cell", F.shiftright("_pos", HASH_BITS - GRID_BITS).cast("int")))
    in_arc = Window.partitionBy("arc").orderBy("cell_order")
    cell_counts = checkpointed(
        rows.groupBy("cell").agg(F.sum("_copies").alias("_n")).join(F.broadcast(cells), "cell")
        .withColumn("_cell_from", F.sum("_n").over(in_arc) - F.col("_n")))
    counts = {r["arc"]: r["n"] for r in
              cell_counts.groupBy("arc").agg(F.sum("_n").alias("n")).collect()}  # shards x vnodes rows
    room = quotas(sum(counts.values()), n_shards, load_factor)
    intervals = _literal_table(spark, assign_arcs(counts, owners, room),
                               "i_arc int,rank_from bigint,rank_to bigint,shard int,slot_from bigint")
    homes = _literal_table(spark, sorted(owners.items()), "h_arc int,home_shard int")
    in_cell = Window.partitionBy("cell").orderBy("_pos", "_id", "_size", "_crc")
    ranked = (rows.withColumn("_end", F.sum("_copies").over(in_cell))
              .join(cell_counts.select("cell", "arc", "_cell_from"), "cell")
              .withColumn("_rank", F.explode(F.sequence(
                  F.col("_cell_from") + F.col("_end") - F.col("_copies"),
                  F.col("_cell_from") + F.col("_end") - 1))))
    return (ranked.join(F.broadcast(intervals), (F.col("arc") == F.col("i_arc"))
                        & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to")))
            .join(F.broadcast(homes), F.col("arc") == F.col("h_arc"))
            .select(F.col("_id").alias(id_col), F.col("_size").alias("size"),
                    F.col("_crc").alias("text_crc32"), "home_shard", "shard",
                    (F.col("slot_from") + F.col("_rank") - F.col("rank_from")).alias("slot")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "home_shard")
