"""Helpers shared by the training-data operators.

``map_text`` runs a function over the whole texts of a DataFrame in Arrow batches,
cut into pieces of bounded bytes, and passes the kept columns through untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmap.session import ensure_checkpoint_dir

PIECE_BYTES = 4 << 20
BROADCAST_ROWS = 400_000
_TEXT = "__text__"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The (checkpointed) frame, marked for broadcast if a count shows it bounded."""
    return F.broadcast(df) if df.count() <= rows else df


def globally_ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``_rank``, the 0-based place of a row in the order, and ``_part``, its
    partition.  Rows are dealt by range and sorted inside the partitions, so no task
    holds more than its share, also of equal rows; the driver gets one count per
    partition."""
    placed = checkpointed(df.withColumn("_tie", F.monotonically_increasing_id())
                          .repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie"))
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33).cast("int")
    before, offsets = 0, []
    for row in sorted(placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((row["p"], before))
        before += row["n"]
    offsets = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    return (placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn("_rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_at", "_before"))


HOT_GROUPS = 4096


def attached(rows: DataFrame, groups: DataFrame, key: str, n: str, columns: list[str]) -> DataFrame:
    """``rows`` left-joined with ``columns`` of ``groups`` (distinct ``key``, row count ``n``).
    Groups that hold over 1/HOT_GROUPS of the rows, of which there are fewer than
    HOT_GROUPS, are broadcast; the other keys are shuffled, each of them small."""
    groups = checkpointed(groups.select(key, n, *columns))
    most = groups.agg(F.sum(n)).first()[0] or 0
    hot = groups.where(F.col(n) * HOT_GROUPS > most)
    first = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"), *columns)), key, "left")
    found = first.where("_hot").drop("_hot")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return found.unionByName(rest.join(groups.where(F.col(n) * HOT_GROUPS <= most).select(key, *columns), key, "left")
                             .select(*found.columns))


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only; null stays null."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_class(id_col: str, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def pieces(batch: pa.RecordBatch, column: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most ``limit`` text bytes, or one row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def result_name_free(columns: list[str], fields: list[T.StructField]) -> list[str]:
    """Kept columns, without those that share a name with a result column."""
    taken = {f.name.lower() for f in fields}
    return [c for c in columns if c.lower() not in taken]


def map_text(df: DataFrame, text_col: str, keep: list[str], fields: list[T.StructField],
             start: Callable[[], Callable[[list], list]], piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Rows of ``df`` with ``keep`` columns plus result ``fields``.

    ``start()`` runs once per task and returns ``fn(texts) -> list of columns``;
    ``texts`` is a list of str or None (whole texts).  A kept column that shares
    its name with a result column is dropped: the result wins.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = result_name_free(keep, fields)
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(_TEXT))
    schema = T.StructType([source.schema[c] for c in kept] + fields)
    n = len(kept)
    arrow_types = [f.type for f in to_arrow_schema(T.StructType(fields))]

    def run(batches):
        fn = start()
        for batch in batches:
            for part in pieces(batch, n, piece_bytes):
                columns = fn(part.column(n).to_pylist())
                arrays = [part.column(i) for i in range(n)]
                arrays += [pa.array(c, type=t) if not isinstance(c, pa.Array) else c
                           for c, t in zip(columns, arrow_types)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def filter_text(df: DataFrame, text_col: str, start: Callable[[], Callable[[list], list]],
                piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Rows of ``df``, all columns untouched, for which ``fn(texts)`` says True."""
    position = [c.lower() for c in df.columns].index(text_col.lower())

    def run(batches):
        fn = start()
        for batch in batches:
            for part in pieces(batch, position, piece_bytes):
                mask = pa.array(fn(part.column(position).to_pylist()), type=pa.bool_())
                yield part.filter(mask)

    return df.mapInArrow(run, df.schema)


LEAST = 500         # rows of a class that thinning leaves, where it has them
MAX_CLASSES = 4096  # of a label


def thinned(df: DataFrame, id_col: str, rows: int, class_col: str | None = None, least: int = LEAST) -> DataFrame:
    """About ``rows`` rows of ``df`` at most, picked by a hash of the id.  With ``class_col``
    a class keeps about ``least`` rows, so that rare ones do not vanish as the table
    grows; the bound is then ``rows`` plus ``least`` a class."""
    if class_col is None:
        sizes = {None: df.count()}
    else:
        found = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
        if len(found) > MAX_CLASSES:
            raise ValueError(f"{class_col} has more than {MAX_CLASSES} values")
        sizes = {r[class_col]: r["n"] for r in found}
    total = sum(sizes.values())
    if total <= rows:
        return df
    shares = {c: min(1.0, max(rows / total, (least if class_col else 0) / n)) for c, n in sizes.items()}
    share = F.lit(rows / total)
    if class_col is not None:
        raised = [(c, x) for c, x in shares.items() if x > rows / total and c is not None]
        if raised:
            share = F.coalesce(F.create_map(*[F.lit(v) for pair in raised for v in pair])[F.col(class_col)], share)
    # a hash in [0, 1) of sixty bits' resolution
    place = (F.pmod(F.xxhash64(F.lit("sample"), F.col(f"`{id_col}`")), F.lit(1_000_000))
             + F.pmod(F.xxhash64(F.lit("finer"), F.col(f"`{id_col}`")), F.lit(1 << 40)) / F.lit(float(1 << 40))) / 1_000_000
    return df.where(place < share)


def within_bytes(df: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """Rows of a (checkpointed, bounded) sample whose texts hold ``limit`` bytes at most:
    ids in the order of another hash than that of ``thinned``, each one that still
    fits.  The ids and sizes go through the driver, a row per id of the sample."""
    sizes = (df.groupBy(id_col).agg(F.sum(F.octet_length(text_col)).alias("w"))
             .orderBy(F.xxhash64(F.lit("bytes"), F.col(id_col)), id_col).collect())
    if sum(r["w"] for r in sizes) <= limit:
        return df
    kept, total = [], 0
    for r in sizes:
        if total + r["w"] <= limit:
            kept.append((r[id_col],))
            total += r["w"]
    ids = df.sparkSession.createDataFrame(kept, T.StructType([df.schema[id_col]]))
    return df.join(F.broadcast(ids), id_col, "left_semi")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str,
                    rows: int, text_bytes: int | None = None) -> DataFrame:
    """Training rows (text, y): labelled, outside the held-out class, about ``rows``
    at most plus ``LEAST`` of a rare label (a documented bound of the classifiers), so
    the broadcast is bounded, and never more than ``text_bytes`` bytes of text (also where single texts are long).
    Repeated label rows of an id count once (the largest label)."""
    known = (labels.where(F.col(label).isNotNull() & (crc_class(id_col) != 0))
             .groupBy(F.col(id_col).alias("_lid")).agg(F.max(label).cast("int").alias("y")))
    picked = checkpointed(thinned(known, "_lid", rows, "y"))
    joined = (docs.select(F.col(f"`{id_col}`").alias("_lid"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
              .join(F.broadcast(picked), "_lid"))
    if text_bytes is not None:
        joined = within_bytes(checkpointed(joined), "_lid", "text", text_bytes)
    return joined.select("_lid", "text", "y")
