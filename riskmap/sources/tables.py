"""Scans (A1) and result sinks (A2-A4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; parquet gives column pruning and filter pushdown."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: type classes of a data dictionary (D1) and the types their columns are read as
TYPE_CLASSES = {"int": LongType(), "float": DoubleType(), "string": StringType(), "bool": BooleanType()}
CORRUPT = "_corrupt_record"


def csv_schema(spark: SparkSession, path: str, dictionary: Sequence[tuple[str, str]], sep: str = ",") -> StructType:
    """Schema of a CSV by its header: documented columns in their type, others as strings, in
    the file's order, and the column that takes rows which do not parse.  Only the
    header line is read."""
    kinds = dict(dictionary)
    unknown = set(kinds.values()) - set(TYPE_CLASSES)
    if unknown:
        raise ValueError(f"type classes are {sorted(TYPE_CLASSES)}, got {sorted(unknown)}")
    header = spark.read.option("header", True).option("sep", sep).csv(path).columns
    return StructType([StructField(c, TYPE_CLASSES[kinds[c]] if c in kinds else StringType()) for c in header]
                      + [StructField(CORRUPT, StringType())])


def load_raw(spark: SparkSession, path: str, dictionary: Sequence[tuple[str, str]] | None = None,
             schema: StructType | None = None, null_value: str = "", sep: str = ",") -> DataFrame:
    """A1: CSV with header; empty fields are missing.

    With a data ``dictionary`` of (variable, type class) columns are typed by name,
    whatever their order in the file; a row with a value of another type, or with too
    many or too few fields, keeps what parsed and has its text in ``_corrupt_record``
    (``sound_rows`` and ``corrupt_rows`` take them apart).  A given ``schema`` is
    checked against the header.  Without either, types are inferred by a pass over the
    data.
    """
    reader = spark.read.option("header", True).option("nullValue", null_value).option("sep", sep)
    if dictionary is not None:
        schema = csv_schema(spark, path, dictionary, sep)
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if schema is not None:
        # without this, Spark lays the schema over the fields by position and ignores the header
        return reader.option("enforceSchema", False).schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def sound_rows(raw: DataFrame) -> DataFrame:
    """Rows of ``load_raw`` that parsed as documented."""
    return raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def corrupt_rows(raw: DataFrame) -> DataFrame:
    """The others, with what parsed and their text."""
    return raw.where(F.col(CORRUPT).isNotNull())


def save_splits(df: DataFrame, out_dir: str, split_col: str = "split",
                fmt: str = "parquet") -> None:
    """A2: persist a keyed, split-labelled frame, one directory per split value.

    Partitioning by ``split`` lets readers prune to one split without
    scanning the others (A3).
    """
    (df.write.mode("overwrite").partitionBy(split_col)
       .format(fmt).option("header", True).save(out_dir))


def load_split(spark: SparkSession, in_dir: str, split: str | None = None,
               split_col: str = "split", fmt: str = "parquet") -> DataFrame:
    """A3: reload persisted splits; ``split`` filters by partition pruning."""
    df = spark.read.format(fmt).option("header", True).load(in_dir)
    if split is not None:
        df = df.where(F.col(split_col) == split)
    return df


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A4: result tables (metrics rows, profiles, names) are a handful of rows,
    so one output file is written."""
    (df.coalesce(1).write.mode("overwrite").format(fmt)
       .option("header", True).save(path))
