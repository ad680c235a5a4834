"""Feature matrix for nominal columns of any width (E3, E5): sparse one-hot vectors.

The levels of all nominal columns live in one keyed table (feature, level, index, n);
neither the driver nor the plan holds them.  Rows look their indices up with one join
on (feature, level): levels with over 1/HOT_LEVELS of a column's values, fewer than
HOT_LEVELS of them, come from a broadcast, the others from a shuffle in which every
key is small.  The vectors are MLlib's sparse ones, without per-column metadata (which
would put a million attribute names into the schema), and MLlib's solvers train on
them as they are.

Indices follow the string order of the levels, all levels are kept, missing is the
level ``unknown``, and a level that the fit did not see has no bit set: the same
matrix as ``features.FeatureModel``, one column per level, in the same order.

``logistic`` fits them without a vector of all columns on the driver or in a task: the
coefficients of the widest column, a level of which each row has at most one, are found
level by level beside the rows, and only the other columns' go to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmap.functions.columns import qcol
from riskmap.operators.clean import outcome_int, present, require_outcome
from riskmap.operators.distribution import numbered
from riskmap.operators import models
from riskmap.operators.features import level_expr, medians, moments
from riskmap.spec import RoleSpec

HOT_LEVELS = 4096
HOT_BLOCK = 256           # levels with over 1/HOT_BLOCK of the rows are fitted on the driver
MAX_REST = 4096           # columns whose coefficients the driver fits, by a matrix of their pairs
ROWS_PER_TASK = 500_000   # rows that are sorted by level in a task
CHUNK_ROWS = 32_768       # rows that the solver handles at once
DRIVER_ROWS = 128         # rows of that matrix that are added up and sent together


def _long(df: DataFrame, keep: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keep, feature, level) of the nominal columns, a missing value as its level."""
    wide = df.select(*[qcol(c).alias(f"_keep{i}") for i, c in enumerate(keep)], *[level_expr(df, c).alias(c) for c in cols])
    kept = [f"_keep{i}" for i in range(len(keep))]
    return wide.unpivot(kept, [qcol(c) for c in cols], "feature", "level").withColumnsRenamed(dict(zip(kept, keep)))


def level_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, level, index, n): every level of the nominal columns, its place in
    string order within its column and its number of rows."""
    found = _long(df, [], cols).groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
    placed = numbered(found, ["feature", "level"], "place")
    first = placed.groupBy("feature").agg(F.min("place").alias("first"))      # a row per column
    return placed.join(F.broadcast(first), "feature").select(
        "feature", "level", (F.col("place") - F.col("first")).alias("index"), "n")


def look_up(long: DataFrame, levels: DataFrame, key: str) -> DataFrame:
    """``long`` (key, feature, level) with ``index``, null for unknown levels.  Rows that
    the broadcast answered get a key of their own in the shuffle, so that a hot level
    does not pile up there."""
    rows = levels.groupBy("feature").agg(F.sum("n").alias("rows"))            # a row per column
    sized = levels.join(F.broadcast(rows), "feature")
    is_hot = F.col("n") * HOT_LEVELS > F.col("rows")
    hot = sized.where(is_hot).select("feature", "level", F.col("index").alias("_hot"))
    rest = sized.where(~is_hot).select(F.col("feature").alias("_feature"), F.col("level").alias("_level"), "index")
    first = long.join(F.broadcast(hot), ["feature", "level"], "left")
    done = F.col("_hot").isNotNull()
    first = (first.withColumn("_f", F.when(done, F.lit("")).otherwise(F.col("feature")))
             .withColumn("_l", F.when(done, F.col(key).cast("string")).otherwise(F.col("level"))))
    return (first.join(rest, (F.col("_f") == F.col("_feature")) & (F.col("_l") == F.col("_level")), "left")
            .withColumn("index", F.coalesce("_hot", "index")).select(key, "feature", "level", "index"))


@dataclass
class SparseFeatureModel:
    """E5 fitted: medians, scales and sizes on the driver, levels in a table."""

    spec: RoleSpec
    numeric: list[str]
    passthrough: list[str]
    nominal: list[str]
    medians: dict[str, float]
    levels: DataFrame
    sizes: dict[str, int]
    scales: dict[str, tuple[float, float]] | None = None      # E6: mean and population std

    @property
    def width(self) -> int:
        return len(self.numeric) + len(self.passthrough) + sum(self.sizes.values())

    def offsets(self) -> dict[str, int]:
        """Position of each nominal column's first level."""
        at, out = len(self.numeric) + len(self.passthrough), {}
        for c in self.nominal:
            out[c], at = at, at + self.sizes[c]
        return out

    def widest(self) -> tuple[int, int]:
        """First position and size of the nominal column with the most levels."""
        at = self.offsets()
        name = max(self.nominal, key=lambda c: self.sizes[c], default=None)
        return (at[name], self.sizes[name]) if name is not None else (self.width, 0)

    def _position(self):
        at = F.create_map(*[x for c, o in self.offsets().items() for x in (F.lit(c), F.lit(o).cast("long"))])
        return at[F.col("feature")] + F.col("index")

    def column_names(self) -> DataFrame:
        """(position, column): names of all matrix columns, as a table."""
        spark = self.levels.sparkSession
        named = spark.createDataFrame(list(enumerate(self.numeric + self.passthrough)), "position long, column string")
        if not self.nominal:
            return named
        return named.unionByName(self.levels.select(
            self._position().alias("position"), F.concat("feature", F.lit("="), "level").alias("column")))

    def scaled(self, train: DataFrame) -> "SparseFeatureModel":
        """This model with the numeric columns standardized by the rows of ``train``;
        a constant column becomes 0."""
        imputed = train.select(*[self._plain(c).alias(c) for c in self.numeric])
        fitted = moments(imputed, self.numeric) if self.numeric else {}
        return replace(self, scales={c: (m, s) for c, (m, s, _) in fitted.items()})

    def _plain(self, c: str):
        return F.coalesce(qcol(c).cast("double"), F.lit(self.medians[c]))

    def _value(self, c: str):
        if self.scales is None or c not in self.scales:
            return self._plain(c)
        mean, std = self.scales[c]
        return (self._plain(c) - F.lit(mean)) / F.lit(std) if std else F.lit(0.0)

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        """id, outcome (when present) and the sparse vector of each row."""
        key, dense = self.spec.id, len(self.numeric) + len(self.passthrough)
        head = [qcol(key)] + ([outcome_int(self.spec)] if self.spec.outcome in df.columns else [])
        base = df.select(*head, F.array(*[self._value(c) for c in self.numeric + self.passthrough]).cast("array<double>").alias("_dense"))
        if self.nominal:
            found = look_up(_long(df, [key], self.nominal), self.levels, key)
            base = base.join(found.groupBy(key).agg(F.array_sort(F.collect_list(self._position())).alias("_bits")), key)
        else:
            base = base.withColumn("_bits", F.array().cast("array<bigint>"))
        head = [c for c in base.columns if c not in ("_dense", "_bits")]
        schema = T.StructType([base.schema[c] for c in head] + [T.StructField(out, VectorUDT())])
        width = self.width

        def assemble(batches):
            for batch in batches:
                n, bits = batch.num_rows, batch.column(len(head) + 1)
                count = bits.value_lengths().to_numpy()
                starts = np.concatenate([[0], np.cumsum(count + dense)]).astype(np.int32)
                indices, values = np.empty(starts[-1], dtype=np.int32), np.ones(starts[-1])
                place = starts[:-1, None] + np.arange(dense)
                indices[place] = np.arange(dense)
                values[place] = batch.column(len(head)).flatten().to_numpy(zero_copy_only=False).reshape(n, dense)
                rest = np.ones(starts[-1], dtype=bool)
                rest[place] = False
                indices[rest] = bits.flatten().to_numpy()
                stops = pa.array(starts)
                vector = pa.StructArray.from_arrays(
                    [pa.array(np.zeros(n, dtype=np.int8)), pa.array(np.full(n, width, dtype=np.int32)),
                     pa.ListArray.from_arrays(stops, pa.array(indices)), pa.ListArray.from_arrays(stops, pa.array(values))],
                    names=["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(head)], vector], names=schema.names)

        return base.select(*head, "_dense", "_bits").mapInArrow(assemble, schema)

    def to_long(self, df: DataFrame, out: str = "features") -> DataFrame:
        """(id, position, value) of the vectors' stored entries."""
        v = F.unwrap_udt(out)
        pairs = F.arrays_zip(v["indices"].alias("position"), v["values"].alias("value"))
        return self.transform(df, out).select(self.spec.id, F.inline(pairs).alias("position", "value"))


def fit_sparse_features(df_clean: DataFrame, spec: RoleSpec, fit_rows: DataFrame | None = None) -> SparseFeatureModel:
    """E5 for columns of any width.  ``fit_rows``: as in ``features.fit_feature_model``."""
    require_outcome(df_clean, spec)
    numeric = list(dict.fromkeys(present(df_clean, spec.numeric_candidates)))
    passthrough = [c for c in dict.fromkeys(present(df_clean, spec.passthrough)) if c not in numeric]
    nominal = [c for c in dict.fromkeys(present(df_clean, spec.nominal)) if c not in numeric and c not in passthrough]
    rows = fit_rows if fit_rows is not None else df_clean
    med = medians(rows, numeric + passthrough)
    missing = [c for c, v in med.items() if v is None]
    if missing:
        raise ValueError(f"cannot impute all-null columns: {missing}")
    if not nominal:
        empty = df_clean.sparkSession.createDataFrame([], "feature string, level string, index long, n long")
        return SparseFeatureModel(spec, numeric, passthrough, [], med, empty, {})
    levels = level_table(rows, nominal)
    sizes = {r["feature"]: r["size"] for r in levels.groupBy("feature").agg((F.max("index") + 1).alias("size")).collect()}
    return SparseFeatureModel(spec, numeric, passthrough, nominal, med, levels, {c: int(sizes.get(c, 0)) for c in nominal})


# -- M1 on sparse vectors -----------------------------------------------------

def _flat(entries):
    """Values of a list column without copies of the list's ends."""
    return entries.flatten().to_numpy(zero_copy_only=False)


def _unpack(row) -> dict:
    kinds = {"levels": np.int64, "group": np.int64, "y": float, "at": np.int64, "column": np.int64, "value": float}
    return {c: np.frombuffer(row[c], dtype=kind) for c, kind in kinds.items()}


def _level_fit(margin, y, group, n: int, ridge: float) -> np.ndarray:
    """Every level's own coefficient at its optimum, given the margins of the others: the root
    of an increasing function, by Newton steps inside a bracket.  ``group`` n: none."""
    v = np.zeros(n + 1)
    rows = np.bincount(group, minlength=n + 1)
    lo, hi = -(rows + 1.0) / ridge, (rows + 1.0) / ridge
    for _ in range(200):
        v[n] = 0.0
        p = 1.0 / (1.0 + np.exp(-np.clip(margin + v[group], -700, 700)))
        g = np.bincount(group, p - y, n + 1) + ridge * v
        h = np.bincount(group, p * (1 - p), n + 1) + ridge
        g[n] = 0.0
        if np.abs(g).max() <= 1e-12 * (1 + rows.max()):
            break
        lo, hi = np.where(g < 0, v, lo), np.where(g > 0, v, hi)
        step = v - g / h
        v = np.where((step > lo) & (step < hi), step, (lo + hi) / 2)
    v[n] = 0.0
    return v


class _PairSums:
    """Upper triangle of a sum of b b', where b are sparse rows with entries (column, value).
    Products wait until there are ``WAITING`` of them."""

    WAITING = 2_000_000

    def __init__(self, width: int):
        self.width, self.total = width, np.zeros(width * width)
        self.flat, self.products, self.held = [], [], 0

    def add(self, row, column, value, sign: float = 1.0) -> None:
        """Entries are sorted by row, then column."""
        first = np.arange(len(row))
        for apart in range(len(row)):
            first = first[first + apart < len(row)]
            first = first[row[first] == row[first + apart]]
            if not len(first):
                break
            self.flat.append(column[first] * self.width + column[first + apart])
            self.products.append(sign * value[first] * value[first + apart])
            self.held += len(first)
            if self.held > self.WAITING:
                self.flush()

    def flush(self) -> None:
        if self.held:
            self.total += np.bincount(np.concatenate(self.flat), np.concatenate(self.products), len(self.total))
        self.flat, self.products, self.held = [], [], 0

    def blocks(self, rows: int):
        """(first row, rows from their diagonal on) of the square."""
        self.flush()
        square = self.total.reshape(self.width, self.width)
        for lo in range(0, self.width, rows):
            yield lo, square[lo:lo + rows, lo:].copy()


def _summed(row, column, value, width: int):
    """Entries (row, column, value) with one entry for each row and column, in order."""
    keys, back = np.unique(row * width + column, return_inverse=True)
    return keys // width, keys % width, np.bincount(back, value, len(keys))


class SparseLogistic:
    """L2 logistic regression with sklearn's C and a free intercept, as ``models.logistic``,
    on sparse vectors of which a block of columns (one nominal column) has at most one entry
    per row, of any value.

    Given the other columns' coefficients u, those of the block's levels are independent
    one-dimensional problems, solved beside the rows of each level.  What is left is a convex
    function of u; its Newton steps need its gradient and the Schur complement of the
    Hessian, to which each level adds a rank-one term.  An iteration is one job; the driver
    holds u and that matrix.  Levels with over 1/HOT_BLOCK of the rows, fewer than HOT_BLOCK
    of them, count among the other columns, so that no task gets a large part of the rows.
    Where over ``MAX_REST`` columns are left, or the labels are not both of 0 and 1, the fit
    is MLlib's.
    """

    def __init__(self, C: float, weight_sum: float, block: tuple[int, int], max_iter: int = 100, tol: float = 1e-10):
        self.C, self.weight_sum, self.block, self.max_iter, self.tol = C, weight_sum, block, max_iter, tol

    def _entries(self, data: DataFrame) -> DataFrame:
        """(level, y, at, value): position in the block (null without one), label, the others."""
        start, size = self.block
        vector = F.unwrap_udt("features")
        pairs = F.arrays_zip(vector["indices"].alias("at"), vector["values"].alias("value"))
        inside = lambda x: (x["at"] >= start) & (x["at"] < start + size) & (x["value"] != 0)
        rest = lambda x: (x["at"] < start) | (x["at"] >= start + size)
        found = data.select(F.col("label").cast("double").alias("y"), pairs.alias("pairs"))
        return found.select(F.try_element_at(F.filter("pairs", inside), F.lit(1)).alias("mine"), "y",
                            F.filter("pairs", rest).alias("rest")).select(
            F.col("mine.at").alias("level"), F.col("mine.value").alias("size"), "y",
            F.col("rest.at").alias("at"), F.col("rest.value").alias("value"))

    def _plain(self, data: DataFrame):
        return models.logistic(self.C, self.weight_sum, tol=self.tol).fit(data)

    def fit(self, data: DataFrame):
        spark = data.sparkSession
        start, size = self.block
        width = data.select(F.unwrap_udt("features")["size"].alias("d")).first()["d"]
        rows = self._entries(data)
        counted = rows.where("level IS NOT NULL").groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("size") != 1).alias("scaled"))
        at = F.unwrap_udt("features")["indices"]
        total, zeros, ones, repeated = data.agg(
            F.count(F.lit(1)), F.count(F.when(F.col("label") == 0, 1)), F.count(F.when(F.col("label") == 1, 1)),
            F.count(F.when(F.size(F.array_distinct(at)) != F.size(at), 1))).first()
        if not (zeros and ones and zeros + ones == total) or repeated:    # one class, several, or rows that MLlib refuses
            return self._plain(data)
        hot = sorted(r["level"] for r in counted.where((F.col("n") * HOT_BLOCK > total) | F.col("scaled")).select("level").limit(MAX_REST + 1).collect())
        plain = width - size
        R = plain + len(hot) + 1                                          # the last is the intercept
        if R > MAX_REST:
            return self._plain(data)
        hot_at = np.array(hot, dtype=np.int64)
        fixed = F.col("level").isin(hot) if hot else F.lit(False)
        kept = rows.select(
            F.when(fixed | F.col("level").isNull(), F.lit(None)).otherwise(F.col("level")).alias("level"), "y",
            F.when(fixed, F.concat("at", F.array("level"))).otherwise(F.col("at")).alias("at"),
            F.when(fixed, F.concat("value", F.array("size"))).otherwise(F.col("value")).alias("value"))
        key = F.when(F.col("level").isNull(), F.xxhash64("at", "value", "y")).otherwise(F.xxhash64("level"))
        cores = spark.sparkContext.defaultParallelism
        dealt = kept.repartition(max(cores, math.ceil(total / ROWS_PER_TASK)), key).sortWithinPartitions("level")
        chunks = dealt.mapInArrow(self._packer(hot_at, plain), "levels binary, group binary, y binary, at binary, column binary, value binary").persist()
        ridge, packed = 1.0 / self.C, chunks.rdd.coalesce(cores)           # each task sends one matrix

        def measure(u):
            """(value, gradient, Schur complement) at u, from one job."""
            sent = spark.sparkContext.broadcast(u)

            def part(chunk_rows):
                coefs = sent.value
                value, g, S = 0.0, np.zeros(R), _PairSums(R)
                for row in chunk_rows:
                    c = _unpack(row)
                    n, group, y = len(c["levels"]), c["group"], c["y"]
                    margin = np.bincount(c["at"], c["value"] * coefs[c["column"]], len(y))
                    v = _level_fit(margin, y, group, n, ridge)
                    m = margin + v[group]
                    p = 1.0 / (1.0 + np.exp(-np.clip(m, -700, 700)))
                    value += float((np.logaddexp(0.0, m) - y * m).sum()) + 0.5 * ridge * float((v * v).sum())
                    g += np.bincount(c["column"], c["value"] * (p - y)[c["at"]], R)
                    w = p * (1 - p)
                    own, col, x = _summed(c["at"], c["column"], c["value"], R)
                    S.add(own, col, x * np.sqrt(w)[own])
                    h = np.bincount(group, w, n + 1) + ridge
                    lev, col, x = _summed(group[own], col, x * w[own], R)
                    some = lev < n
                    S.add(lev[some], col[some], x[some] / np.sqrt(h)[lev[some]], -1.0)
                yield -1, np.concatenate([[value], g])
                yield from S.blocks(DRIVER_ROWS)

            S, ends = np.zeros((R, R)), None
            added = packed.mapPartitions(part).reduceByKey(lambda a, b: a + b, max(1, R // DRIVER_ROWS))
            for lo, block in added.toLocalIterator():                     # a few rows of the matrix at a time
                if lo < 0:
                    ends = block
                else:
                    own = block[:, :len(block)]
                    own += np.triu(own, 1).T                              # its lower triangle is empty
                    S[lo:lo + len(block), lo:] = block
                    S[lo:, lo:lo + len(block)] = block.T
            sent.destroy()
            penalty = np.full(R, ridge)
            penalty[-1] = 0.0
            S[np.arange(R), np.arange(R)] += penalty
            return ends[0] + 0.5 * float((penalty * u * u).sum()), ends[1:] + penalty * u, S

        try:
            u = np.zeros(R)
            f, g, S = measure(u)
            for _ in range(self.max_iter):
                if np.abs(g).max() <= self.tol * self.weight_sum:
                    break
                step = np.linalg.solve(S, g)
                for halvings in range(20):
                    new = u - step / 2 ** halvings
                    got = measure(new)
                    if got[0] <= f + 1e-12 * abs(f):
                        break
                else:
                    break                                                  # at the limit of the arithmetic
                u, (f, g, S) = new, got
            return SparseLogisticModel(self, width, u, hot_at, plain, self._levels(spark, packed, u, ridge))
        finally:
            chunks.unpersist()

    def _packer(self, hot: np.ndarray, plain: int):
        """Arrow batches of sorted rows -> one record per about CHUNK_ROWS rows, in which every
        level of the block is whole."""
        start, size = self.block

        def columns(at):
            out = np.where(at < start, at, at - size)
            mine = (at >= start) & (at < start + size)
            if mine.any():
                out[mine] = plain + np.searchsorted(hot, at[mine])
            return out

        def record(level, y, counts, at, value):
            levels, group = np.unique(level[level >= 0], return_inverse=True)
            groups = np.full(len(level), len(levels), dtype=np.int64)
            groups[level >= 0] = group
            n, R = len(y), plain + len(hot)
            row = np.concatenate([np.repeat(np.arange(n), counts), np.arange(n)])
            column, x = np.concatenate([columns(at), np.full(n, R)]), np.concatenate([value, np.ones(n)])
            parts = (levels.astype(np.int64), groups, y, row.astype(np.int64), column.astype(np.int64), x)
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in parts],
                                              names=["levels", "group", "y", "at", "column", "value"])

        def pack(batches):
            held, n = [], 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                at, value = batch.column(2), batch.column(3)
                held.append((batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64),
                             batch.column(1).to_numpy(zero_copy_only=False), at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
                             _flat(at).astype(np.int64), _flat(value)))
                n += batch.num_rows
                if n >= CHUNK_ROWS:
                    level, y, counts, places, values = (np.concatenate(v) for v in zip(*held))
                    ends = np.concatenate([[0], np.cumsum(counts)])
                    lo = 0
                    while n - lo >= CHUNK_ROWS:
                        hi = lo + CHUNK_ROWS
                        if hi < n and level[hi] >= 0 and level[hi] == level[hi - 1]:
                            hi = int(np.searchsorted(level, level[hi], side="right"))   # sorted: the level's end
                        if hi >= n and level[n - 1] >= 0:
                            hi = int(np.searchsorted(level, level[n - 1], side="left"))  # its rows may go on
                            if hi <= lo:
                                break
                        yield record(level[lo:hi], y[lo:hi], counts[lo:hi], places[ends[lo]:ends[hi]], values[ends[lo]:ends[hi]])
                        lo = hi
                    held = [(level[lo:], y[lo:], counts[lo:], places[ends[lo]:], values[ends[lo]:])] if lo < n else []
                    n -= lo
            if n:
                yield record(*(np.concatenate(v) for v in zip(*held)))

        return pack

    def _levels(self, spark, packed, u: np.ndarray, ridge: float) -> DataFrame:
        """(position, beta) of the block's levels at u, written once."""
        sent = spark.sparkContext.broadcast(u)

        def solve(chunk_rows):
            for row in chunk_rows:
                c = _unpack(row)
                margin = np.bincount(c["at"], c["value"] * sent.value[c["column"]], len(c["y"]))
                v = _level_fit(margin, c["y"], c["group"], len(c["levels"]), ridge)
                yield from zip(c["levels"].tolist(), v[:-1].tolist())

        return models.materialize(spark.createDataFrame(packed.mapPartitions(solve), "position long, beta double"))


class SparseLogisticModel:
    """A fitted ``SparseLogistic``: u on the driver, the block's coefficients in a table."""

    def __init__(self, made: SparseLogistic, width: int, u: np.ndarray, hot: np.ndarray, plain: int, levels: DataFrame):
        self.made, self.width, self.levels, self.intercept = made, width, levels, float(u[-1])
        start, size = made.block
        places = np.concatenate([np.arange(start), np.arange(start + size, width), hot]).astype(int)
        self.rest = dict(zip(places.tolist(), u[:-1].tolist()))

    def coefficients(self) -> DataFrame:
        """(position, beta) of every column; 0 where no row of the fit has the level."""
        spark = self.levels.sparkSession
        rest = spark.createDataFrame(list(self.rest.items()), "position long, beta double")     # MAX_REST at most
        return (spark.range(self.width).withColumnRenamed("id", "position").join(self.levels.unionByName(rest), "position", "left")
                .select("position", F.coalesce("beta", F.lit(0.0)).alias("beta")))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the class probabilities of each row, as MLlib's models add them."""
        start, size = self.made.block
        rest, intercept = self.rest, self.intercept
        places = np.array(sorted(rest), dtype=np.int64)
        betas = np.array([rest[i] for i in places.tolist()])

        @F.pandas_udf("double")
        def others(at: pd.Series, value: pd.Series) -> pd.Series:
            if not len(at):
                return pd.Series([], dtype=float)
            row = np.repeat(np.arange(len(at)), at.map(len))
            every, x = np.concatenate(at.to_list()).astype(np.int64), np.concatenate(value.to_list())
            near = np.minimum(np.searchsorted(places, every), max(len(places) - 1, 0))
            known = (places[near] == every) if len(places) else np.zeros(len(every), dtype=bool)
            return pd.Series(intercept + np.bincount(row[known], x[known] * betas[near[known]], len(at)))

        v = F.unwrap_udt("features")
        inside = F.filter(F.arrays_zip(v["indices"].alias("at"), v["values"].alias("value")),
                          lambda x: (x["at"] >= start) & (x["at"] < start + size))
        mine = F.try_element_at(inside, F.lit(1))
        found = df.withColumn("_m", others(v["indices"], v["values"])).withColumn("_at", mine["at"].cast("long")).withColumn("_x", mine["value"])
        own = self.levels.select(F.col("position").alias("_position"), F.col("beta").alias("_beta"))
        # rows without a level of the table keep a key of their own
        key = F.when(F.col("_at").isNull() | F.col("_at").isin([int(i) for i in places[(places >= start) & (places < start + size)]]),
                     -1 - F.abs(F.xxhash64("_m") % (1 << 40))).otherwise(F.col("_at"))
        joined = found.withColumn("_key", key).join(own, F.col("_key") == F.col("_position"), "left")
        m = F.col("_m") + F.coalesce(F.col("_x") * F.col("_beta"), F.lit(0.0))
        p = 1 / (1 + F.exp(-m))
        return joined.withColumn("probability", array_to_vector(F.array(1 - p, p))).drop("_m", "_at", "_x", "_key", "_position", "_beta")


def coefficient_rows(spark, model) -> DataFrame:
    """(position, beta) of every column of a fit, this module's or MLlib's."""
    if isinstance(model, SparseLogisticModel):
        return model.coefficients()
    return spark.createDataFrame(list(enumerate(model.coefficients.toArray().tolist())), "position long, beta double")


def logistic(C: float, weight_sum: float, block: tuple[int, int], max_iter: int = 100, tol: float = 1e-10) -> SparseLogistic:
    """M1 for sparse vectors of any width; ``block``: first position and size of the widest column."""
    return SparseLogistic(C, weight_sum, block, max_iter, tol)
