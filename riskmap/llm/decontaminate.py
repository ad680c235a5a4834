"""Benchmark decontamination by suffix arrays over the training documents.

A shard is a piece of documents.  Its words become integers (words that no test item
uses become 0) and a suffix array orders the suffixes that can begin a test window,
i.e. those that start with two neighbouring words of some item.  Every test suffix
is then binary-searched in the array of every shard: its range of suffixes is the
set of places where its window occurs verbatim.  Neighbouring hits on one diagonal
join into the longest verbatim matches, with their places on both sides.

Words are runs of digits, a-z and non-ASCII characters after lower-casing A-Z.  A
window is ``window`` consecutive words of an item; an item with fewer words, but
some, is one window.  The documents are never shuffled: test items go out in blocks
of at most ``block_words`` words (a longer item is a block of its own), so the
broadcast is bounded, and each block is one pass over the documents.

Defined cases: null texts have no words; items without words are ignored; a null
item id is the empty text; equal item ids count once; an empty benchmark hits
nothing; repeated rows give equal rows; a kept column that shares its name with a
result column is dropped.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmap.llm.common import PIECE_BYTES, checkpointed, pieces, result_name_free, table

WINDOW = 10
BLOCK_WORDS = 1_000_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MATCH = T.StructType([T.StructField("doc_word", T.IntegerType()), T.StructField("item_id", T.StringType()),
                      T.StructField("item_word", T.IntegerType()), T.StructField("words", T.IntegerType())])
_CARRIED = [T.StructField("__words__", T.LongType()), T.StructField("__hits__", T.ArrayType(T.IntegerType())),
            T.StructField("__items__", T.ArrayType(T.StringType())), T.StructField("__matches__", T.ArrayType(MATCH))]


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


class TestBlock:
    """The windows of a block of test items, as sorted integer suffixes."""

    __test__ = False

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        keys, sizes, self.place = [], [], []
        by_window: dict[tuple, int] = {}
        self.items: list[set[str]] = []
        for name, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            n = min(window, len(ids))
            for j in range(len(ids) - n + 1):
                key = tuple(ids[j:j + n])
                if key not in by_window:
                    by_window[key] = len(keys)
                    keys.append(key + (0,) * (window - n))
                    sizes.append(n)
                    self.place.append((name, j))
                    self.items.append(set())
                self.items[by_window[key]].add(name)
        self.keys = np.array(keys, dtype=np.int64).reshape(-1, window)
        self.sizes = np.array(sizes, dtype=np.int64)
        alone, first = self.sizes == 1, np.zeros(len(self.vocab) + 1, dtype=bool)
        first[self.keys[alone, 0] if len(keys) else []] = True
        self.alone = first
        self.pair_mask = (1 << 22) - 1
        self.pairs = np.zeros(self.pair_mask + 1, dtype=bool)
        if len(keys) and window > 1:
            self.pairs[self._pair(self.keys[~alone, 0], self.keys[~alone, 1])] = True
        self.low = self._bytes(self.keys)
        top = self.keys.copy()
        top[np.arange(window)[None, :] >= self.sizes[:, None]] = (1 << 31) - 1
        self.high = self._bytes(top)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 2654435761 + b * 40503) & self.pair_mask

    def _bytes(self, rows: np.ndarray) -> np.ndarray:
        """Rows of integers as byte strings in the same order."""
        return np.ascontiguousarray(rows.astype(">i4")).view(f"S{4 * self.window}").ravel()

    def search(self, texts: list) -> list[tuple[int, np.ndarray, list[str], list[tuple]]]:
        """Per text: words, hit runs [from, to, ...], items, longest matches."""
        get, flat, n_words = self.vocab.get, [], []
        for text in texts:
            words = words_of(text)
            n_words.append(len(words))
            flat.append(np.fromiter(map(get, words, repeat(0)), dtype=np.int64, count=len(words)))
            flat.append(np.zeros(1, dtype=np.int64))
        starts = np.concatenate([[0], np.cumsum(np.array(n_words, dtype=np.int64) + 1)])
        flat = np.concatenate(flat + [np.zeros(self.window, dtype=np.int64)])
        body = flat[:starts[-1]]
        may = self.pairs[self._pair(body, flat[1:len(body) + 1])] & (body > 0) | self.alone[body]
        suffixes = np.flatnonzero(may)
        empty = (np.zeros(0, dtype=np.int64), [], [])
        if not len(suffixes) or not len(self.sizes):
            return [(n, *empty) for n in n_words]
        keys = self._bytes(flat[suffixes[:, None] + np.arange(self.window)[None, :]])
        order = np.argsort(keys, kind="stable")
        keys, suffixes = keys[order], suffixes[order]  # the suffix array of the shard
        low, high = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        count = high - low
        window_of = np.repeat(np.arange(len(count)), count)
        if not len(window_of):
            return [(n, *empty) for n in n_words]
        at = suffixes[np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
        edge = np.zeros(len(flat) + 1, dtype=np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.sizes[window_of], -1)
        hit = (np.cumsum(edge) > 0).astype(np.int8)
        change = np.flatnonzero(np.diff(np.concatenate([[0], hit])))  # from, to, from, to, ...
        doc_of_run = np.searchsorted(starts, change[::2], "right") - 1
        by_place = np.lexsort((window_of, at))
        at, window_of = at[by_place], window_of[by_place]
        doc_of = np.searchsorted(starts, at, "right") - 1
        out = []
        bounds = np.searchsorted(doc_of, np.arange(len(texts) + 1))
        runs = np.searchsorted(doc_of_run, np.arange(len(texts) + 1))
        for d, n in enumerate(n_words):
            a, b = bounds[d], bounds[d + 1]
            if a == b:
                out.append((n, *empty))
                continue
            found = np.unique(window_of[a:b])
            items = sorted(set().union(*[self.items[w] for w in found]))
            out.append((n, change[2 * runs[d]:2 * runs[d + 1]] - starts[d], items,
                        self._longest(at[a:b] - starts[d], window_of[a:b])))
        return out

    def _longest(self, at: np.ndarray, window_of: np.ndarray) -> list[tuple]:
        """Hits that follow each other on both sides, joined."""
        open_runs: dict[tuple[str, int], list] = {}
        out = []
        for p, w in zip(at.tolist(), window_of.tolist()):
            name, j = self.place[w]
            run = open_runs.get((name, p - j))
            if run and run[0] + run[3] >= p:
                run[3] = max(run[3], p + int(self.sizes[w]) - run[0])
            else:
                run = [p, name, j, int(self.sizes[w])]
                open_runs[(name, p - j)] = run
                out.append(run)
        return [tuple(r) for r in out]


def test_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int):
    """Blocks of items, read one after the other."""
    rows = (benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("i"),
                             F.col(f"`{text_col}`").alias("t")).orderBy("i", "t"))
    block, size = [], 0
    for r in rows.toLocalIterator():
        words = words_of(r["t"])
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield TestBlock(block, window)
            block, size = [], 0
        block.append((r["i"], words))
        size += len(words)
    if block:
        yield TestBlock(block, window)


test_blocks.__test__ = False


def _merge_runs(a: list, b: list) -> list[int]:
    runs = sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])])
    out: list[int] = []
    for s, e in runs:
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _pass(df: DataFrame, text_col: str, block: TestBlock) -> DataFrame:
    """One block against all documents; adds to the carried columns."""
    shared = df.sparkSession.sparkContext.broadcast(block)  # at most block_words words
    position, first = df.columns.index(text_col), df.columns.index("__words__")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, position, PIECE_BYTES):
                texts = part.column(position).to_pylist()
                before = [part.column(first + k).to_pylist() for k in (1, 2, 3)]
                found = shared.value.search(texts)
                columns = [[f[0] for f in found],
                           [_merge_runs(h, f[1].tolist()) for h, f in zip(before[0], found)],
                           [sorted({*i, *f[2]}) for i, f in zip(before[1], found)],
                           [m + [dict(zip(MATCH.names, x)) for x in f[3]] for m, f in zip(before[2], found)]]
                arrays = [part.column(i) for i in range(first)]
                arrays += [pa.array(c, type=part.schema.field(first + k).type) for k, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=part.schema.names)

    return df.mapInArrow(run, df.schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", keep: list[str] | None = None, window: int = WINDOW,
                       block_words: int = BLOCK_WORDS, keep_text: bool = False) -> DataFrame:
    """``keep`` columns plus n_words, n_hit, n_items, items_sha256, contaminated and
    matches (the longest verbatim matches of a document)."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    results = [T.StructField(n, T.StringType()) for n in
               ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches")]
    kept = result_name_free(keep, results)
    carried = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text__"),
                          F.lit(0).cast("long").alias("__words__"),
                          *[F.array().cast(f.dataType).alias(f.name) for f in _CARRIED[1:]])
    blocks = 0
    for block in test_blocks(benchmark, item_col, item_text_col, window, block_words):
        carried = _pass(checkpointed(carried) if blocks else carried, "__text__", block)
        blocks += 1
    if not blocks:
        carried = _pass(carried, "__text__", TestBlock([], window))
    hits = F.col("__hits__")
    n_hit = F.aggregate(hits, F.struct(F.lit(-1).alias("s"), F.lit(0).cast("long").alias("n")),
                        lambda acc, x: F.when(acc["s"] < 0, F.struct(x.alias("s"), acc["n"].alias("n")))
                        .otherwise(F.struct(F.lit(-1).alias("s"), (acc["n"] + x - acc["s"]).alias("n"))),
                        lambda acc: acc["n"])
    return carried.select(
        *[F.col(f"`{c}`") for c in kept], *([F.col("__text__").alias(text_col)] if keep_text else []),
        F.col("__words__").alias("n_words"), n_hit.alias("n_hit"),
        F.size("__items__").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "__items__"), 256).alias("items_sha256"),
        (F.size("__items__") > 0).alias("contaminated"), F.col("__matches__").alias("matches"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows without a hit, all columns untouched: one map over the documents."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").alias("body"))
    found = find_contamination(packed, benchmark, text_col="body", keep=["row"], **options)
    return found.where(~F.col("contaminated")).select("row.*")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_SQL_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"""
_SQL_GRAMS = "unnest(list_transform(range(1, len(w) - n + 2), lambda p: {'p': p, 'k': array_to_string(w[p:p + n - 1], ' ')}))"
ORACLE = f"""
WITH dw AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
iw AS (SELECT cast(item_id AS VARCHAR) AS item_id, {_SQL_WORDS} AS w FROM benchmark),
ig AS (SELECT item_id, n, {_SQL_GRAMS} AS g FROM (SELECT *, least({WINDOW}, len(w)) AS n FROM iw WHERE len(w) > 0)),
win AS (SELECT DISTINCT item_id, n, g.k AS k FROM ig),
dg AS (SELECT doc_id, n, {_SQL_GRAMS} AS g
       FROM (SELECT doc_id, w, n FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT dg.doc_id, dg.g.p AS p, dg.n AS n, win.item_id FROM dg JOIN win ON dg.n = win.n AND dg.g.k = win.k),
marks AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
       FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT dw.doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN marks USING (doc_id) LEFT JOIN it USING (doc_id)
"""
