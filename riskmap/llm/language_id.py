"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything but letters becomes a space.  Character n-grams
of 1 to 3 code points are hashed into ``2**BITS`` buckets.  Training tasks count
buckets per language over a sample of at most about ``train_rows`` documents; the
counts become one log-probability matrix (languages x buckets, a fixed size per
language), which is broadcast.  Scoring looks up the n-grams of a batch in the
matrix and adds them up per document in numpy.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with
no training rows everything is ``und``; ties go to the language first in sorted
order; a null id is neither learned from nor held out; repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmap.llm.common import crc_class, map_text, table, thinned

BITS = 16
ORDERS = (1, 2, 3)
TRAIN_ROWS = 20_000
_MIX = (2654435761, 2246822519, 3266489917)


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def code_points(texts: list, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts joined (others are spaces), text starts, letter counts.
    Every text ends with one space, so that none is empty."""
    joined = "".join([(t.lower() if t else "") + " " for t in texts])
    flat = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).copy()
    lengths = np.array([(len(t.lower()) if t else 0) + 1 for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    is_letter = letters[flat]
    flat[~is_letter] = 32
    return flat, starts, np.add.reduceat(is_letter.astype(np.int64), starts)


def gram_buckets(flat: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram at each position; 2**BITS where it leaves its text."""
    h = np.full(len(flat), order * 40503, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(order):
            shifted = np.roll(flat, -k) if k else flat
            h = (h ^ (shifted * np.uint32(_MIX[k % 3] & 0xFFFFFFFF))) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
    out = (h >> np.uint32(32 - BITS)).astype(np.int64)
    if order > 1:
        ends = np.concatenate([starts[1:], [len(flat)]])
        for k in range(1, order):
            at = ends - k
            out[at[at >= starts]] = 1 << BITS
    return out


def count_grams(df: DataFrame, text_col: str, lang_col: str) -> dict[str, np.ndarray]:
    """Bucket counts per language.  One bounded array per language and task."""
    fields = T.StructType([T.StructField("lang", T.StringType()), T.StructField("counts", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        from riskmap.llm.common import pieces
        letters, total = _letters(), {}
        for batch in batches:
            for part in pieces(batch, 1):
                langs = np.array(part.column(0).to_pylist(), dtype=object)
                texts = np.array(part.column(1).to_pylist(), dtype=object)
                for lang in sorted(set(langs)):
                    flat, starts, _ = code_points(list(texts[langs == lang]), letters)
                    mine = total.setdefault(lang, np.zeros((1 << BITS) + 1, dtype=np.int64))
                    for order in ORDERS:
                        mine += np.bincount(gram_buckets(flat, starts, order), minlength=(1 << BITS) + 1)
        names = sorted(total)
        yield pa.RecordBatch.from_pydict(
            {"lang": names, "counts": [total[n][:-1].astype(np.int32).tobytes() for n in names]},
            schema=pa.schema([("lang", pa.string()), ("counts", pa.binary())]))

    out: dict[str, np.ndarray] = {}
    for r in df.select(lang_col, text_col).mapInArrow(run, fields).toLocalIterator():
        out[r["lang"]] = out.get(r["lang"], 0) + np.frombuffer(bytes(r["counts"]), dtype=np.int32).astype(np.int64)
    return out


class NaiveBayes:
    """``logp`` has one row per language and a last column of zeros for skipped grams."""

    def __init__(self, counts: dict[str, np.ndarray], alpha: float = 0.5):
        self.langs = sorted(counts)
        rows = []
        for lang in self.langs:
            c = counts[lang] + alpha
            rows.append(np.concatenate([np.log(c / c.sum()), [0.0]]))
        self.logp = np.array(rows, dtype=np.float32).reshape(len(self.langs), (1 << BITS) + 1)

    def score(self, texts: list, letters: np.ndarray) -> tuple[list, list]:
        if not self.langs or not texts:
            return ["und"] * len(texts), [0.0] * len(texts)
        flat, starts, n_letters = code_points(texts, letters)
        total = np.zeros((len(self.langs), len(texts)))
        for order in ORDERS:
            buckets = gram_buckets(flat, starts, order)
            for k in range(len(self.langs)):
                total[k] += np.add.reduceat(self.logp[k][buckets], starts, dtype=np.float64)
        best = total.argmax(axis=0)
        # posterior with equal priors; the largest term is 1 before normalising
        score = 1.0 / np.exp(np.clip(total - total.max(axis=0), -700, 0)).sum(axis=0)
        seen = n_letters > 0
        lang = [self.langs[b] if s else "und" for b, s in zip(best, seen)]
        return lang, [float(x) if s else 0.0 for x, s in zip(score, seen)]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          train_rows: int = TRAIN_ROWS) -> NaiveBayes:
    known = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()
                       & (crc_class(id_col) != 0))
    sample = thinned(known.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"),
                                  F.col(f"`{lang_col}`").alias("_lang")), "_id", train_rows, "_lang")
    return NaiveBayes(count_grams(sample.repartition(16), "_text", "_lang"))


def identify_language(docs: DataFrame, model: NaiveBayes, text_col: str = "text",
                      keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default, but for the text) plus lang_pred and score."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 256 KiB

    def start():
        letters, nb = _letters(), shared.value
        return lambda texts: list(nb.score(texts, letters))

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_text(docs, text_col, keep, fields, start, piece_bytes=2 << 20)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = identify_language(docs, train(docs), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_class("doc_id") == 0, F.lit(False)).alias("held_out"),
                         "lang_pred", "score")
