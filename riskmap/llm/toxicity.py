"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained in numpy.

A word is the bag of its character n-grams (3 to 6, with word marks) and itself,
hashed into ``2**BITS`` buckets.  Each bucket has a vector of ``DIM`` numbers; a word
is the mean of its bucket vectors, a window of words the mean of its words, and a
linear softmax over {clean, toxic} reads the window vector.  Embeddings and softmax
are learned jointly by gradient steps.  A document is as toxic as its most toxic
window, so a few words count alike in a short and in a very long text: training
first gives every window its document's label, then follows the worst window of
each document.  Unseen misspellings share n-gram buckets with known words.

The sample holds about ``train_rows`` rows and never more than ``train_bytes`` text
bytes (documented bounds; a longer single text is not learned from), which is all that
reaches the driver.  The model is one vector
of ``2**BITS`` margins: the softmax is linear, so a word needs a single number.

Defined cases: a null text counts as empty; a text without words gets the score of
the bias alone; without training rows the score is 0; whole texts are scored; a null
id is neither learned from nor held out; repeated rows score alike.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmap.llm.common import crc_class, labelled_sample, map_text, table

BITS = 18
DIM = 8
GRAMS = (3, 4, 5, 6)
WINDOW = 4
TRAIN_ROWS = 8_000
TRAIN_BYTES = 24 << 20
CACHE_WORDS = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def subword_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all words joined, and where each word starts."""
    marked = [f"<{w}>" for w in words]
    flat = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32)
    lengths = np.array([len(m) for m in marked], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    ends, owner = starts + lengths, np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(flat))
    h = np.full(len(flat), 2166136261, dtype=np.uint32)
    ids, owners = [], []
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(flat * (np.uint32(2654435761) * ((at - starts[owner]).astype(np.uint32) * np.uint32(2) + np.uint32(1))), starts,
                                dtype=np.uint32)
        whole = (whole ^ (whole >> np.uint32(13))) * np.uint32(0x85EBCA6B)
        ids.append((whole ^ (whole >> np.uint32(16))) >> np.uint32(32 - BITS))
        owners.append(np.arange(len(words)))
        for k in range(GRAMS[-1]):
            inside = at + k < len(flat)
            h[inside] = (h[inside] ^ flat[at[inside] + k]) * np.uint32(16777619)
            if k + 1 >= GRAMS[0]:
                ok = at + k < ends[owner]
                mixed = (h[ok] ^ (h[ok] >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                ids.append((mixed ^ (mixed >> np.uint32(13))) >> np.uint32(32 - BITS))
                owners.append(owner[ok])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    sizes = np.bincount(owners, minlength=len(words))
    return (np.concatenate(ids)[order].astype(np.int64),
            np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64))


def vocabulary_buckets(words: list[str], step: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket ids, starts and bucket counts of many words, a part at a time."""
    parts, sizes = [], []
    for i in range(0, len(words), step):
        ids, starts = subword_buckets(words[i:i + step])
        parts.append(ids.astype(np.int32))
        sizes.append(np.diff(np.concatenate([starts, [len(ids)]])))
    sizes = np.concatenate(sizes)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes


def window_means(values: np.ndarray) -> np.ndarray:
    """Means of all runs of ``WINDOW`` values (of all values, if there are fewer)."""
    if len(values) <= WINDOW:
        return np.array([values.mean()]) if len(values) else np.zeros(0)
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[WINDOW:] - total[:-WINDOW]) / WINDOW


class SubwordSoftmax:
    """``margin[b]`` is what bucket b adds to (toxic - clean); ``bias`` the rest."""

    def __init__(self, margin: np.ndarray | None = None, bias: float = -50.0):
        self.margin = np.zeros(1 << BITS, dtype=np.float32) if margin is None else margin
        self.bias = bias

    def word_margins(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        ids, starts = subword_buckets(words)
        sizes = np.diff(np.concatenate([starts, [len(ids)]]))
        return np.add.reduceat(self.margin[ids].astype(np.float64), starts) / sizes

    def score(self, texts: list, cache: dict) -> list[float]:
        if len(cache) > CACHE_WORDS:
            cache.clear()
        docs = [words_of(t) for t in texts]
        new = sorted({w for d in docs for w in d if w not in cache})
        for i in range(0, len(new), 20_000):
            part = new[i:i + 20_000]
            cache.update(zip(part, self.word_margins(part).tolist()))
        best = []
        for d in docs:
            means = window_means(np.fromiter(map(cache.__getitem__, d), dtype=np.float64, count=len(d)))
            best.append(means.max() if len(means) else 0.0)
        return (1 / (1 + np.exp(-np.clip(np.array(best) + self.bias, -500, 500)))).tolist()


def fit(texts: list[str], labels: list[int], rounds: int = 200, seed: int = 7,
        rate: float = 0.4) -> SubwordSoftmax:
    """Adagrad on the logistic loss.  The gradient of a bucket vector is a number
    times the softmax difference, so a round costs one pass over the windows."""
    if not texts or len(set(labels)) < 2:
        return SubwordSoftmax()
    index: dict[str, int] = {}
    ids, filled = [], np.zeros(len(texts), dtype=np.int64)
    for d, text in enumerate(texts):
        own = [index.setdefault(w, len(index)) for w in words_of(text)]
        own += own[-1:] * (-len(own) % WINDOW) if own else []
        ids.append(np.array(own, dtype=np.int32))
        filled[d] = len(own) // WINDOW
    windows = np.concatenate(ids).reshape(-1, WINDOW)
    if not len(windows):
        return SubwordSoftmax()
    doc_of, y = np.repeat(np.arange(len(texts), dtype=np.int32), filled), np.array(labels, dtype=float)
    del ids
    grams, starts, sizes = vocabulary_buckets(list(index))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias, n_pos = -3.0, max(1.0, y.sum())
    emb_sq, soft_sq, bias_sq = np.full(1 << BITS, 1e-8), np.full(DIM, 1e-8), 1e-8
    heavy = np.where(y > 0, (len(y) - n_pos) / n_pos, 1.0)  # classes weigh alike
    firsts = np.concatenate([[0], np.flatnonzero(np.diff(doc_of)) + 1])  # windows lie by document
    counts = np.diff(np.concatenate([firsts, [len(doc_of)]]))
    spread = (heavy[doc_of] / np.repeat(counts, counts)).astype(np.float64)
    for step in range(rounds):
        diff = soft[:, 1] - soft[:, 0]
        word = np.add.reduceat((emb @ diff)[grams], starts) / sizes
        logit = sum(word[windows[:, k]] for k in range(WINDOW)) / WINDOW + bias
        if step < rounds // 8:  # every window under its document's label
            use, weight = slice(None), spread
        else:  # the worst window of each document
            worst = np.flatnonzero(logit == np.repeat(np.maximum.reduceat(logit, firsts), counts))
            use = worst[np.unique(doc_of[worst], return_index=True)[1]]
            weight = heavy[doc_of[use]]
        g = weight * (1 / (1 + np.exp(-np.clip(logit[use], -500, 500))) - y[doc_of[use]])
        g /= weight.sum()
        per_word = np.bincount(windows[use].ravel(), weights=np.repeat(g / WINDOW, WINDOW), minlength=len(index))
        per_bucket = np.zeros(1 << BITS)
        near = np.flatnonzero(per_word)
        for i in range(0, len(near), 50_000):  # a part of the words at a time
            part = near[i:i + 50_000]
            size = sizes[part]
            at = np.repeat(starts[part] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            at += np.arange(len(at))
            per_bucket += np.bincount(grams[at], weights=np.repeat(per_word[part] / size, size), minlength=1 << BITS)
        grad_soft = emb.T @ per_bucket
        touched = np.flatnonzero(per_bucket)
        emb_sq[touched] += per_bucket[touched] ** 2 * float(diff @ diff)
        emb[touched] -= (rate * per_bucket[touched] / np.sqrt(emb_sq[touched]))[:, None] * diff[None, :]
        soft_sq += grad_soft ** 2
        change = 0.1 * rate * grad_soft / np.sqrt(soft_sq)
        soft[:, 1] -= change
        soft[:, 0] += change
        bias_sq += g.sum() ** 2
        bias -= rate * g.sum() / np.sqrt(bias_sq)
    return SubwordSoftmax((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label: str = "toxic", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> SubwordSoftmax:
    sample = labelled_sample(docs, labels, label, id_col, text_col, train_rows, train_bytes)
    got = sample.orderBy("_lid", "text").collect()  # <= train_rows rows, train_bytes
    texts, known = [r["text"] for r in got], [r["y"] for r in got]
    del got
    return fit(texts, known)


def score_toxicity(docs: DataFrame, model: SubwordSoftmax, text_col: str = "text",
                   keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``keep`` columns (all by default, but for the text) plus score and predicted."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats: 1 MiB

    def start():
        cache: dict = {}

        def fn(texts):
            score = shared.value.score(texts, cache)
            return [score, [int(s >= threshold) for s in score]]
        return fn

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_text(docs, text_col, keep, fields, start)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_class("doc_id") == 0, F.lit(False)).alias("held_out"),
                         "score", "predicted")
