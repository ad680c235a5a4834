"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a few bounded statistics (shares, ratios, log lengths).  Each
statistic is binned by quantiles of the training sample.  Boosting goes round the
features in cycles: each turn fits a shallow tree (at most four leaves) to the
logistic gradient of one feature and adds it to that feature's lookup table.  Then
the pairs with the largest remaining gain get two-way tables, boosted in the same
way.  A score is the logistic of an intercept plus the table entries of a row's
bins: a few vectorised additions.

The sample holds about ``train_rows`` labelled rows at most; only their statistics
(a few numbers a row) reach the driver, where the tables are fitted in numpy.

Defined cases: a null text counts as empty; empty texts are scored like any other;
without training rows the score is 0.5; a null id is neither learned from nor held
out; repeated rows score alike.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmap.llm.common import crc_class, filter_text, labelled_sample, map_text, table

TRAIN_ROWS = 40_000
THRESHOLD = 0.3
BINS = 48
PAIR_BINS = 12
FEATURES = ("log_words", "mean_word", "upper", "symbols", "digits", "exclaim", "bars", "marked_words",
            "unique_words", "top_word", "repeats", "line_dups", "words_per_line", "long_words",
            "sentence_ends", "same_bigrams", "caps_words", "log_longest_word")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'"]] = True
_MARKED = re.compile(r"[#$%&*@^~+=<>{}\[\]\\/|_]")


def statistics(text: str | None) -> list[float]:
    """The numbers in ``FEATURES`` of one whole text."""
    text = text or ""
    words = text.split()
    n = len(words)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    size = max(1, len(raw))
    counts = np.bincount(raw, minlength=256)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    bigrams = set(zip(words, words[1:]))
    one = max(1, n)
    lengths = list(map(len, words))
    caps = sum(1 for w in seen if len(w) > 1 and w.isupper())
    marked = sum(c for w, c in seen.items() if _MARKED.search(w))
    return [
        float(np.log1p(n)),
        sum(lengths) / one,
        float(counts[65:91].sum()) / size,
        float(counts[_SYMBOL].sum()) / size,
        float(counts[48:58].sum()) / size,
        float(counts[33]) / one,
        float(counts[124]) / one,
        marked / one,
        len(seen) / one,
        (max(seen.values()) / one) if seen else 0.0,
        sum(map(str.__eq__, words, words[1:])) / one,
        1.0 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
        sum(1 for x in lengths if x > 14) / one,
        float(counts[46] + counts[63]) / one,
        1.0 - len(bigrams) / max(1, n - 1),
        caps / max(1, len(seen)),
        float(np.log1p(max(lengths, default=0))),
    ]


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int = 4, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Best greedy split of an ordered histogram into at most ``leaves`` runs:
    the update of each bin and the gain."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    value = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    runs, gain = [(0, len(grad))], 0.0
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for i, (a, b) in enumerate(runs):
            if b - a < 2:
                continue
            cut = np.arange(a + 1, b)
            gains = ((g[cut] - g[a]) ** 2 / (h[cut] - h[a] + ridge)
                     + (g[b] - g[cut]) ** 2 / (h[b] - h[cut] + ridge) - value(a, b))
            k = int(gains.argmax())
            if gains[k] > best[0]:
                best = (float(gains[k]), i, int(cut[k]))
        if best[1] is None:
            break
        a, b = runs.pop(best[1])
        runs += [(a, best[2]), (best[2], b)]
        gain += best[0]
    out = np.zeros(len(grad))
    for a, b in runs:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out, gain


def _tree_2d(grad: np.ndarray, hess: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """A depth-two tree on a grid: one cut of the rows, then each half cuts the columns."""
    best = (0.0, np.zeros_like(grad))
    total = grad.sum() ** 2 / (hess.sum() + ridge)
    for cut in range(1, grad.shape[0]):
        update, gain = np.zeros_like(grad), -total
        for part in (slice(0, cut), slice(cut, None)):
            g, h = grad[part].sum(axis=0), hess[part].sum(axis=0)
            values, more = _tree(g, h, leaves=2, ridge=ridge)
            update[part] = values
            gain += more + g.sum() ** 2 / (h.sum() + ridge)
        if gain > best[0]:
            best = (gain, update)
    return best[1], best[0]


class AdditiveModel:
    """Lookup tables per feature and per chosen pair of features."""

    def __init__(self):
        self.edges: list[np.ndarray] = []
        self.pair_edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        self.intercept = 0.0

    @staticmethod
    def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 150, n_pairs: int = 6,
            pair_rounds: int = 40, rate: float = 0.15) -> AdditiveModel:
        if len(y) == 0:
            x = np.zeros((0, len(FEATURES)))
        def cut(k):
            return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, k + 1)[1:-1])) if len(y) else np.zeros(0)
                    for j in range(x.shape[1])]
        self.edges, self.pair_edges = cut(BINS), cut(PAIR_BINS)
        bins, coarse = self._binned(x, self.edges), self._binned(x, self.pair_edges)
        p = min(max(y.mean() if len(y) else 0.5, 1e-4), 1 - 1e-4)
        self.intercept = float(np.log(p / (1 - p)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        margin = np.full(len(y), self.intercept)

        def histogram(index, n):
            prob = 1 / (1 + np.exp(-margin))
            return (np.bincount(index, weights=y - prob, minlength=n),
                    np.bincount(index, weights=prob * (1 - prob), minlength=n))

        for _ in range(rounds if len(y) else 0):
            for j, t in enumerate(self.tables):
                step, _gain = _tree(*histogram(bins[:, j], len(t)))
                t += rate * step
                margin += rate * step[bins[:, j]]
        wide = [len(e) + 1 for e in self.pair_edges]
        index = lambda a, b: coarse[:, a] * wide[b] + coarse[:, b]
        grid = lambda a, b: [v.reshape(wide[a], wide[b]) for v in histogram(index(a, b), wide[a] * wide[b])]
        gains = sorted(((_tree_2d(*grid(a, b))[1], a, b) for a in range(len(wide)) for b in range(a + 1, len(wide))),
                       reverse=True) if len(y) else []
        self.pairs = [(a, b) for _, a, b in gains[:n_pairs]]
        self.pair_tables = [np.zeros((wide[a], wide[b])) for a, b in self.pairs]
        for _ in range(pair_rounds):
            for (a, b), t in zip(self.pairs, self.pair_tables):
                step, _gain = _tree_2d(*grid(a, b))
                t += rate * step
                margin += rate * step[coarse[:, a], coarse[:, b]]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins, coarse = self._binned(x, self.edges), self._binned(x, self.pair_edges)
        margin = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            margin += t[bins[:, j]]
        for (a, b), t in zip(self.pairs, self.pair_tables):
            margin += t[coarse[:, a], coarse[:, b]]
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label: str = "quality", train_rows: int = TRAIN_ROWS) -> AdditiveModel:
    sample = labelled_sample(docs, labels, label, id_col, text_col, train_rows)
    fields = [T.StructField("x", T.ArrayType(T.DoubleType()))]
    rows = map_text(sample, "text", ["_lid", "y"], fields, lambda: lambda texts: [[statistics(t) for t in texts]])
    got = sorted(((r["_lid"], r["y"], r["x"]) for r in rows.collect()), key=lambda r: (r[0], r[2]))  # <= train_rows rows
    return AdditiveModel().fit(np.array([r[2] for r in got]), np.array([r[1] for r in got], dtype=float))


def score_quality(docs: DataFrame, model: AdditiveModel, text_col: str = "text",
                  keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns (all by default, but for the text) plus score and predicted."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep

    def fn(texts):
        score = model.predict(np.array([statistics(t) for t in texts]))
        return [score.tolist(), [int(s >= threshold) for s in score]]

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_text(docs, text_col, keep, fields, lambda: fn)


def keep_good(docs: DataFrame, model: AdditiveModel, text_col: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` predicted 1, all columns untouched."""
    return filter_text(docs, text_col, lambda: lambda texts: [
        bool(s >= threshold) for s in model.predict(np.array([statistics(t) for t in texts]))])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_class("doc_id") == 0, F.lit(False)).alias("held_out"),
                         "score", "predicted")
