"""Importance resampling towards a target distribution, on n-gram buckets.

Every text is normalised (A-Z lower-cased, words of digits, a-z and non-ASCII
characters, one space before each) and scanned once; the CRC-32 of the prefix is
stored behind every word.  The CRC of any run of words then follows from two stored
prefixes: crc(XY) = shift(crc(X), |Y|) xor crc(Y), where ``shift`` is the linear map
over GF(2) that appends |Y| zero bytes, so the earlier prefix is shifted and
cancelled.  No n-gram is ever cut out or hashed by itself.

A feature is a run of 1 to ``width`` words, its bucket the CRC modulo ``buckets``.
With S and s (T and t) the features of all source (target) texts and those in the
bucket, a bucket's gain is floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))).  A document's
weight is the floored mean gain of its features; its score adds Gumbel noise from a
keyed hash of the id, so the highest scores are a draw without replacement in
proportion to exp(weight / 1000).  Of the documents with ``least_words`` words, the
``percent`` per cent with the highest scores are drawn.

Only ``buckets`` counts per task are shuffled and ``buckets`` gains broadcast.  The
scores of the drawn share are ranked by range partitions: the driver sees a count per
score (gains and noise bound their number) and a count per partition.

Defined cases: null and empty texts have no words, weight 0, and are never drawn when
``least_words`` > 0; a null id is hashed as the empty text and comes after all others
in a tie; repeated rows are scored and ranked each for itself; an empty source gives
an empty result, an empty target counts T = 0; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmap.llm.common import checkpointed, globally_ranked, map_text, pieces, table

BUCKETS = 10_000
WIDTH = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
_NEAR = 64  # shifts by fewer bytes have an operator of their own
#: bytes of words stay (A-Z in lower case), all others become spaces
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))


def _apply(operator: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map, given as four tables of 256, on CRCs."""
    return (operator[0][crc & 255] ^ operator[1][(crc >> 8) & 255]
            ^ operator[2][(crc >> 16) & 255] ^ operator[3][crc >> 24])


@functools.cache
def shift_operators() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps that append 0.._NEAR-1 zero bytes, and those that append 2**k."""
    byte = np.arange(256, dtype=np.uint32)
    one = byte.copy()
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    values = [byte << np.uint32(8 * k) for k in range(4)]
    near = [np.stack(values)]
    for _ in range(_NEAR):
        values = [(v >> np.uint32(8)) ^ one[v & 255] for v in values]
        near.append(np.stack(values))
    powers = [near[1]]
    for _ in range(40):
        powers.append(np.stack([_apply(powers[-1], row) for row in powers[-1]]))
    return np.stack(near[:_NEAR]), powers


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs after appending ``length`` zero bytes each."""
    near, powers = shift_operators()
    short = length < _NEAR
    at = np.where(short, length, 0) * 1024
    flat = near.reshape(-1)
    out = flat[at + (crc & 255)]
    for k in (1, 2, 3):
        out ^= flat[at + (256 * k) + ((crc >> np.uint32(8 * k)) & 255)]
    far = np.flatnonzero(~short)
    if len(far):
        value, n = crc[far], length[far]
        for k, operator in enumerate(powers):
            bit = (n >> k) & 1 == 1
            if bit.any():
                value[bit] = _apply(operator, value[bit])
        out[far] = value
    return out


def running_crcs(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words of all texts: CRC of the normalised text up to the word's end,
    the word's bytes; and the word bounds of the texts."""
    ends, sizes, bounds = [], [], [0]
    for text in texts:
        words = text.encode("utf-8", "replace").translate(_WORD_BYTES).split() if text else []
        crc = 0
        for word in words:
            crc = crc32(word, crc32(b" ", crc))
            ends.append(crc)
        sizes.extend(map(len, words))
        bounds.append(len(ends))
    return np.array(ends, dtype=np.uint32), np.array(sizes, dtype=np.int64), np.array(bounds, dtype=np.int64)


def features(texts: list, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc, text) of every run of 1 to ``width`` words, and the words of each text."""
    ends, sizes, bounds = running_crcs(texts)
    n_words = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), n_words)
    before = np.concatenate([[0], ends[:-1]]).astype(np.uint32) if len(ends) else ends
    before[bounds[:-1][n_words > 0]] = 0
    starts = shift(before, np.ones(len(ends), dtype=np.int64)) ^ np.uint32(crc32(b" "))
    reach = np.concatenate([[0], np.cumsum(sizes + 1)])
    crcs, owners = [], []
    for k in range(1, width + 1):
        if len(ends) < k:
            break
        first = np.flatnonzero(owner[:len(owner) - k + 1] == owner[k - 1:])
        length = reach[first + k] - reach[first] - 1
        crcs.append(ends[first + k - 1] ^ shift(starts[first], length))
        owners.append(owner[first])
    if not crcs:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), n_words
    return np.concatenate(crcs), np.concatenate(owners), n_words


def bucket_counts(df: DataFrame, text_col: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket; empty buckets are absent."""
    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, 0):
                crcs, _, _ = features(part.column(0).to_pylist(), width)
                total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return (df.select(F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket from two ``bucket_counts`` (``buckets`` rows each at most)."""
    counts = []
    for frame in (source, target):
        n = np.zeros(buckets, dtype=np.int64)
        for row in frame.collect():
            n[row["bucket"]] = row["n"]
        counts.append(n.tolist())
    s_all, t_all = float(sum(counts[0]) + buckets), float(sum(counts[1]) + buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(*counts)],
                    dtype=np.int64)


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
            width: int = WIDTH) -> DataFrame:
    """id, n_words, n_features and weight of every row."""
    def start():
        def fn(texts):
            crcs, owner, n_words = features(texts, width)
            n = np.bincount(owner, minlength=len(texts))
            order = np.argsort(owner, kind="stable")
            sums = np.concatenate([[0], np.cumsum(gains[crcs[order] % np.uint32(len(gains))])])
            stops = np.cumsum(n)
            total = sums[stops] - sums[stops - n]
            return [pa.array(n_words), pa.array(n.astype(np.int64)), pa.array(total // np.maximum(n, 1))]
        return fn

    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    return map_text(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_doc")),
                    "_doc", ["_id"], fields, start)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", width: int = WIDTH, buckets: int = BUCKETS, percent: int = PERCENT,
             least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row's id, n_features, weight, score and rank (null where not drawn)."""
    gains = bucket_gains(bucket_counts(docs, text_col, width, buckets),
                         bucket_counts(target, target_text_col, width, buckets), buckets)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = checkpointed(weights(docs, gains, id_col, text_col, width)
                          .withColumn("score", F.col("weight") + noise.cast("long")))
    able = F.col("n_words") >= least_words
    # scores are bounded integers: one row each
    by_score = sorted(((r["score"], r["n"]) for r in scored.where(able).groupBy("score")
                       .agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    draw = percent * sum(n for _, n in by_score) // 100
    cut, seen = math.inf, 0
    for score, n in by_score:
        if seen >= draw:
            break
        cut, seen = score, seen + n
    near = able & (F.col("score") >= F.lit(cut if seen else 0)) & F.lit(seen > 0)
    ranked = globally_ranked(scored.where(near), [F.col("score").desc(), F.col("_id").asc_nulls_last()])
    rank = F.col("_rank") + 1
    shown = [F.col("_id").alias(id_col), "n_features", "weight", "score"]
    return (ranked.select(*shown, F.when(rank <= draw, rank).alias("rank"))
            .unionByName(scored.where(~near).select(*shown, F.lit(None).cast("long").alias("rank"))))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 by nibbles over the hex digits of every distinct feature.
ORACLE = r"""
WITH texts AS (
    SELECT 0 AS side, row_number() OVER () AS id, doc_id, text FROM documents
    UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
split AS (
    SELECT side, id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
words AS (SELECT side, id, unnest(w) AS w, unnest(range(len(w))) AS p FROM split),
neighbours AS (SELECT side, id, w, lead(w) OVER (PARTITION BY side, id ORDER BY p) AS follower FROM words),
runs AS (SELECT side, id, w AS f FROM words
         UNION ALL SELECT side, id, w || ' ' || follower FROM neighbours WHERE follower IS NOT NULL),
nibbles AS (
    SELECT list(list_reduce([n::BIGINT, 0, 0, 0, 0],
        lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS t
    FROM (SELECT unnest(range(16)) AS n)),
digits AS (
    SELECT f, list_transform(range(len(x)), lambda i: (instr('0123456789ABCDEF',
        x[(CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END)::INT]) - 1)::BIGINT) AS d
    FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM runs))),
buckets AS (
    SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, d),
        lambda a, b: xor(nibbles.t[(xor(a, b) & 15) + 1], a >> 4)), 4294967295) % 10000 AS bucket
    FROM digits, nibbles),
counted AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t
            FROM runs JOIN buckets USING (f) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counted),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
          FROM counted, totals),
weighed AS (SELECT id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
            FROM runs JOIN buckets USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (
    SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
               + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM split LEFT JOIN weighed USING (id) WHERE side = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS r,
                  count(*) OVER (PARTITION BY able) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 25 * n // 100 THEN r END AS rank FROM ranked
"""
