"""Bigram language model by deleted interpolation.

P(w|v) = l2(b) c(vw)/c(v) + l1(b) c(w)/N + l0(b)/(V+1), where b is the frequency
bucket of the context v (powers of two).  The weights of each bucket are learned by
expectation-maximisation on deleted counts: every training token is held out in turn
(its own occurrence is taken off c(vw), c(v), c(w) and N) and the mixture must
predict it.  The events are gathered into a histogram of fixed size, so an EM round
costs nothing and covers the whole corpus.

Tokens are the words of the text after lower-casing A-Z, then one end token.  The
counts grow with the corpus and are never broadcast or collected:

1. documents are packed into chunks of bounded bytes with a vocabulary of their own;
2. every chunk sends its distinct bigram and word keys with its training counts to
   hash buckets (bounded keys a bucket, a key at most once a chunk, so a frequent
   word is one record a chunk);
3. a bucket adds the counts up and replies to each chunk with its keys' totals;
4. a chunk joins its replies, and its documents are scored from them.

Keys are 64-bit hashes of words and 56-bit hashes of bigrams; a collision, expected
in far fewer than one in a million keys, would merge two counts.

Defined cases: a null or empty text is the end token alone; a null id is learned
from and not held out; without training tokens P is uniform over one unknown word;
repeated rows are counted and scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmap.llm.common import checkpointed, crc_class, table

CHUNK_BYTES = 16 << 20
CONTEXT_BUCKETS = 40
STEPS = 4  # histogram cells per factor of two
LEVELS = 48 * STEPS
_END, _START = 0, 1
_KEY_BITS = 56


class _Vocab(dict):
    def __missing__(self, word):
        self[word] = n = len(self) + 2
        return n


def tokens_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def _packed(array: np.ndarray) -> bytes:
    """An unsigned array as compressed byte planes (small numbers cost little)."""
    import zstandard

    planes = np.ascontiguousarray(array.view(np.uint8).reshape(len(array), array.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, dtype) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data)), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(dtype).ravel()


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def _pack_chunks(id_type: T.DataType):
    """(id, held, text) rows -> chunk rows."""
    schema = T.StructType([
        T.StructField("chunk", T.StringType()), T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("tokens", T.BinaryType()), T.StructField("hashes", T.BinaryType()),
        T.StructField("train_tokens", T.LongType())])

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part, seq = to_arrow_schema(schema), TaskContext.get().partitionId(), 0
        ids, held, sizes, flat, vocab, total = [], [], [], [], _Vocab(), 0

        def row():
            tokens = np.concatenate(flat)
            # ids by falling frequency, so that the byte planes compress
            counts = np.bincount(tokens, minlength=len(vocab) + 2)
            order = np.concatenate([[_END, _START], 2 + np.argsort(-counts[2:], kind="stable")])
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order))
            hashes = np.array([_hash(b" "), _hash(b"  ")] + [_hash(w) for w in vocab], dtype=np.uint64)[order]
            train = sum(n for n, h in zip(sizes, held) if not h)
            return pa.RecordBatch.from_pydict(
                {"chunk": [f"{part}-{seq}"], "ids": [ids], "held": [held], "sizes": [sizes],
                 "tokens": [_packed(rank[tokens])], "hashes": [hashes.tobytes()], "train_tokens": [train]}, schema=arrow)

        for batch in batches:
            for i, h, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                words = tokens_of(text)
                flat.append(np.fromiter(map(vocab.__getitem__, words), dtype=np.int64, count=len(words)))
                flat.append(np.zeros(1, dtype=np.int64))
                ids.append(i)
                held.append(bool(h))
                sizes.append(len(words) + 1)
                total += len(text or "")
                if total >= CHUNK_BYTES:
                    yield row()
                    ids, held, sizes, flat, vocab, total = [], [], [], [], _Vocab(), 0
                    seq += 1
        if ids:
            yield row()

    return run, schema


def _pairs(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous, current) codes: the distinct ones, the index of each position, text starts."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    previous = np.empty(len(tokens), dtype=np.int64)
    previous[1:] = tokens[:-1]
    previous[starts] = _START
    distinct, index = np.unique((previous << 32) | tokens.astype(np.int64), return_inverse=True)
    return distinct, index, starts


def _pair_keys(distinct: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = hashes[distinct >> 32] * np.uint64(0x9E3779B97F4A7C15) + hashes[distinct & 0xFFFFFFFF]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(64 - _KEY_BITS)


def _bucket_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Monotone in the key, so that sorted keys are sorted buckets."""
    return ((keys >> np.uint64(bits - 32)).astype(np.uint64) * np.uint64(buckets)) >> np.uint64(32)


def _cuts(keys: np.ndarray, bits: int, buckets: int):
    """(bucket, from, to) runs of sorted keys."""
    bucket = _bucket_of(keys, bits, buckets)
    at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]]).astype(np.int64)
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(at[:-1], at[1:]) if b > a]


def _chunk_keys(row) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(kind, bits, sorted order, keys) of a chunk: kind 0 bigrams, kind 1 words."""
    tokens, sizes = _unpacked(row["tokens"], np.uint32), np.asarray(row["sizes"], dtype=np.int64)
    hashes = np.frombuffer(bytes(row["hashes"]), dtype=np.uint64)
    distinct, index, starts = _pairs(tokens, sizes)
    keys = _pair_keys(distinct, hashes)
    return tokens, sizes, starts, distinct, index, [
        (0, _KEY_BITS, np.argsort(keys, kind="stable"), keys), (1, 64, np.argsort(hashes, kind="stable"), hashes)]


def _send_keys(buckets: int):
    """Chunk rows -> (kind, bucket, chunk, keys, counts) rows."""
    schema = "kind int, bucket bigint, chunk string, keys binary, counts binary"

    def run(batches):
        names = ["kind", "bucket", "chunk", "keys", "counts"]
        types = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.string()),
                           ("keys", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                tokens, sizes, _, distinct, index, parts = _chunk_keys(row)
                train = np.repeat(~np.array(row["held"], dtype=bool), sizes)
                words = np.bincount(tokens[train], minlength=len(parts[1][3]))
                words[_START] = int((~np.array(row["held"], dtype=bool)).sum())
                counts = [np.bincount(index[train], minlength=len(distinct)), words]
                out = {n: [] for n in names}
                for (kind, bits, order, keys), c in zip(parts, counts):
                    keys, c = keys[order], c[order].astype(np.uint32)
                    for bucket, a, b in _cuts(keys, bits, buckets):
                        steps = np.diff(keys[a:b], prepend=np.uint64(0))  # sorted: differences are short
                        for n, v in zip(names, (kind, bucket, row["chunk"], _packed(steps), _packed(c[a:b]))):
                            out[n].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=types)

    return run, schema


def _add_up(key, rows):
    """One bucket: totals of its keys, answered to every chunk in its own key order."""
    import pandas as pd

    keys = [np.cumsum(_unpacked(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
    counts = [_unpacked(c, np.uint32) for c in rows["counts"]]
    distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(index, weights=np.concatenate(counts), minlength=len(distinct))
    kind = int(key[0])
    start = np.uint64(_hash(b"  "))
    types = int(((totals > 0) & (distinct != start)).sum()) if kind == 1 else 0
    ends = np.cumsum([len(k) for k in keys])
    replies = [_packed(totals[index[e - len(k):e]].astype(np.uint64)) for e, k in zip(ends, keys)]
    first = [types] + [0] * (len(keys) - 1)  # the bucket's distinct training words, told once
    return pd.DataFrame({"chunk": rows["chunk"].to_numpy(), "kind": np.int32(kind), "bucket": rows["bucket"].to_numpy(),
                         "reply": replies, "types": first})


def _level(log2p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log2p * STEPS), 0, LEVELS - 1).astype(np.int64)


def _context_bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(counts + 1.0)), CONTEXT_BUCKETS - 1).astype(np.int64)


def deleted_events(pair: np.ndarray, context: np.ndarray, word: np.ndarray, weight: np.ndarray,
                   total: int) -> tuple[np.ndarray, np.ndarray]:
    """Histogram of held-out tokens: cell = (context bucket, level of p2, level of p1),
    a level of LEVELS meaning probability zero."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p2 = np.where((pair > 1) & (context > 1), (pair - 1.0) / (context - 1.0), 0.0)
        p1 = (word - 1.0) / max(1, total - 1)
        l2 = np.where(p2 > 0, _level(np.log2(np.where(p2 > 0, p2, 1.0))), LEVELS)
        l1 = np.where(p1 > 0, _level(np.log2(np.where(p1 > 0, p1, 1.0))), LEVELS)
    cell = (_context_bucket(context - 1.0) * (LEVELS + 1) + l2) * (LEVELS + 1) + l1
    cells, index = np.unique(cell, return_inverse=True)
    return cells, np.bincount(index, weights=weight, minlength=len(cells)).astype(np.int64)


def learn_weights(cells: np.ndarray, counts: np.ndarray, vocabulary: int, rounds: int = 60) -> np.ndarray:
    """EM: (l2, l1, l0) per context bucket.  A little prior keeps every weight above
    zero; bucket 0 (unseen context) has no bigram part."""
    l1, rest = cells % (LEVELS + 1), cells // (LEVELS + 1)
    l2, bucket = rest % (LEVELS + 1), rest // (LEVELS + 1)
    value = lambda level: np.where(level < LEVELS, 2.0 ** (-level / STEPS), 0.0)
    p = np.stack([value(l2), value(l1), np.full(len(cells), 1.0 / (vocabulary + 1))], axis=1)
    weights = np.full((CONTEXT_BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        part = weights[bucket] * p
        part *= (counts / part.sum(axis=1))[:, None]
        seen = np.stack([np.bincount(bucket, weights=part[:, k], minlength=CONTEXT_BUCKETS) for k in range(3)], axis=1)
        weights = seen + np.array([0.1, 0.1, 0.1])
        weights[0, 0] = 0.0
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


def _resolve(total_tokens: int, schema: T.StructType):
    """A chunk and its replies -> the chunk with the totals of its pairs and words."""
    def run(_key, chunks, replies):
        import pandas as pd

        if not len(chunks):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        row = chunks.iloc[0]
        tokens, sizes, _, distinct, index, parts = _chunk_keys(row)
        found = []
        for kind, _bits, order, keys in parts:
            mine = replies[replies["kind"] == kind].sort_values("bucket")
            values = np.concatenate([_unpacked(r, np.uint64) for r in mine["reply"]])
            totals = np.empty(len(keys), dtype=np.uint64)
            totals[order] = values
            found.append(totals)
        pair, word = found
        train = np.repeat(~np.asarray(row["held"], dtype=bool), sizes)
        weight = np.bincount(index[train], minlength=len(distinct))
        used = weight > 0
        cells, counts = deleted_events(
            pair[used].astype(float), word[distinct[used] >> 32].astype(float),
            word[distinct[used] & 0xFFFFFFFF].astype(float), weight[used], total_tokens)
        return pd.DataFrame({"ids": [row["ids"]], "held": [row["held"]], "sizes": [row["sizes"]],
                             "tokens": [row["tokens"]], "pair_totals": [_packed(pair)], "word_totals": [_packed(word)],
                             "types": [int(replies["types"].sum())], "cells": [cells], "cell_counts": [counts]})
    return run


def _score(total_tokens: int, vocabulary: int, weights: np.ndarray, schema: T.StructType):
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                tokens, sizes = _unpacked(row["tokens"], np.uint32), np.array(row["sizes"], dtype=np.int64)
                distinct, index, starts = _pairs(tokens, sizes)
                pair = _unpacked(row["pair_totals"], np.uint64).astype(float)
                word = _unpacked(row["word_totals"], np.uint64).astype(float)
                context, current = word[distinct >> 32], word[distinct & 0xFFFFFFFF]
                mix = weights[_context_bucket(context)]
                p = (mix[:, 0] * pair / np.maximum(context, 1.0) + mix[:, 1] * current / max(1, total_tokens)
                     + mix[:, 2] / (vocabulary + 1))
                base = np.log10((word + 0.5) / (total_tokens + 0.5 * (vocabulary + 1)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], arrow.field(0).type), pa.array(row["held"]), pa.array(sizes),
                    pa.array(np.add.reduceat((word[tokens] > 0).astype(np.int64), starts)),
                    pa.array(np.full(len(sizes), total_tokens, dtype=np.int64)),
                    pa.array(np.add.reduceat(base[tokens], starts)),
                    pa.array(np.add.reduceat(np.log10(p)[index], starts))], names=arrow.names)
    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    held_out_class: int = 1) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = F.coalesce(crc_class(id_col) == held_out_class, F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), held.alias("_held"), F.col(f"`{text_col}`").alias("_text"))
    id_type = rows.schema["_id"].dataType
    run, schema = _pack_chunks(id_type)
    chunks = checkpointed(rows.mapInArrow(run, schema))
    facts = chunks.agg(F.sum("train_tokens").alias("n"),
                       F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("all")).first()
    total = int(facts["n"] or 0)
    run, keys_schema = _send_keys(max(8, int(facts["all"] or 0) // 2_500_000))
    replies = (chunks.mapInArrow(run, keys_schema).groupBy("kind", "bucket")
               .applyInPandas(_add_up, "chunk string, kind int, bucket bigint, reply binary, types bigint"))
    resolved_schema = T.StructType(
        [schema["ids"], schema["held"], schema["sizes"], schema["tokens"],
         T.StructField("pair_totals", T.BinaryType()), T.StructField("word_totals", T.BinaryType()),
         T.StructField("types", T.LongType()), T.StructField("cells", T.ArrayType(T.LongType())),
         T.StructField("cell_counts", T.ArrayType(T.LongType()))])
    resolved = checkpointed(
        chunks.drop("train_tokens").groupBy("chunk").cogroup(replies.groupBy("chunk"))
        .applyInPandas(_resolve(total, resolved_schema), resolved_schema))
    vocabulary = int(resolved.agg(F.sum("types")).first()[0] or 0)
    events = (resolved.select(F.explode(F.arrays_zip("cells", "cell_counts")).alias("e"))
              .groupBy(F.col("e.cells").alias("cell")).agg(F.sum("e.cell_counts").alias("n")).toPandas())
    # at most CONTEXT_BUCKETS x (LEVELS + 1)^2 cells, few of which occur
    weights = learn_weights(events["cell"].to_numpy(dtype=np.int64), events["n"].to_numpy(dtype=float), vocabulary)
    out = T.StructType([
        T.StructField("_id", id_type), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return resolved.mapInArrow(_score(total, vocabulary, weights, out), out).withColumnRenamed("_id", id_col)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
