"""Sub-word encoding and decoding with seeded merge-dropout.

The pieces and scores come from a SentencePiece model file (never trained here, path
as a parameter; the bytes are read on the driver and sent along).  A text becomes
``U+2581`` for each space with one in front, is cut before each run of those (no
piece of the model crosses such a cut; that is checked), and each unit is merged
with an agenda of neighbouring pairs by (score, position).  When a candidate
comes off the agenda, a byte of a hash keyed by seed, whole text, place of the unit
and number of the candidate decides whether it is skipped, with probability
``dropout``.  Each occurrence of a word has draws of its own, in a text and across
texts; equal texts get equal ids, and another seed cuts them in other ways.  Only the
segmentation without a skip is cached.  With ``dropout`` 0 the result is the plain segmentation of the model; the
probability has steps of 1/256.

Decoding joins the pieces; characters outside the vocabulary travel as byte pieces,
and a ``U+2581`` of the text itself does so too, so every text decodes to itself.

Defined cases: a null text has null ids and decodes to null; an empty text has no
ids; whole texts are encoded; repeated rows give equal rows; a kept column that
shares its name with a result column is dropped.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmap.llm.common import map_text, table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 20
CACHE_UNITS = 400_000
SHORT = 40  # characters of a unit that is kept in the cache and merged by list
DRAWS = 3  # per character
ROWS = 20_000  # units merged side by side
SPACE = "▁"
_OWN = "\ud800"  # stands for a U+2581 of the text; never part of a valid text
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
_MASK = (1 << 64) - 1
_ID = (1 << 20) - 1
_NONE = 1 << 62


class PieceCoder:
    def __init__(self, model: bytes, dropout: float = DROPOUT, seed: int = SEED):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.scores: list[float] = [0.0] * n
        self.byte_ids = [0] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            self.scores[i] = sp.get_score(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece] = i
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece of the model crosses a word boundary")
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece of the model has a character that is no piece")
        #: characters of each piece, and 1 for the others
        self.chars = [1] * n
        for piece, i in self.ids.items():
            self.chars[i] = len(piece)
        order = {score: k for k, score in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        #: (left id, right id) -> rank of the merge, then the id of the merged piece
        self.merges = {(self.ids[p[:k]] << 20) | self.ids[p[k:]]: (order[self.scores[i]] << 20) | i
                       for p, i in self.ids.items() for k in range(1, len(p))
                       if p[:k] in self.ids and p[k:] in self.ids}
        self.limit = round(dropout * 256)
        self.seed = seed
        self.keys = np.array(sorted(self.merges), dtype=np.int64)
        self.found = np.array([self.merges[k] for k in self.keys.tolist()] + [_NONE], dtype=np.int64)
        self.char_ids = np.full(0x110000, -1, dtype=np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = i
        self._forget()

    def _forget(self) -> None:
        """Empties the cache: unit -> row of ``plain``, which holds candidates, start
        and number of ids in ``pool``, with nothing skipped."""
        self.cache: dict[str, int] = {}
        self.plain, self.pool = np.zeros((3, 0), dtype=np.int64), np.zeros(0, dtype=np.int32)

    def _draws(self, text: str, each: int = DRAWS) -> bytes:
        """``each`` bytes of the keyed hash for every character and the space in front;
        the candidates of a unit take them from its place on, and one is skipped if its
        byte is low.  A unit of n characters has less than 3 n candidates."""
        key = (self.seed & _MASK).to_bytes(8, "little")
        return hashlib.shake_128(key + text.encode("utf-8", "surrogatepass")).digest(each * (len(text) + 1))

    def unit_ids(self, unit: str, draws: bytes) -> tuple[int, tuple[int, ...]]:
        """Agenda merging of one unit: number of candidates, ids."""
        symbols = [self.ids.get(c, -1) for c in unit]
        if len(unit) > SHORT or unit.startswith(SPACE * 2):
            symbols, n = self._merge_heap(symbols, draws)
        else:
            symbols, n = self._merge_list(symbols, draws)
        if -1 not in symbols:
            return n, tuple(symbols)
        out: list[int] = []
        place = 0
        for s in symbols:
            if s >= 0:
                out.append(s)
                place += self.chars[s]
            else:
                out += [self.byte_ids[x] for x in (SPACE if unit[place] == _OWN else unit[place]).encode()]
                place += 1
        return n, tuple(out)

    def _merge_list(self, symbols: list[int], draws: bytes) -> tuple[list[int], int]:
        """A short unit: the agenda is the list of neighbouring pairs.  The draws are
        taken in the order of the candidates; past their end none is skipped."""
        get, limit, drawn, n = self.merges.get, self.limit, len(draws), 0
        agenda = [get((a << 20) | b, _NONE) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == _NONE:
                break
            i, piece = agenda.index(best), best & _ID
            n += 1
            if n <= drawn and draws[n - 1] < limit:
                agenda[i] = _NONE
                continue
            symbols[i] = piece
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = get((piece << 20) | symbols[i + 1], _NONE)
            if i:
                agenda[i - 1] = get((symbols[i - 1] << 20) | piece, _NONE)
        return symbols, n

    def _merge_heap(self, symbols: list[int], draws: bytes) -> tuple[list[int], int]:
        """A long unit: the agenda is a heap, so n characters take n log n steps."""
        get, limit, drawn, size = self.merges.get, self.limit, len(draws), len(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        agenda: list = []
        n = 0

        def offer(i: int, j: int) -> None:
            found = get((symbols[i] << 20) | symbols[j], _NONE)
            if found != _NONE:
                heapq.heappush(agenda, (found >> 20, i, found & _ID, symbols[i], symbols[j]))

        for i in range(size - 1):
            offer(i, i + 1)
        while agenda:
            _, i, piece, a, b = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != a or j >= size or symbols[j] != b:
                continue
            n += 1
            if n <= drawn and draws[n - 1] < limit:
                continue
            symbols[i], symbols[j] = piece, -2
            j = after[i] = after[j]
            if j < size:
                before[j] = i
                offer(i, j)
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in symbols if s != -2], n

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return self.found[np.where(self.keys[at] == key, at, len(self.keys))]

    def _merge_rows(self, symbols: np.ndarray, draws: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """``_merge_list`` of many units of one length, a row each (``draws`` too):
        the ids one after the other, and their number per row."""
        rows, size = symbols.shape
        wide = size + 2  # a column of nothing on each side
        s = np.full((rows, wide), _ID, dtype=np.int64)
        s[:, 1:-1] = symbols
        agenda = np.full((rows, wide), _NONE, dtype=np.int64)
        agenda[:, 1:-2] = self._lookup(s[:, 1:-2], s[:, 2:-1])
        after = np.tile(np.arange(1, wide + 1), (rows, 1)).ravel()
        before = np.tile(np.arange(-1, wide - 1), (rows, 1)).ravel()
        s, flat = s.ravel(), agenda.ravel()
        live, n = np.arange(rows), 0
        while True:
            i = agenda[live].argmin(axis=1)
            best = flat[live * wide + i]
            going = best < _NONE
            live, i, best = live[going], i[going], best[going]
            if not len(live):
                break
            base = live * wide
            at = base + i
            if draws is not None:
                skip = draws[live, n] < self.limit
                flat[at[skip]] = _NONE
                base, at, best = base[~skip], at[~skip], best[~skip]
            n += 1
            piece, second = best & _ID, base + after[at]
            right = after[second]
            s[at], s[second], flat[second] = piece, -2, _NONE
            after[at], before[base + right] = right, at - base
            flat[at] = self._lookup(piece, s[base + right])
            left = base + before[at]
            flat[left] = self._lookup(s[left], piece)
        kept = s.reshape(rows, wide)[:, 1:-1]
        return kept[kept != -2], (kept != -2).sum(axis=1)

    def _units(self, units: list[str], places: np.ndarray | None = None,
               draws: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Candidates (without draws), start and number of ids of each unit, and the ids."""
        out, pool, end = np.zeros((3, len(units)), dtype=np.int64), [np.zeros(0, dtype=np.int32)], 0
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        order = np.argsort(lengths, kind="stable")
        bounds = np.searchsorted(lengths[order], np.arange(1, SHORT + 2))
        alone = order[bounds[-1]:].tolist()
        for size, first, last in zip(range(1, SHORT + 1), bounds, bounds[1:]):
            for k in range(first, last, ROWS):
                which = order[k:min(last, k + ROWS)]
                joined = "".join([units[x] for x in which.tolist()]).encode("utf-32-le", "surrogatepass")
                symbols = self.char_ids[np.frombuffer(joined, dtype=np.uint32)].reshape(-1, size)
                odd = (symbols < 0).any(axis=1)
                alone += which[odd].tolist()
                which, symbols = which[~odd], symbols[~odd]
                drawn = None if draws is None else draws[places[which][:, None] + np.arange(DRAWS * size)]
                ids, counts = self._merge_rows(symbols, drawn)
                out[:, which] = size - counts, end + np.cumsum(counts) - counts, counts
                pool.append(ids.astype(np.int32))
                end += len(ids)
        for x in alone:
            drawn = b"" if draws is None else draws[places[x]:places[x] + DRAWS * lengths[x]].tobytes()
            n, ids = self.unit_ids(units[x], drawn)
            out[:, x] = n, end, len(ids)
            pool.append(np.array(ids, dtype=np.int32))
            end += len(ids)
        return out, np.concatenate(pool)

    def encode_all(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and their number per text."""
        if len(self.cache) > CACHE_UNITS:
            self._forget()
        units, hashed, n_units = [], [], []
        for text in texts:
            before = len(units)
            if text:
                if self.limit:
                    hashed.append(self._draws(text))
                units += _UNIT.findall(SPACE + text.replace(SPACE, _OWN).replace(" ", SPACE))
            n_units.append(len(units) - before)
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        places = DRAWS * (np.cumsum(lengths) - lengths)
        draws = np.frombuffer(b"".join(hashed), dtype=np.uint8)
        long = lengths > SHORT
        rows = np.fromiter(map(self.cache.get, units, itertools.repeat(-1)), dtype=np.int64, count=len(units))
        miss = np.flatnonzero((rows < 0) & ~long).tolist()
        new = list(dict.fromkeys([units[k] for k in miss]))
        found, ids = self._units(new)
        found[1] += len(self.pool)
        self.cache.update(zip(new, itertools.count(self.plain.shape[1])))
        self.plain, self.pool = np.concatenate([self.plain, found], axis=1), np.concatenate([self.pool, ids])
        rows[miss] = [self.cache[units[k]] for k in miss]
        at = np.zeros((3, len(units)), dtype=np.int64)
        at[:, ~long] = self.plain[:, rows[~long]]
        cut = long
        if self.limit:
            low = np.append(np.flatnonzero(draws < self.limit), len(draws) + _ID)
            cut = long | (low[np.searchsorted(low, places)] < places + at[0])
        which = np.flatnonzero(cut)
        own, ids = self._units([units[k] for k in which.tolist()], places[which], draws if self.limit else None)
        own[1] += len(self.pool)
        at[:, which] = own
        n = at[2]
        flat = np.concatenate([self.pool, ids])[np.repeat(at[1] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        sizes = np.concatenate([[0], np.cumsum(n)])
        return flat, np.diff(sizes[np.concatenate([[0], np.cumsum(n_units, dtype=np.int64)])])

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode("utf-8")


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                 model_path: str = MODEL_PATH, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """``keep`` columns (all by default, but for the text) plus token_ids, n_tokens,
    and the sha256 of the text that these ids decode to."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    model = read_model(model_path)  # half a megabyte

    def start():
        coder = PieceCoder(model, dropout, seed)

        def fn(texts):
            flat, sizes = coder.encode_all(texts)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            array = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat),
                                             mask=pa.array([t is None for t in texts]))
            ids, bounds = flat.tolist(), offsets.tolist()
            back = [None if t is None else hashlib.sha256(coder.decode(ids[a:b]).encode()).hexdigest()
                    for t, a, b in zip(texts, bounds, bounds[1:])]
            return [array, sizes.tolist(), back]
        return fn

    fields = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
              T.StructField("decoded_sha256", T.StringType())]
    return map_text(docs, text_col, keep, fields, start, piece_bytes=1 << 20)


def decode_ids(encoded: DataFrame, ids_col: str = "token_ids", text_col: str = "decoded",
               model_path: str = MODEL_PATH) -> DataFrame:
    """All columns plus the decoded text of ``ids_col``."""
    model = read_model(model_path)
    schema = T.StructType([f for f in encoded.schema.fields if f.name.lower() != text_col.lower()]
                          + [T.StructField(text_col, T.StringType())])
    names = [f.name for f in schema.fields[:-1]]
    position = names.index(ids_col)

    def run(batches):
        coder = PieceCoder(model)
        for batch in batches:
            texts = [None if i is None else coder.decode(i) for i in batch.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), keep=["doc_id"])
