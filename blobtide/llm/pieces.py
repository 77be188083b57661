"""SentencePiece encoding with seeded merge dropout, and its inverse.

A merge-type model encodes by taking the best-scored merge of two neighbours from an agenda until none
is left. Here a candidate that comes up is skipped for good if a keyed hash of (seed, document, unit,
place, merged piece) falls below the dropout rate, so texts get varied segmentations that are the same in
every run and on every executor; with rate 0 the result is the library's own encoding.

No piece of such a model has a space behind another sign, so merges never cross units (a word with the
spaces before it), and all units of a batch are merged side by side as rows of arrays: each round takes the best
candidate of every unit's agenda, and neighbours are kept as links, so a merge touches three places of a row. Units of
more than `WIDEST` signs use a heap of their own. Signs outside the vocabulary become byte pieces, and so does a literal U+2581, the sign that stands for a space: that keeps
decoding lossless for every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobtide.llm import words as W
from blobtide.llm.tables import two_columns

SPACE = "▁"
WIDTHS = (8, 16, 32)  # units are merged in groups of at most so many signs
WIDEST = WIDTHS[-1]
ROWS = 20_000  # units merged side by side
DECODED = 1_000_000  # ids decoded at once; a longer document comes alone and whole

_NONE = np.float32("-inf")


class Pairs:
    """Exact lookup (left, right) -> (merged piece, score) in hashed tables; a taken slot sends a pair to the next."""

    def __init__(self, keys: np.ndarray, merged: np.ndarray, scores: np.ndarray):
        self.levels = []
        while len(keys):
            bits = int(8 * len(keys)).bit_length()
            slot = self._slot(keys, bits, len(self.levels))
            _, kept = np.unique(slot, return_index=True)
            table = [np.full(1 << bits, fill, kind) for fill, kind in ((-1, np.int64), (-1, np.int32), (_NONE, np.float32))]
            for values, column in zip(table, (keys, merged, scores), strict=True):
                values[slot[kept]] = column[kept]
            self.levels.append((bits, *table))
            left = np.ones(len(keys), bool)
            left[kept] = False
            keys, merged, scores = keys[left], merged[left], scores[left]

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, level: int) -> np.ndarray:
        factor = np.uint64(0x9E3779B97F4A7C15 + 2 * level)
        return ((keys.astype(np.uint64) * factor) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.int64) << 21) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        merged, scores = np.full(len(keys), -1, np.int32), np.full(len(keys), _NONE, np.float32)
        open_ = None
        for level, (bits, table, pieces, values) in enumerate(self.levels):
            now = keys if open_ is None else keys[open_]
            slot = self._slot(now, bits, level)
            found = table[slot]
            hit = found == now
            if open_ is None:
                merged[hit], scores[hit] = pieces[slot[hit]], values[slot[hit]]
                open_ = np.flatnonzero(~hit & (found >= 0))
            else:
                merged[open_[hit]], scores[open_[hit]] = pieces[slot[hit]], values[slot[hit]]
                open_ = open_[~hit & (found >= 0)]
            if not len(open_):
                break
        return merged, scores


def _skipped(keys: np.ndarray, places: np.ndarray, merged: np.ndarray, rate: float) -> np.ndarray:
    """Keyed hash of candidates, by their unit, place and merged piece, against the rate."""
    h = W.mix(keys ^ (places.astype(np.uint64) << np.uint64(32)) ^ merged.astype(np.uint64))
    return h < np.uint64(min(int(rate * (1 << 64)), (1 << 64) - 1))


class Vocabulary:
    """Pieces and scores of a model file; merging is done here. Signs outside it are `size` + code point."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        ids = {
            pieces[i]: i for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        }
        self.spelled = [b""] * size
        self.byte_id = np.zeros(256, np.int32)
        for i in range(size):
            if model.is_byte(i):
                self.spelled[i] = bytes([int(pieces[i][3:5], 16)])
                self.byte_id[self.spelled[i][0]] = i
        for piece, i in ids.items():
            self.spelled[i] = piece.replace(SPACE, " ").encode()
        self.spelled_bytes = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.spelled_length = np.array([*map(len, self.spelled), 0], np.int64)
        self.spelled_at = np.concatenate([[0], np.cumsum(self.spelled_length[:-1])])
        self.sign = np.arange(size, size + 0x110000, dtype=np.int32)
        for piece, i in ids.items():
            if len(piece) == 1 and piece != SPACE:
                self.sign[ord(piece)] = i
        if SPACE in ids:
            self.sign[ord(" ")] = ids[SPACE]
        keys, merged, scores = [], [], []
        known = lambda x: ids.get(x, int(self.sign[ord(x)]) if len(x) == 1 and x != SPACE else -1)
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = known(piece[:cut]), known(piece[cut:])
                if left >= 0 and right >= 0:
                    keys.append((left << 21) | right)
                    merged.append(i)
                    scores.append(model.get_score(i))
        self.pairs = Pairs(np.array(keys, np.int64), np.array(merged, np.int32), np.array(scores, np.float32))

    def _side_by_side(self, signs: np.ndarray, keys: np.ndarray, rate: float) -> np.ndarray:
        """Merge the rows of `signs` (-1 beyond a unit's end); a place merged into the one before it becomes -1."""
        n, width = signs.shape
        merged, scores = (np.full((n, width), fill, kind) for fill, kind in ((-1, np.int32), (_NONE, np.float32)))
        merged[:, :-1], scores[:, :-1] = (x.reshape(n, width - 1) for x in self.pairs.find(signs[:, :-1].ravel(), signs[:, 1:].ravel()))
        # links hold places in their row; the ends of a row are -1 and `width`
        before = np.tile(np.arange(-1, width - 1, dtype=np.int8), (n, 1)).ravel()
        after = np.tile(np.arange(1, width + 1, dtype=np.int8), (n, 1))
        after[np.arange(n), (signs >= 0).sum(axis=1) - 1] = width
        signs, merged, after, flat_scores = signs.ravel().copy(), merged.ravel(), after.ravel(), scores.ravel()
        rows = np.arange(n)
        while len(rows):
            now = scores[rows]
            at = now.argmax(axis=1)
            some = now[np.arange(len(rows)), at] > _NONE
            rows, at = rows[some], at[some]
            first = rows * width
            here = first + at
            piece = merged[here]
            if rate > 0:
                skip = _skipped(keys[rows], at, piece, rate)
                flat_scores[here[skip]] = _NONE
                first, at, here, piece = (x[~skip] for x in (first, at, here, piece))
            gone = first + after[here]
            behind = after[gone]
            signs[here], signs[gone], flat_scores[gone], after[here] = piece, -1, _NONE, behind
            follows = behind < width
            before[first[follows] + behind[follows]] = at[follows]
            flat_scores[here[~follows]] = _NONE
            leads = before[here] >= 0
            # the two candidates beside the merged piece are new
            left = np.concatenate([here[follows], first[leads] + before[here[leads]]])
            right = np.concatenate([first[follows] + behind[follows], here[leads]])
            merged[left], flat_scores[left] = self.pairs.find(signs[left], signs[right])
        return signs.reshape(n, width)

    def _alone(self, signs: list[int], key: np.uint64, rate: float) -> list[int]:
        """The same for one unit of any length, with a heap and links."""
        n = len(signs)
        before, after, gone = list(range(-1, n - 1)), [*range(1, n), -1], [False] * n

        def push(places: list[int]) -> list[tuple]:
            places = [i for i in places if i >= 0 and after[i] >= 0]
            if not places:
                return []
            merged, scores = self.pairs.find(np.array([signs[i] for i in places]), np.array([signs[after[i]] for i in places]))
            return [
                (-float(s), i, int(m), signs[i], signs[after[i]])
                for i, m, s in zip(places, merged, scores, strict=True) if m >= 0
            ]

        agenda = push(list(range(n)))
        heapify(agenda)
        while agenda:
            _, i, piece, left, right = heappop(agenda)
            j = after[i]
            if gone[i] or j < 0 or signs[i] != left or signs[j] != right:
                continue  # one of the two has been merged elsewhere meanwhile
            if rate > 0 and _skipped(np.array([key]), np.array([i]), np.array([piece]), rate)[0]:
                continue
            signs[i], gone[j] = piece, True
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for c in push([before[i], i]):
                heappush(agenda, c)
        return [s for s, g in zip(signs, gone, strict=True) if not g]

    def encode(self, texts: list[str], documents: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): ids of text i are ids[bounds[i]:bounds[i + 1]]."""
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        ends = np.cumsum(lengths)
        joined = "".join(" " + t for t in texts if t)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        space = points == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[(ends - lengths)[lengths > 0]] = True
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(points)))
        text_of = np.searchsorted(ends, starts, side="right")
        first = np.searchsorted(text_of, np.arange(len(texts)))
        keys = W.mix(documents[text_of] + (np.arange(len(starts)) - first[text_of]).astype(np.uint64))
        signs = self.sign[points]
        padded = np.append(signs, np.full(WIDEST, -1, np.int32))
        counts = np.empty(len(starts), np.int64)
        pieces = []  # (units, their places in a flat list of rows)
        low = 0
        for width in WIDTHS:
            group = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for at in range(0, len(group), ROWS):
                units = group[at : at + ROWS]
                rows = padded[starts[units, None] + np.arange(width)]
                rows[np.arange(width) >= sizes[units, None]] = -1
                rows = self._side_by_side(rows, keys[units], rate)
                counts[units] = (rows >= 0).sum(axis=1)
                pieces.append((units, rows))
        for u in np.flatnonzero(sizes > WIDEST).tolist():
            row = np.array(self._alone(signs[starts[u] : starts[u] + sizes[u]].tolist(), keys[u], rate), np.int32)
            counts[u] = len(row)
            pieces.append((np.array([u]), row[None, :]))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(offsets[-1], np.int32)
        for units, rows in pieces:
            line, column = np.nonzero(rows >= 0)
            place = np.arange(len(line)) - np.searchsorted(line, line)
            flat[offsets[units[line]] + place] = rows[line, column]
        bounds = np.append(offsets[first], offsets[-1])
        return self._with_bytes(flat, bounds)

    def _with_bytes(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signs outside the vocabulary as byte pieces."""
        outside = np.flatnonzero(flat >= self.size)
        if not len(outside):
            return flat, bounds
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in (flat[outside] - self.size).tolist()]
        width = np.ones(len(flat), np.int64)
        width[outside] = [len(x) for x in spelled]
        offsets = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(flat, width)
        where = np.repeat(offsets[outside], width[outside]) + np.concatenate([np.arange(len(x)) for x in spelled])
        out[where] = self.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
        return out, offsets[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of sequences ids[bounds[i]:bounds[i + 1]]; unknown ids and control pieces stand for nothing."""
        ids = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        lengths = self.spelled_length[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        # the source of each byte: its place in its piece, behind the piece's begin in the table
        source = np.arange(ends[-1]) + np.repeat(self.spelled_at[ids] - ends[:-1], lengths)
        data = self.spelled_bytes[source].tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in pairwise(ends[bounds].tolist())]
        return [t[1:] if t[:1] == " " else t for t in texts]


@lru_cache(2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encoded(model: Vocabulary, texts: pa.Array, keys: pa.Array, rate: float) -> pa.Array:
    """Ids of a batch of texts under their documents' keys."""
    documents = keys.to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint64)
    parts, sizes, at = [], [np.zeros(1, np.int64)], 0
    for data, offsets in W.slices(texts, 250_000):
        raw = data.tobytes()
        some = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        flat, bounds = model.encode(some, documents[at : at + len(some)], rate)
        at += len(some)
        parts.append(flat)
        sizes.append(np.diff(bounds))
    bounds = np.cumsum(np.concatenate(sizes)).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, pa.int32()))


def _decoded(model: Vocabulary, batch: pa.Array) -> pa.Array:
    """Texts of a batch of ids."""
    found: list[str | None] = []
    # some documents at a time, about `DECODED` ids, so that their bytes stay few
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False))])
    values = batch.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    first = 0
    while first < len(batch):
        last = max(int(np.searchsorted(at, at[first] + DECODED, side="right")) - 1, first + 1)
        last = min(last, len(batch))
        found += model.decode(values[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last
    return pc.if_else(batch.is_valid(), pa.array(found, pa.string()), None)


def encoder(vocabulary: str, rate: float = 0.1):
    """Column function (text, document key as bigint) -> ids."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = _vocabulary(vocabulary)
        for texts, keys in batches:
            yield _encoded(model, texts, keys, rate)

    return ids


def decoder(vocabulary: str):
    """Column function ids -> text."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _vocabulary(vocabulary)
        for batch in batches:
            yield _decoded(model, batch)

    return text


def coder(vocabulary: str, rate: float = 0.1):
    """Column function (text, document key as bigint) -> struct<ids, text>, the ids and the text they decode to.

    Encoder and decoder in one: apart, each has Python workers of its own, with a copy of the vocabulary.
    """

    @F.arrow_udf("struct<ids:array<int>,text:string>")
    def both(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = _vocabulary(vocabulary)
        for texts, keys in batches:
            ids = _encoded(model, texts, keys, rate)
            yield pa.StructArray.from_arrays([ids, _decoded(model, ids)], names=["ids", "text"])

    return both


def document_key(doc_id: Column, seed: int) -> Column:
    """Key under which a document's candidates are hashed."""
    return F.xxhash64(F.lit(seed), doc_id)


def encode(
    docs: DataFrame, vocabulary: str, seed: int = 0, rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, text, ids.

    `vocabulary` is the path of a merge-type model file on every executor; `rate` is the share of candidate
    merges that are skipped.

    Defined cases: a null or empty text has no ids (and decodes to the empty text); repeated rows get the same
    ids, null ids draw like one document; texts of any length are encoded whole; an empty table gives no rows;
    other columns are not looked at.
    """
    ids = encoder(vocabulary, rate)
    return two_columns(docs, id_col, text_col).withColumn("ids", ids("text", document_key(F.col("doc_id"), seed)))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """`encoded` with the column `decoded`, the text of its ids. Ids outside the vocabulary are left out."""
    return encoded.withColumn("decoded", decoder(vocabulary)("ids"))
