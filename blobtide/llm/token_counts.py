"""Token counts by compiled finite-state transducers.

Two deterministic transducers replace the tokenizer of a word-level byte-pair vocabulary.

The scanner cuts normalised text into words, numbers, signs and contractions. It has seven states, so
what a chunk of text does to it is a map from seven states to seven. The maps of all chunks of a
batch are computed side by side, composed by a parallel prefix scan to give the state each chunk
starts in, and a second sweep marks where words begin.

The word transducer reads a word's bytes. Its state holds, for each place where a later token could
still begin, the last token of the encoding up to there; each transition is annotated with the number
of tokens it emits (negative where tokens merge). An encoding is the only sequence of tokens whose
neighbours each stay apart when encoded as a pair, so the next state follows from the present one. States
and transitions are compiled from the merge list when first met.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtide.llm import words as W
from blobtide.llm.tables import two_columns

LIMIT = 2048
CHUNK = 64  # code points of a chunk
MOST_STATES = 200_000  # compiled states and cached words are dropped beyond this; results do not change
MOST_WORDS = 1_000_000

# Code points with the White_Space property.
_WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Classes of code points, as the scanner sees them.
SPACE, LETTER, NUMBER, SIGN, QUOTE, ENDS, R, V, L, E = range(10)
# Scanner states: between words, in a word, in signs, after a first quote, after 'r, 'v and 'l.
BETWEEN, WORD, SIGNS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)


def _scanner() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether something begins) by state and class."""
    after = np.empty((7, 10), np.uint8)
    begins = np.zeros((7, 10), bool)
    letters = (LETTER, ENDS, R, V, L, E)
    for state in range(7):
        for kind in range(10):
            to = {SPACE: BETWEEN, NUMBER: BETWEEN, SIGN: SIGNS, QUOTE: QUOTED}.get(kind, WORD)
            begin = kind != SPACE
            in_word = state in (WORD, QUOTED_R, QUOTED_V, QUOTED_L)
            if in_word and kind in letters:
                begin = False
            if state in (SIGNS, QUOTED) and kind in (SIGN, QUOTE):
                to, begin = SIGNS, False
            if state == QUOTED and kind in (ENDS, R, V, L):
                to, begin = {ENDS: BETWEEN, R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[kind], False
            if (state, kind) in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, L)):
                to = BETWEEN
            after[state, kind], begins[state, kind] = to, begin
    return after, begins


AFTER, BEGINS = _scanner()
_COMPLETED = {QUOTED_R: E, QUOTED_V: E, QUOTED_L: L}


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    initial = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (initial.get(unicodedata.category(chr(c))[0], SIGN) for c in range(0x110000)), np.uint8, 0x110000
    )
    table[_WHITE_SPACE] = SPACE
    for letter in "stmd":
        table[ord(letter)] = ENDS
    for letter, kind in (("'", QUOTE), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[ord(letter)] = kind
    return table


def entry_states(kinds: np.ndarray) -> np.ndarray:
    """Scanner state before each chunk of `CHUNK` code points (rows of `kinds`)."""
    maps = np.tile(np.arange(7, dtype=np.uint8), (len(kinds), 1))
    for i in range(kinds.shape[1]):
        maps = AFTER[maps, kinds[:, i, None]]
    # inclusive prefix scan: maps[i] becomes the map of chunks 0..i
    reach = 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy(), axis=1)
        reach *= 2
    return np.concatenate([[BETWEEN], maps[:-1, BETWEEN]]).astype(np.uint8)


def begins_of(kinds: np.ndarray) -> np.ndarray:
    """Where words, numbers, signs and contractions begin."""
    n = len(kinds)
    padded = np.full(-(-n // CHUNK) * CHUNK, SPACE, np.uint8)
    padded[:n] = kinds
    rows = padded.reshape(-1, CHUNK)
    state = entry_states(rows)
    states, begins = np.empty_like(rows), np.empty(rows.shape, bool)
    for i in range(CHUNK):
        begins[:, i] = BEGINS[state, rows[:, i]]
        state = AFTER[state, rows[:, i]]
        states[:, i] = state
    states, begins = states.reshape(-1)[:n], begins.reshape(-1)[:n].copy()
    following = np.append(kinds[1:], SPACE)
    for state, kind in _COMPLETED.items():
        begins[(states == state) & (following != kind)] = True  # no contraction after all
    return begins


def _byte_symbols() -> dict[str, int]:
    """Symbol of each byte in vocabulary files: printable Latin-1 stands for itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTransducer:
    """Number of tokens of a word, by states compiled when first met."""

    def __init__(self, merges: list[tuple[str, str]], mark: str):
        symbols = _byte_symbols()

        def units(piece: str) -> tuple[int, ...]:
            """Bytes of a piece; the last byte of a word is 256 higher."""
            ended = piece.endswith(mark)
            codes = [symbols[c] for c in (piece[: -len(mark)] if ended else piece)]
            return (*codes[:-1], codes[-1] + 256) if ended else tuple(codes)

        self.tokens: dict[tuple[int, ...], int] = {(b,): b for b in range(512)}
        self.spelled: list[tuple[int, ...]] = [(b,) for b in range(512)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            whole = units(left + right)
            if whole not in self.tokens:
                self.tokens[whole] = len(self.spelled)
                self.spelled.append(whole)
            pair = self.tokens[units(left)], self.tokens[units(right)]
            self.rank.setdefault(pair, (rank, self.tokens[whole]))
        self.prefixes = {s[:i] for s in self.spelled for i in range(len(s))}
        self.apart: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        # state 0: no byte read; (open suffix, last token at each of its places, tokens up to there less those now)
        self.states = [((), (-1,), (0,))]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def merged(self, ids: list[int]) -> list[int]:
        """Encoding by merges in the order of their ranks."""
        ids = list(ids)
        while len(ids) > 1:
            best = min((self.rank.get(p, (1 << 60, -1)) for p in zip(ids, ids[1:], strict=False)))
            if best[1] < 0:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.rank.get((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _stay_apart(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        key = left, right
        if key not in self.apart:
            if len(self.apart) > MOST_WORDS:
                self.apart.clear()
            self.apart[key] = self.merged([*self.spelled[left], *self.spelled[right]]) == [left, right]
        return self.apart[key]

    def _compile(self, state: int, unit: int) -> tuple[int, int]:
        open_, last, counts = self.states[state]
        read = (*open_, unit)
        for i in range(len(read)):  # the longest token that may stand after what comes before it
            token = self.tokens.get(read[i:])
            if token is not None and self._stay_apart(last[i], token):
                break
        count = counts[i] + 1
        begin = 0
        while read[begin:] not in self.prefixes:
            begin += 1
        kept_last = (*last, token)[begin:]
        kept_counts = tuple(c - count for c in (*counts, count)[begin:])
        key = (read[begin:], kept_last, kept_counts)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        move = self.number[key], count
        self.moves[(state << 9) | unit] = move
        return move

    def count(self, word: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self._reset()
        state = total = 0
        moves = self.moves
        final = len(word) - 1
        for i, byte in enumerate(word):
            unit = byte + 256 if i == final else byte
            move = moves.get((state << 9) | unit) or self._compile(state, unit)
            state = move[0]
            total += move[1]
        return total


class Counter:
    """Token counts of texts under a vocabulary file of the `tokenizers` library (word ends, byte level)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.words = WordTransducer(merges, model["end_of_word_suffix"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.known: dict[int, int] = {}

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            pieces = [text]
            if "<|" in text:
                pieces = self.special.split(text)
                total[i] += len(pieces) - 1
            parts += map(self._normal, pieces)
            owner += [i] * len(pieces)
        if not parts:
            return total
        joined = "\n".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _classes()[points]
        starts = np.flatnonzero(begins_of(kinds))
        if not len(starts):
            return total
        inside = np.concatenate([[0], np.cumsum(kinds != SPACE)])
        limits = np.append(starts[1:], len(points))
        ends = starts + (inside[limits] - inside[starts])  # space lies only behind a word
        power, inverse = W._power_tables(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=sums[1:])
        hashes = W.mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        distinct, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        counts = np.empty(len(distinct), np.int64)
        for k, (h, at) in enumerate(zip(distinct.tolist(), first.tolist(), strict=True)):
            n = self.known.get(h)
            if n is None:
                n = self.known[h] = self.words.count(joined[starts[at] : ends[at]].encode("utf-8", "surrogatepass"))
            counts[k] = n
        bounds = np.cumsum([len(p) + 1 for p in parts])
        text_of = np.asarray(owner)[np.searchsorted(bounds, starts, side="right")]
        np.add.at(total, text_of, counts[where])
        return total


@lru_cache(2)
def _counter(path: str) -> Counter:
    return Counter(path)


def token_counts(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    `vocabulary` is the path of the tokenizer file on every executor. No begin or end tokens are
    added; strings of special tokens inside a text count as one token each, as in the library.

    Defined cases: a null or empty text has 0 bytes and tokens; null ids and repeated rows are counted like any
    others; a text of any length is counted whole; an empty table gives no rows; other columns are not looked at.
    """

    @F.arrow_udf("bigint")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(vocabulary)
        for batch in batches:
            out = []
            for data, offsets in W.slices(batch, 1_000_000):
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                out.append(counter.counts(texts))
            yield pa.array(np.concatenate(out) if out else np.empty(0, np.int64))

    return (
        two_columns(docs, id_col, text_col)
        .select(
            "doc_id",
            F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"),
            n_tokens("text").alias("n_tokens"),
        )
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
