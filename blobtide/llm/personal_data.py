"""Personal data by a semi-Markov conditional random field.

Well-formed e-mail addresses, IP addresses, card and phone numbers are matched by pattern. Less regular
ones (a phone number without its plus, a card number grouped by dots) are found by a segment model
trained on the regular ones. A text is searched in clusters: runs of words that hold a digit or an at
sign, and their neighbours. A cluster is cut into tokens; a segmentation of it is scored by features
of whole segments (length, shape, number of digits, groups, Luhn sum, address parts, the word before).
A dynamic programme over segments of at most `LONGEST` tokens jointly chooses boundaries and types,
and its forward-backward form gives the gradient in training.

Training texts are a bounded sample; their pattern matches are the labels, and copies of them are
roughened (plus signs dropped, separators exchanged), which teaches the model forms the patterns miss.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtide.llm.spans import Span, span_column
from blobtide.llm.tables import two_columns

KINDS = ("email", "ip", "card", "phone")
TRAIN_CLUSTERS = 1_000  # most clusters that the model is fitted on
TRAIN_TEXTS = 1_500  # most texts they are taken from
LONGEST_TRAINED = 200  # signs of a stretch that the model is fitted on
LONGEST = 15  # tokens of an entity
BLOCK_TOKENS = 4_096  # tokens whose segments are held at once
FEATURES = 1 << 12
MARGIN = 4.0  # log-odds an added span must have over no entity
STEPS, RATE, RIDGE = 30, 0.5, 1e-4

# The base patterns. Their look-behinds and possessive forms only spare the search
# starts that cannot match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_CLUSTER = re.compile(r"[^\s]*[0-9@][^\s]*(?:[ \t][^\s]*[0-9@][^\s]*)*")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\x00-\x7F]+|[ \t]|.", re.S)
_NOT_DIGIT = re.compile(r"[^0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_END.match(text, start - 1):
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            out.append(("email", start, end.end(), True))
            done = end.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind and start."""
    out = _emails(text) if "@" in text else []
    out += [
        ("ip", m.start(), m.end(), True)
        for m in _IP.finditer(text)
        if all(len(d) <= 3 and int(d or "0") <= 255 for d in (p.lstrip("0") for p in m[0].split(".")))
    ]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end(), True))
    if "+" in text:
        out += [
            ("phone", m.start(), m.end(), True)
            for m in _PHONE.finditer(text)
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15
        ]
    return out


def clusters(text: str) -> list[tuple[int, str]]:
    """(start, text) of the stretches that may hold personal data."""
    return [(m.start(), m[0]) for m in _CLUSTER.finditer(text)]


def _shape(piece: str) -> str:
    out = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", piece))
    return re.sub(r"[^\x00-\x7F]+", "é", out)


def segment_features(piece: str, before: str) -> list[int]:
    """Slots of a whole segment's features; `before` is the text in front of it."""
    digits = _NOT_DIGIT.sub("", piece)
    groups = re.findall(r"[0-9]+", piece)
    letters = sum(c.isalpha() for c in piece)
    names = [
        f"s{_shape(piece)[:40]}",
        f"n{min(len(digits), 20)}",
        f"g{'.'.join(str(min(len(g), 9)) for g in groups[:6])}",
        f"k{len(groups)}{letters > 0}",
        f"l{16 <= len(digits) <= 19 and not letters and _luhn(digits)}",
        f"o{len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and not letters}",
        f"@{piece.count('@')}{'.' in piece.partition('@')[2]}{bool(re.fullmatch(r'[^@]+@[^@]+[.][A-Za-z]+', piece))}",
        f"p{''.join(sorted(set(re.sub(r'[0-9A-Za-z]', '', piece))))[:8]}",
        f"b{piece[0] if not piece[0].isalnum() else 'w'}{piece[-1] if not piece[-1].isalnum() else 'w'}",
        f"w{before[-1:] if not before[-1:].isalnum() else 'w'}",
        f"d{min(len(digits), 20)}{letters > 0}{piece[0]== '+'}",
        "1",
    ]
    return [crc32(n.encode()) % FEATURES for n in names]


PER_SEGMENT = len(segment_features("1", ""))


def token_places(text: str) -> list[int]:
    """Character offsets of token starts, and the end."""
    return [m.start() for m in _TOKEN.finditer(text)] + [len(text)]


def segments_between(text: str, places: list[int], low: int, high: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Candidate segments (first token, end token) with an end token in [low, high), and their features."""
    segments, features = [], []
    for j in range(low, high):
        if text[places[j - 1] : places[j]] in " \t,;:!?)('\"":
            continue
        seen = False
        for i in range(j - 1, max(-1, j - 1 - LONGEST), -1):
            first = text[places[i]]
            seen = seen or first.isdigit() or first == "@"
            if not seen or text[places[i] : places[i + 1]] in " \t,;:!?)'\".":
                continue
            segments.append((i, j))
            features.append(segment_features(text[places[i] : places[j]], text[max(0, places[i] - 1) : places[i]]))
    return segments, np.array(features, np.int64).reshape(len(segments), PER_SEGMENT)


def best_segmentation(text: str, weights: np.ndarray, margin: float, block: int = BLOCK_TOKENS) -> list[tuple[int, int, int]]:
    """Best segmentation of a cluster: (start, end, kind) of its entities. A token outside scores 0.

    Tokens are taken in blocks: a block's segments and features are made, scored and dropped. A segment
    reaches back `LONGEST` tokens, so the values at the tokens so far are all that the next block needs.
    """
    places = token_places(text)
    n = len(places) - 1
    top, back = [0.0] * (n + 1), [(-1, -1)] * (n + 1)
    for low in range(1, n + 1, block):
        high = min(low + block, n + 1)
        segments, features = segments_between(text, places, low, high)
        if segments:
            scores = weights[:, features].sum(axis=2).T - margin
            kinds, values = scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist()
        at = 0
        for j in range(low, high):
            top[j] = top[j - 1]
            while at < len(segments) and segments[at][1] == j:
                i = segments[at][0]
                if top[i] + values[at] > top[j]:
                    top[j], back[j] = top[i] + values[at], (i, kinds[at])
                at += 1
    out, j = [], n
    while j > 0:
        i, kind = back[j]
        if i < 0:
            j -= 1
        else:
            out.append((places[i], places[j], kind))
            j = i
    return out[::-1]


@dataclass
class Lattice:
    """All candidate segments of one cluster, grouped by the token they end at."""

    places: list[int]  # character offsets of token starts, and the end
    segments: list[tuple[int, int]]  # (first token, end token)
    features: np.ndarray  # (segments, features per segment)

    @classmethod
    def of(cls, text: str) -> Lattice:
        places = token_places(text)
        segments, features = segments_between(text, places, 1, len(places))
        return cls(places, segments, features)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """(segments, kinds)."""
        return weights[:, self.features].sum(axis=2).T if self.segments else np.empty((0, len(KINDS)))

    def gradient(self, weights: np.ndarray, gold: dict[tuple[int, int], int], into: np.ndarray) -> float:
        """Add the gradient of the log-likelihood of the gold entities to `into`; return the log-likelihood."""
        n = len(self.places) - 1
        scores = self.scores(weights)
        total = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.empty(0)
        forward, backward = np.zeros(n + 1), np.zeros(n + 1)
        by_end: dict[int, list[int]] = {}
        by_start: dict[int, list[int]] = {}
        for s, (i, j) in enumerate(self.segments):
            by_end.setdefault(j, []).append(s)
            by_start.setdefault(i, []).append(s)
        for j in range(1, n + 1):
            forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[self.segments[s][0]] + total[s] for s in by_end.get(j, ()))])
        for i in range(n - 1, -1, -1):
            backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[self.segments[s][1]] + total[s] for s in by_start.get(i, ()))])
        likelihood = -forward[n]
        if not self.segments:
            return likelihood
        first, end = np.array(self.segments).T
        change = -np.exp((forward[first] + backward[end] - forward[n])[:, None] + scores)
        for s, segment in enumerate(self.segments):
            if segment in gold:
                likelihood += scores[s][gold[segment]]
                change[s, gold[segment]] += 1
        width = self.features.shape[1]
        np.add.at(into.T, self.features.ravel(), np.repeat(change, width, axis=0))
        return likelihood


def _roughened(kind: str, piece: str, r: random.Random) -> str:
    """The same datum as people also write it."""
    digits = _NOT_DIGIT.sub("", piece)
    if kind == "phone":
        forms = [piece[1:], piece.lstrip("+0123456789 "), "-".join((digits[-10:-7], digits[-7:-4], digits[-4:])),
                 f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", ".".join((digits[-10:-7], digits[-7:-4], digits[-4:]))]
        return r.choice(forms)
    if kind == "card":
        return r.choice([".", "  ", "/"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "ip":
        return piece.replace(".", r.choice([" . ", "-"]))
    return piece.replace("@", r.choice([" @ ", "@ ", " @"]))


def fit(texts: list[str]) -> np.ndarray:
    """Weights (kinds, features) from the pattern matches of the texts; all zero without any."""
    r = random.Random(11)
    examples: list[tuple[Lattice, dict]] = []
    for text in texts:
        if len(examples) >= TRAIN_CLUSTERS:
            break
        spans = base_spans(text)
        for start, cluster in clusters(text):
            if len(cluster) > LONGEST_TRAINED:
                continue
            inside = sorted((s - start, e - start, k) for k, s, e, _ in spans if s >= start and e <= start + len(cluster))
            if any(a[1] > b[0] for a, b in zip(inside, inside[1:], strict=False)):
                continue
            versions = [[(cluster[s:e], k) for s, e, k in inside]]
            if inside:
                versions.append([(_roughened(k, cluster[s:e], r), k) for s, e, k in inside])
            for version in versions:
                out, gold, done = "", [], 0
                for (s, e, k), (piece, _) in zip(inside, version, strict=True):
                    out += cluster[done:s]
                    gold.append((len(out), len(out) + len(piece), KINDS.index(k)))
                    out += piece
                    done = e
                out += cluster[done:]
                lattice = Lattice.of(out)
                place = {c: t for t, c in enumerate(lattice.places)}
                wanted = {(place.get(s, -1), place.get(e, -1)): k for s, e, k in gold}
                if all(w in set(lattice.segments) for w in wanted):
                    examples.append((lattice, wanted))
    weights = np.zeros((len(KINDS), FEATURES))
    weights[:, crc32(b"1") % FEATURES] = -2.0
    if not any(gold for _, gold in examples):
        return np.zeros((len(KINDS), FEATURES))
    squares = np.full_like(weights, 1e-6)
    for _ in range(STEPS):
        gradient = np.zeros_like(weights)
        for lattice, gold in examples:
            lattice.gradient(weights, gold, gradient)
        gradient = gradient / len(examples) - RIDGE * weights
        squares += gradient**2
        weights += RATE * gradient / np.sqrt(squares)
    return weights


def searcher(weights: np.ndarray, margin: float = MARGIN) -> Callable[[str], list[Span]]:
    """Function text -> all spans by kind, then start."""
    rank = {k: i for i, k in enumerate(KINDS)}
    trained = bool(weights.any())

    def search(text: str) -> list[Span]:
        out = base_spans(text)
        taken = sorted((s, e) for _, s, e, _ in out)
        if trained:
            for start, cluster in clusters(text):
                end = start + len(cluster)
                near = [(s, e) for s, e in taken if s < end and start < e]
                if sum(e - s for s, e in near) >= len(cluster):
                    continue
                for i, j, kind in best_segmentation(cluster, weights, margin):
                    s, e = start + i, start + j
                    if not any(a < e and s < b for a, b in near):
                        out.append((KINDS[kind], s, e, False))
        return sorted(out, key=lambda x: (rank[x[0]], x[1], x[2]))

    return search


def _training_texts(docs: DataFrame) -> list[str]:
    """The first `TRAIN_TEXTS` suitable texts by hash.

    Hashes below a bound set from the number of texts are looked at first, so that a few rows per text wanted
    reach a test or the driver however many partitions there are; the bound is raised until enough are found.
    """
    hashed = docs.select("text", F.xxhash64("text").alias("o"))
    suitable = F.col("text").rlike("[0-9]") & F.col("text").rlike("[@+]") & (F.length("text") <= 20_000)
    share = min(1.0, 64 * TRAIN_TEXTS / max(docs.count(), 1))
    while True:
        below = hashed if share == 1.0 else hashed.filter(F.col("o") < F.lit(int(share * 2**64) - 2**63))
        first = below.filter(suitable).select("o").orderBy("o").limit(TRAIN_TEXTS).collect()
        if len(first) == TRAIN_TEXTS or share == 1.0:
            break
        share = min(1.0, share * 16)
    if not first:
        return []
    chosen = hashed.filter(F.col("o") <= F.lit(first[-1]["o"])).filter(suitable)
    return [r["text"] for r in chosen.orderBy("o").limit(TRAIN_TEXTS).collect()]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (by kind as in `KINDS`, then start; `base` marks pattern matches).

    The model is fitted on the first `TRAIN_TEXTS` texts, in the order of a hash of the text, that hold a
    digit and an at sign or a plus and are no longer than 20,000 characters, and of their stretches on those of at
    most `LONGEST_TRAINED` signs; everything else covers all texts whole.

    Defined cases: a null or empty text has no spans; base spans of one kind never overlap; added spans overlap no
    other span; null ids and repeated rows are searched like any others; with no training text nothing is added; an
    empty table gives no rows; other columns are not looked at.
    """
    docs = two_columns(docs, id_col, text_col)
    weights = fit(_training_texts(docs))
    found = span_column(lambda: searcher(weights))
    return docs.select("doc_id", found("text").alias("spans"))
