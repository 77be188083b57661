"""Secret scan: known forms, and strings that a tokenizer cannot compress.

Assigned passwords and tokens, access key ids and long hex strings are matched by pattern. Beyond
these, a run of key characters is a secret if it is random: a vocabulary that was built from text
spells words with few tokens, but needs one for every one or two characters of a random string. A run
whose characters per token lie below `RATIO` is reported, unless it is a known digest or an
identifier: hex of a digest's length, a UUID, a number, a date or version, a run without letters, or
one of fewer than `LEAST_SIGNS` different signs (a ruler or filler). A run of letters only is judged by its
ratio like any other: long words and names spelled together lie well above it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from blobtide.llm.spans import Span, span_column
from blobtide.llm.tables import two_columns

KINDS = ("assign", "access", "hex", "random")
RATIO = 2.0  # characters per token below which a run is random
LEAST_SIGNS = 6
SHORTEST, LONGEST_PIECE = 20, 4096  # a longer run is judged by pieces of this length, all of it

# The base patterns and the lengths of common digests in hex.
_ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_DIGESTS = {32, 40, 48, 56, 64, 96, 128}

_LONG_HEX = re.compile(r"[0-9a-f]{32,}")  # greedy: the same maximal runs as _HEX, without the short ones
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_ALL_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_LETTER = re.compile(r"[A-Za-z]")
_NUMERIC = re.compile(r"[0-9+/_=.eE-]+")


@lru_cache(2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "secret-scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, unsorted."""
    out = [("assign", m.start(), m.end(), True) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end(), True) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end(), True) for m in _LONG_HEX.finditer(text)]
    return out


def _known(run: str) -> bool:
    """Digests and identifiers, which are not secrets however random."""
    return bool(
        not _LETTER.search(run)
        or len(set(run)) < LEAST_SIGNS
        or _UUID.fullmatch(run)
        or _NUMERIC.fullmatch(run)
        or (len(run) in _DIGESTS and _ALL_HEX.fullmatch(run))
    )


def scanner(vocabulary: str) -> Callable[[str], list[Span]]:
    """Function text -> all spans by start, then kind."""
    encoding = _encoding(vocabulary)
    rank = {k: i for i, k in enumerate(KINDS)}

    def tokens(run: str) -> int:
        return sum(len(encoding.encode_ordinary(run[i : i + LONGEST_PIECE])) for i in range(0, len(run), LONGEST_PIECE))

    def search(text: str) -> list[Span]:
        out = base_spans(text)
        taken = [(s, e) for _, s, e, _ in out]
        for m in _RUN.finditer(text):
            if _known(m[0]) or any(s < m.end() and m.start() < e for s, e in taken):
                continue
            if len(m[0]) < RATIO * tokens(m[0]):
                out.append(("random", m.start(), m.end(), False))
        return sorted(out, key=lambda x: (x[1], rank[x[0]], x[2]))

    return search


def secrets(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (by start, then kind as in `KINDS`; `base` marks pattern matches).

    `vocabulary` is the path of a tiktoken rank file on every executor.

    Defined cases: a null or empty text has no spans; matches of one kind never overlap, those of several may;
    added spans never overlap base ones; null ids and repeated rows are searched like any others; texts and runs
    of any length are searched whole; an empty table gives no rows; other columns are not looked at.
    """
    found = span_column(lambda: scanner(vocabulary))
    return two_columns(docs, id_col, text_col).select("doc_id", found("text").alias("spans"))
