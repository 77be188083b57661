"""Benchmark decontamination by winnowing.

Every text is cut into words (ASCII letters lower-cased). From each run of `GUARD - GRAM + 1`
successive k-grams the one with the smallest hash is kept as a fingerprint. Two texts that share a
window of `GUARD` words see the same k-grams there and keep the same one, so joining the
fingerprints of documents and benchmark items finds every shared window; each hit is then extended
to the windows around it by comparing words. Items shorter than a window count as one window of
their own length and are fingerprinted by their one whole gram.

A fixed-size bitmap of the benchmark's fingerprints goes to every task, so that of a document only
the few fingerprints that may hit leave the scan. The bitmap only skips work: with a benchmark so
large that all bits are set, all fingerprints are joined and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blobtide.llm import words as W
from blobtide.llm.tables import join_on, stored, two_columns

GUARD = 13  # words of a window
GRAM = 8  # words of a fingerprinted gram
SPAN = GUARD - GRAM + 1  # grams in a window
BITMAP_BITS = 1 << 20

_PRINT = T.StructType(
    [
        T.StructField("size", T.IntegerType()),  # words of the window this print stands for
        T.StructField("print", T.LongType()),
        T.StructField("at", T.IntegerType()),  # position of the gram
        T.StructField("first", T.IntegerType()),  # position of the first word of `around`
        T.StructField("around", T.StringType()),  # the gram with the words an extension can reach
    ]
)
_TEXT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("prints", T.ArrayType(_PRINT)),
    ]
)


def winnowed(hashes: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Positions of the smallest hash of each run of `span` grams (the last one of equal hashes)."""
    if len(hashes) < span:
        return np.empty(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(hashes, span)
    last = span - 1 - np.argmin(runs[:, ::-1], axis=1)
    return np.unique(np.arange(len(runs)) + last)


def _slots(prints: np.ndarray) -> np.ndarray:
    return (prints >> np.uint64(11)) % np.uint64(BITMAP_BITS)


def _fingerprints(words: W.Words, short: list[int], bitmap: np.ndarray | None):
    """(text, size, print, position) arrays of all texts of a slice; prints outside the bitmap are left out."""
    found = []
    text_of = np.repeat(np.arange(words.n_texts), words.counts())
    counts = words.counts()

    def passing(prints, at):
        if bitmap is None:
            return prints, at
        slot = _slots(prints)
        hit = (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
        return prints[hit == 1], at[hit == 1]

    grams = W.grams(words.hashes, GRAM)
    if len(grams) >= SPAN:
        ends = words.bounds[1:][text_of]
        # windows that lie in one text: their grams are those of the text alone
        starts = np.flatnonzero(np.arange(len(words.hashes)) + GUARD <= ends)
        runs = np.lib.stride_tricks.sliding_window_view(grams, SPAN)[starts]
        at = np.unique(starts + SPAN - 1 - np.argmin(runs[:, ::-1], axis=1))
        prints, at = passing(grams[at], at)
        found.append((np.full(len(at), GUARD), prints, at))
    for size in short:
        if bitmap is None:  # an item is its own window; longer texts have none of this size
            at = words.bounds[:-1][counts == size]
        else:
            at = np.flatnonzero(np.arange(len(words.hashes)) + size <= words.bounds[1:][text_of])
        grams = W.grams(words.hashes, size)
        prints, at = passing(W.mix(grams[at] ^ np.uint64(size)), at)
        found.append((np.full(len(at), size), prints, at))
    if not found:
        return text_of[:0], *(np.empty(0, np.int64),) * 3
    size, prints, at = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((size, at))
    return text_of[at[order]], size[order], prints[order], at[order]


def _printer(short: list[int], bitmap: bytes | None):
    """Column function text -> struct<n_words, prints>."""

    @F.arrow_udf(_TEXT)
    def prints_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits = None if bitmap is None else np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            rows = []
            for data, offsets in W.slices(batch):
                words = W.words_of(data, offsets, W.ALNUM_LOWER, W.LOWER)
                per_text: list[list] = [[] for _ in range(words.n_texts)]
                for i, size, gram, at in zip(*_fingerprints(words, short, bits), strict=True):
                    low, high = words.bounds[i], words.bounds[i + 1]
                    reach = SPAN - 1 if size == GUARD else 0
                    width = GRAM if size == GUARD else size
                    first = max(low, at - reach)
                    per_text[i].append(
                        {
                            "size": int(size),
                            "print": int(np.int64(gram)) if gram < 1 << 63 else int(gram) - (1 << 64),
                            "at": int(at - low),
                            "first": int(first - low),
                            "around": words.joined(first, min(high, at + width + reach)),
                        }
                    )
                rows += [
                    {"n_words": int(n), "prints": p}
                    for n, p in zip(words.counts(), per_text, strict=True)
                ]
            yield pa.array(rows, type=_ARROW_TEXT)

    return prints_of


_ARROW_TEXT = pa.struct(
    [
        ("n_words", pa.int64()),
        (
            "prints",
            pa.list_(
                pa.struct(
                    [
                        ("size", pa.int32()),
                        ("print", pa.int64()),
                        ("at", pa.int32()),
                        ("first", pa.int32()),
                        ("around", pa.string()),
                    ]
                )
            ),
        ),
    ]
)


def _bitmap(prints: DataFrame) -> bytes:
    """One bit per slot that a benchmark print falls into: `BITMAP_BITS / 8` bytes whatever the benchmark."""
    slot = F.pmod(F.shiftrightunsigned("print", 11), F.lit(BITMAP_BITS))
    parts = (
        prints.groupBy(F.shiftright(slot, 3).alias("byte"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (slot % 8).cast("int"))).alias("bits"))
        .collect()
    )
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for part in parts:
        out[part["byte"]] = part["bits"]
    return out.tobytes()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, hits (array of window starts and sizes), item_ids.

    `hits` are the distinct (start, size) windows that occur in a benchmark item, by position;
    `item_ids` are the ids, as sorted strings, of the items with an occurring window.

    Defined cases: a null or wordless text has no words and no hits; a null id stays null and is
    judged like any other; rows that repeat an id are judged each by its own text; items with a null
    id have windows but add no item id; repeated items count once; with no documents or no items
    the result is empty or has no hits; other columns of either table are not looked at. A shared
    passage however frequent is joined by its fingerprint, and a skewed fingerprint can be split.
    """
    items = two_columns(benchmark, item_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sized = items.select("doc_id", "text", _printer([], None)("text")["n_words"].alias("n_words"))
    short = sorted(
        r["n_words"]
        for r in sized.filter((F.col("n_words") > 0) & (F.col("n_words") < GUARD)).select("n_words").distinct().collect()
    )
    item_prints = stored(
        items.select("doc_id", _printer(short, None)("text").alias("t"))
        .select(F.col("doc_id").cast("string").alias("item_id"), F.explode("t.prints").alias("p"))
        .select("item_id", "p.size", "p.print", "p.at", "p.first", "p.around")
        .distinct(),
        "item-prints",
    )
    printed = stored(
        two_columns(docs, id_col, text_col)
        .select("doc_id", F.xxhash64("text").alias("copy"), F.length("text").alias("length"),
                _printer(short, _bitmap(item_prints))("text").alias("t"))
        .select("doc_id", "copy", "length", "t.n_words", "t.prints"),
        "doc-prints",
    )
    # Rows with the same id and text have the same prints; they are joined once.
    key = ["doc_id", "copy", "length"]
    prints = (
        printed.filter(F.size("prints") > 0)
        .select(*key, F.explode("prints").alias("p"))
        .select(*key, "p.size", "p.print", F.col("p.at").alias("doc_at"), F.col("p.first").alias("doc_first"),
                F.split("p.around", " ").alias("doc_words"))
    )
    paired = prints.join(
        item_prints.select("size", "print", "item_id", F.col("at").alias("item_at"),
                           F.col("first").alias("item_first"), F.split("around", " ").alias("item_words")),
        ["size", "print"],
    )
    # Extension: of the windows around the gram, those whose words agree on both sides.
    aligned = F.filter(
        F.sequence(F.lit(0), F.when(F.col("size") == GUARD, SPAN - 1).otherwise(0)),
        lambda back: (F.col("doc_at") - back >= F.col("doc_first"))
        & (F.col("item_at") - back >= F.col("item_first"))
        & (F.size(F.slice("doc_words", F.col("doc_at") - F.col("doc_first") - back + 1, F.col("size"))) == F.col("size"))
        & (
            F.slice("doc_words", F.col("doc_at") - F.col("doc_first") - back + 1, F.col("size"))
            == F.slice("item_words", F.col("item_at") - F.col("item_first") - back + 1, F.col("size"))
        ),
    )
    windows = paired.select(*key, "item_id", "size", "doc_at", F.explode(aligned).alias("back")).select(
        *key, "item_id", (F.col("doc_at") - F.col("back")).alias("start"), "size"
    )
    hits = windows.groupBy(*key).agg(
        F.sort_array(F.collect_set(F.struct("start", "size"))).alias("hits"),
        F.sort_array(F.collect_set("item_id")).alias("item_ids"),
    )
    return join_on(printed, hits, key).select(
        "doc_id",
        F.col("copy").alias("text_hash"),
        "n_words",
        F.coalesce("hits", F.expr("CAST(array() AS array<struct<start:int,size:int>>)")).alias("hits"),
        F.coalesce("item_ids", F.expr("CAST(array() AS array<string>)")).alias("item_ids"),
    )


def words_hit(hits):
    """Number of words inside any of the windows (sorted by start)."""
    covered = F.aggregate(
        hits,
        F.struct(F.lit(0).alias("until"), F.lit(0).cast("bigint").alias("total")),
        lambda seen, w: F.struct(
            F.greatest(seen["until"], w["start"] + w["size"]).alias("until"),
            (seen["total"] + F.greatest(F.lit(0), w["start"] + w["size"] - F.greatest(seen["until"], w["start"]))).alias("total"),
        ),
    )
    return covered["total"]


def is_contaminated(n_hit, n_words):
    return (n_hit > 0) & (n_hit * 20 >= n_words)
