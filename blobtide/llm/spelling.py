"""Grouping of spelling variants with a bit-sliced position index.

Words of the vocabulary within one inserted, deleted or replaced sign of each other are near. For a set of
words the index keeps, per (position, letter), a bitset of the words with that letter there. A query word
of l letters walks its letters once and keeps three bitsets, whole words of 64 candidates at a time:

    none' = none AND here[i]                            the first i letters agree
    one'  = (one AND here[i]) OR (none AND NOT here[i])    one letter replaced
    more' = (one more OR none) AND here[i + 1]          the candidate has one more letter, so it is one position ahead

Pairs are looked for among words that can be near only. Of two near words, the shorter one with s letters, either
the first or the last s div 2 letters agree, since the difference lies on one side. So words meet under (s, head) and
under (s, tail); a word of m letters joins the groups of s = m and s = m - 1. A group with more than
`MOST_IN_GROUP` words is split the same way on what lies between its head and tail, again and again; at the end
a single letter is open, so no group outgrows the alphabet squared. A pair that agrees on both sides
counts on the head's side only, so each pair is found once.

Groups arrive in the order of their key and are worked off in batches; no group is held by more than one task
and no task holds more than a few groups. Only matches leave a task, one row per word of a group.

Defined results: null texts have no words, a null id hashes like an empty one, repeated rows count as often as
they occur, an empty table gives an empty result, and other columns are not read. A word of any length takes part; bitsets
are built for a range of positions at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobtide.llm.tables import stored, two_columns

LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5
DROP_MODULUS = 199
MOST_IN_GROUP = 4096

_TABLE_WORDS = 1 << 21  # 64-bit words of one index table
_PAIRS = 1 << 18  # (query, 64 candidates) worked on side by side
_SIGNS = 1 << 21  # letters of the words of one batch

# The letters of words.
_LETTERS = "a-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["s", "a", "b", "head", "tail"]


def runs(text: Column, least: int) -> Column:
    """Maximal runs of letters, A-Z in lower case, of at least `least` letters."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"([{_LETTERS}]{{{least},}})"), 1)


def vocabulary(
    docs: DataFrame,
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    drop_modulus: int | None = DROP_MODULUS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(word, n): words of at least `least_letters` letters that occur at least `least_count` times.

    With `drop_modulus` a run loses one letter where the crc32 of its document and itself is a multiple of it.
    Counting has map-side sums, so a frequent word is one row per task.
    """
    found = two_columns(docs, id_col, text_col).select("doc_id", F.explode(runs(F.col("text"), least_letters)).alias("run"))
    word = F.col("run")
    if drop_modulus is not None:
        name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
        found = found.select("run", F.crc32(name.cast("binary")).alias("h"))
        at = (F.col("h") % F.char_length("run")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        word = F.when(F.col("h") % drop_modulus == 0, shorter).otherwise(F.col("run"))
    words = found.select(word.alias("word")).where(F.char_length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


# groups


def _halves(rows: DataFrame) -> DataFrame:
    """Each row under the longer head and under the longer tail.

    A pair counts in a group if it agrees on fewer than `cap` letters at the start, or else it also met under the longer
    head; a head as long as that has nothing to count and is left out.
    """
    step = F.expr("(s - a - b) div 2").cast("int")
    sides = F.array(
        F.struct((F.col("a") + step).alias("a"), F.col("b").alias("b"), F.col("cap").alias("cap")),
        F.struct(F.col("a").alias("a"), (F.col("b") + step).alias("b"), F.least(F.col("cap"), F.col("a") + step).alias("cap")),
    )
    some = F.filter(sides, lambda x: x["a"] < x["cap"])
    split = rows.select("word", "n", "s", F.explode(some).alias("x")).select("word", "n", "s", "x.a", "x.b", "x.cap")
    return split.select(
        "word", "n", "s", "a", "b", "cap",
        F.substring("word", F.lit(1), F.col("a")).alias("head"),
        F.substring("word", F.char_length("word") - F.col("b") + 1, F.col("b")).alias("tail"),
    )


def groups(words: DataFrame, least_letters: int = LEAST_LETTERS, most: int = MOST_IN_GROUP) -> DataFrame:
    """Rows (word, n, s, a, b, cap, head, tail): each word once for every group it belongs to."""
    m = F.char_length("word")
    lengths = F.filter(F.array(m, m - 1), lambda s: s >= least_letters)
    top = words.select("word", "n", F.explode(lengths).alias("s")).select(
        "word", "n", "s", F.lit(0).alias("a"), F.lit(0).alias("b"), (F.col("s") + 1).alias("cap")
    )
    found = _halves(top)
    while True:
        crowded = stored(
            found.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_words")).where((F.col("_words") > most) & F.expr("s - a - b >= 2")).drop("_words"),
            "crowded",
        )
        if crowded.isEmpty():
            return found
        again = _halves(found.join(crowded, _KEY, "left_semi"))
        found = stored(found.join(crowded, _KEY, "left_anti").unionByName(again), "groups")


# the index


def _lanes(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitset words per group, and the first of each."""
    lanes = (sizes + 63) // 64
    return lanes, np.cumsum(lanes) - lanes


def near_pairs(codes: np.ndarray, short: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) at distance one inside each group bounds[g]:bounds[g + 1].

    `codes` has the letters of every word between head and tail, one row each, 0 after the end; the longest
    has width letters, and the rows of `short` have one less. Queries are the short words; candidates are short (replaced) or not
    (one letter more).
    """
    letters, codes = np.unique(codes, return_inverse=True)
    codes = codes.reshape(len(short), -1)
    width = codes.shape[1]
    sizes = np.diff(bounds)
    lanes, first_lane = _lanes(sizes)
    group = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(short)) - bounds[group]
    lane = first_lane[group] + inside // 64
    bit = np.left_shift(np.uint64(1), (inside % 64).astype(np.uint64))
    n_lanes = int(lanes.sum())
    is_short, is_long = np.zeros(n_lanes, np.uint64), np.zeros(n_lanes, np.uint64)
    np.bitwise_or.at(is_short, lane[short], bit[short])
    np.bitwise_or.at(is_long, lane[~short], bit[~short])
    first_word = bounds[np.repeat(np.arange(len(sizes)), lanes)] + 64 * (np.arange(n_lanes) - np.repeat(first_lane, lanes))

    queries = np.flatnonzero(short)
    per_query = lanes[group[queries]]
    query = np.repeat(queries, per_query)
    within = np.arange(len(query)) - np.repeat(np.cumsum(per_query) - per_query, per_query)
    at = first_lane[group[query]] + within

    none = np.full(len(query), np.iinfo(np.uint64).max, np.uint64)
    one, more = np.zeros(len(query), np.uint64), np.zeros(len(query), np.uint64)
    span = max(1, _TABLE_WORDS // (len(letters) * n_lanes) - 1)
    for start in range(0, width - 1, span):
        stop = min(start + span, width - 1)
        # positions start..stop; one more than the queries have, for candidates that are ahead
        index = np.zeros((stop + 1 - start, len(letters), n_lanes), np.uint64)
        for p in range(start, stop + 1):
            np.bitwise_or.at(index[p - start], (codes[:, p], lane), bit)
        for i in range(start, stop):
            letter = codes[query, i]
            here, ahead = index[i - start, letter, at], index[i + 1 - start, letter, at]
            more = (more | none) & ahead
            one = (one & here) | (none & ~here)
            none = none & here
    near = (one & is_short[at]) | ((more | none) & is_long[at])
    some = np.flatnonzero(near)
    bits = np.unpackbits(near[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    hit, place = np.nonzero(bits)
    return query[some[hit]], first_word[at[some[hit]]] + place


def _letters(words: list[str], width: int) -> np.ndarray:
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


def _common_start(codes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many letters two different rows have in common from the start."""
    step = max(1, _SIGNS // codes.shape[1])
    parts = [np.argmax(codes[left[i : i + step]] != codes[right[i : i + step]], axis=1) for i in range(0, len(left), step)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _best(word: np.ndarray, other: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word with partners: how many, and the one of largest n (then smallest word)."""
    order = np.lexsort((rank[other], -n[other], word))
    word, other = word[order], other[order]
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, np.int64)
    return word[first], np.diff(np.r_[first, len(word)]), other[first]


def _pieces(sizes: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Consecutive groups that are worked on together."""
    lanes, _ = _lanes(sizes)
    first, pairs, signs = 0, 0, 0
    for g in range(len(sizes)):
        more_pairs, more_signs = int(sizes[g] * lanes[g]), int(sizes[g]) * width
        if g > first and (pairs + more_pairs > _PAIRS or signs + more_signs > _SIGNS):
            yield first, g
            first, pairs, signs = g, 0, 0
        pairs, signs = pairs + more_pairs, signs + more_signs
    if first < len(sizes):
        yield first, len(sizes)


def _partners(words: np.ndarray, n: np.ndarray, s: np.ndarray, a: np.ndarray, b: np.ndarray, cap: np.ndarray, bounds: np.ndarray):
    """Yields (word, near words, best one, its n) of whole groups."""
    sizes = np.diff(bounds)
    open_letters = (s - a - b)[bounds[:-1]]
    for width in np.unique(open_letters):
        mine = np.flatnonzero((open_letters == width) & (sizes > 1))
        for first, last in _pieces(sizes[mine], int(width) + 1):
            some = mine[first:last]
            rows = np.concatenate([np.arange(bounds[g], bounds[g + 1]) for g in some])
            local = np.r_[0, np.cumsum(sizes[some])]
            texts = words[rows].tolist()
            middles = [w[i : len(w) - j] for w, i, j in zip(texts, a[rows].tolist(), b[rows].tolist(), strict=True)]
            short = np.array([len(w) for w in middles]) == width
            codes = _letters(middles, int(width) + 1)
            query, other = near_pairs(codes, short, local)
            fresh = a[rows[query]] + _common_start(codes, query, other) < cap[rows[query]]
            query, other = query[fresh], other[fresh]
            rank = np.empty(len(rows), np.int64)
            rank[sorted(range(len(rows)), key=texts.__getitem__)] = np.arange(len(rows))
            longer = ~short[other]  # short words find each other from both sides, longer ones are only found
            word, count, best = _best(np.r_[query, other[longer]], np.r_[other, query[longer]], n[rows], rank)
            yield words[rows[word]], count, words[rows[best]], n[rows[best]]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups: a batch's last group waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        begin = batch.num_rows - int(np.argmax(np.r_[keys[::-1] != keys[-1], True]))
        if held and begin == 0 and held[-1].column("key")[-1].as_py() == keys[-1]:
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, begin)])
        held = [batch.slice(begin)]
    if held:
        yield pa.Table.from_batches(held)


def _near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _batches(batches):
        if table.num_rows < 2:
            continue
        keys, words, n, s, a, b, cap = (
            table.column(c).to_numpy() for c in ("key", "word", "n", "s", "a", "b", "cap")
        )
        bounds = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for word, count, best, best_n in _partners(words, n, *(x.astype(np.int64) for x in (s, a, b, cap)), bounds):
            yield pa.RecordBatch.from_arrays(
                [pa.array(word, pa.string()), pa.array(count.astype(np.int64)), pa.array(best, pa.string()), pa.array(best_n)],
                names=["word", "near", "best", "best_n"],
            )


def near_words(words: DataFrame, least_letters: int = LEAST_LETTERS, most: int = MOST_IN_GROUP) -> DataFrame:
    """Per word with near words: word, n_near, and the near word of largest n (ties: the smallest), best and best_n."""
    keyed = groups(words, least_letters, most).select(
        F.concat_ws("|", *_KEY).alias("key"), "word", "n", "s", "a", "b", "cap"
    )
    found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_near_rows, "word string, near bigint, best string, best_n bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("down"), "best")).alias("top")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select(
        "word", "n_near", "top.best", (-F.col("top.down")).alias("best_n")
    )


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form). n grows at least `TIMES` fold along a link, so chains are short and end; steps double."""
    found = links.select("word", F.col("form").alias("root"))
    while True:
        onward = found.select(F.col("word").alias("_at"), F.col("root").alias("_root"))
        found = stored(
            found.join(onward, F.col("root") == F.col("_at"), "left").select(
                "word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")
            ),
            "roots",
        )
        if found.where("_moved").isEmpty():
            return found.drop("_moved")
        found = found.drop("_moved")


def spelling_variants(
    docs: DataFrame,
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    times: int = TIMES,
    drop_modulus: int | None = DROP_MODULUS,
    most: int = MOST_IN_GROUP,
) -> DataFrame:
    """Per word of the vocabulary: word, form, root, n, n_near, form_n.

    The form of a word is its near word of largest n, if that is at least `times` the word's n; the root is where
    forms lead. A word without a form is its own root.
    """
    words = stored(vocabulary(docs, least_letters, least_count, drop_modulus), "vocabulary")
    near = near_words(words, least_letters, most)
    chosen = F.col("best_n") >= times * F.col("n")
    formed = stored(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
