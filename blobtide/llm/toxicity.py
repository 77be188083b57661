"""Toxicity by two class-conditional Kneser-Ney models over letters.

Insults come in many inflected forms of a stem, so the models run over the letters of a text, lower-cased, with
every other stretch of characters as one space: a stem keeps its word start. Letters beyond Latin-1 fall into 64
classes. Runs of `ORDER` symbols are counted per class, over all labelled texts (at most `LABELLED_ROWS`).
A class's estimate of a symbol after `ORDER - 1` others is discounted and interpolated with a shared Kneser-Ney
distribution of lower order, made of continuation counts of all runs of both classes.

A run whose counts do not tell the classes apart (log-likelihood statistic below `LEAST_G2`) is an expression too
rare or too even to judge by: it takes the shared estimate in both classes and is no evidence. That bar does not
depend on the size of the corpus. The runs above it are what the driver gathers and broadcasts; they are limited
by the number of labelled rows.

A text's evidence is its log-likelihood under the toxic model less that under the ordinary one,
divided by its length: once over the whole text, and once over its most toxic stretch of `STRETCH`
symbols, since an insult in a long text is local. A logistic curve on these two numbers, fitted on
labelled texts that were not counted, turns them into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blobtide.llm import words as W
from blobtide.llm.labelled import labelled, logistic
from blobtide.llm.tables import fold, stored, two_columns

ORDER, SHARED_ORDER = 6, 3
LABELLED_ROWS = 2_000_000  # most labelled texts that are counted, chosen by a bound on a hash of id and text
LEAST_G2 = 12.0
DISCOUNT = 0.75
STRETCH = 12
FOLDS, HELD_OUT, CALIBRATION_FOLD = 5, 0, 1
TOXIC_WEIGHT = 3.0  # a missed toxic text costs as much as so many clean ones taken for toxic
CALIBRATION_ROWS = 20_000  # most labelled texts that the logistic curve is fitted on

# Texts are taken so many bytes at once, or one longer text alone; the arrays over its symbols take about 70 times that.
SLICE_BYTES = 500_000
COUNTED = 4_000_000  # bytes of text whose runs are summed before they are passed on

_SPACE = np.uint8(32)
_BITS = np.uint64(8)
_ALPHABET = 256


def _symbols() -> np.ndarray:
    """Symbol of each code point below 256: a letter is itself in lower case, anything else a space."""
    out = np.full(256, _SPACE)
    for code in range(256):
        if chr(code).isalpha():
            low = chr(code).lower()
            out[code] = ord(low) if len(low) == 1 and ord(low) < 256 else code
    return out


_LATIN = _symbols()


def _symbols_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One symbol per code point of UTF-8 texts, and the texts' bounds in symbols."""
    lead = (data & 0xC0) != 0x80
    bounds = np.concatenate([[0], np.cumsum(lead)])[offsets]
    starts = np.flatnonzero(lead)
    first = data[starts]
    symbols = _LATIN[np.where(first < 0x80, first, 0x20)]
    wide = np.flatnonzero(first >= 0xC0)
    at = starts[wide]
    n = len(data)
    second = data[np.minimum(at + 1, n - 1)] & 0x3F
    latin = first[wide] <= 0xC3
    symbols[wide[latin]] = _LATIN[((first[wide[latin]] & 0x03) << 6) | second[latin]]
    code = first[wide].astype(np.uint64) << np.uint64(6) | second
    for back, least in ((2, 0xE0), (3, 0xF0)):
        more = first[wide] >= least
        code = np.where(more, code << np.uint64(6) | (data[np.minimum(at + back, n - 1)] & 0x3F), code)
    other = ~latin & (first[wide] != 0xE2)  # E2 leads punctuation: dashes, quotes, spaces
    symbols[wide[other]] = (0x80 + (W.mix(code[other]) >> np.uint64(58))).astype(np.uint8)
    return symbols, bounds


@dataclass
class Runs:
    """Runs of `ORDER` symbols packed into integers; those of text i are bounds[i]:bounds[i + 1]."""

    packed: np.ndarray
    bounds: np.ndarray


def runs_of(data: np.ndarray, offsets: np.ndarray) -> Runs:
    """The run that ends at each symbol of each normalised text; before a text there is only space."""
    folded, offsets = _symbols_of(data, offsets)
    space = folded == _SPACE
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    firsts = offsets[:-1][np.diff(offsets) > 0]
    keep[firsts] = ~space[firsts]  # the padding is space already
    bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
    pad = ORDER - 1
    kept = folded[keep]
    text = np.insert(kept, np.repeat(bounds[:-1], pad), _SPACE)
    ends = np.arange(len(kept)) + pad * np.repeat(np.arange(1, len(bounds)), np.diff(bounds))
    packed = np.zeros(len(ends), np.uint64)
    for back in range(pad, -1, -1):
        packed = (packed << _BITS) | text[ends - back].astype(np.uint64)
    return Runs(packed, bounds)


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """One row (run, toxic, ordinary) for each run of `parts`, which are emptied."""
    runs, *counts = (np.concatenate(column) for column in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(runs)
    runs = runs[order]
    firsts = np.flatnonzero(np.diff(runs, prepend=runs[:1] - 1))
    return runs[firsts], *(np.add.reduceat(c[order], firsts) for c in counts)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with their counts per class, summed within each `COUNTED` bytes of texts."""
    for batch in batches:
        labels = np.asarray(batch.column("label").to_pylist(), np.int64)
        at, size, parts = 0, 0, []
        for data, offsets in W.slices(batch.column("text"), SLICE_BYTES):
            runs = runs_of(data, offsets)
            n = len(offsets) - 1
            toxic = np.repeat(labels[at : at + n], np.diff(runs.bounds)) == 1
            at, size = at + n, size + len(data)
            distinct, inverse = np.unique(runs.packed, return_inverse=True)
            all_of = np.bincount(inverse, minlength=len(distinct))
            toxic_of = np.bincount(inverse[toxic], minlength=len(distinct))
            parts.append((distinct.astype(np.int64), toxic_of, all_of - toxic_of))
            if size >= COUNTED or at == len(labels):
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in _summed(parts)], names=["run", "toxic", "ordinary"])
                size = 0


class Lookup:
    """Table of bounded size from packed runs to values; a 16-bit tag tells unknown runs from known ones.

    A run whose slot is taken goes to a second, smaller table, and so on.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        while len(keys):
            bits = max(10, int(2 * len(keys)).bit_length())
            slot, tag = self._place(keys, bits, len(self.levels))
            table, tags = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.uint16)
            _, kept = np.unique(slot, return_index=True)
            table[slot[kept]], tags[slot[kept]] = values[kept], tag[kept]
            self.levels.append((bits, table, tags))
            left = np.ones(len(keys), bool)
            left[kept] = False
            keys, values = keys[left], values[left]

    @staticmethod
    def _place(keys: np.ndarray, bits: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        h = W.mix(keys + np.uint64(level << 56))
        return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64(0xFFFF) | np.uint64(1)).astype(np.uint16)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether known)."""
        values, known = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        open_ = np.arange(len(keys))
        for level, (bits, table, tags) in enumerate(self.levels):
            slot, tag = self._place(keys[open_], bits, level)
            hit = tags[slot] == tag
            values[open_[hit]], known[open_[hit]] = table[slot[hit]], True
            open_ = open_[~hit]
        return values, known


@dataclass
class Models:
    runs: Lookup  # log-likelihood ratio of a run that tells the classes apart; any other run has none
    curve: np.ndarray  # weights of whole text, stretch, intercept

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, 2): length-normalised log-likelihood ratio of the whole text and of its worst stretch."""
        runs = runs_of(data, offsets)
        ratio, _ = self.runs.find(runs.packed)
        sums = np.concatenate([[0.0], np.cumsum(ratio, dtype=np.float64)])
        low, high = runs.bounds[:-1], runs.bounds[1:]
        counts = high - low
        whole = (sums[high] - sums[low]) / np.maximum(counts, 1)
        worst = np.zeros(len(counts))
        some = counts > 0
        if some.any():
            # each stretch ends at a byte and does not reach back over the start of its text
            start = np.maximum(np.arange(len(ratio)) + 1 - STRETCH, np.repeat(low, counts))
            worst[some] = np.maximum.reduceat((sums[1:] - sums[start]) / STRETCH, low[some])
        return np.stack([whole, worst], axis=1)

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        z = evidence @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _evidence(models):
    @F.arrow_udf("struct<whole:double,worst:double>")
    def evidence(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [models.value.evidence(d, o) for d, o in W.slices(batch, SLICE_BYTES)]
            found = np.concatenate(parts) if parts else np.empty((0, 2))
            yield pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["whole", "worst"])

    return evidence


class Shared:
    """Kneser-Ney distribution of the last of `SHARED_ORDER` symbols, over both classes.

    Tails count in how many different runs they occur; below them single symbols do, and at last all are alike.
    """

    def __init__(self, tails: np.ndarray, counts: np.ndarray):
        order = np.argsort(tails)
        self.tails, self.counts = tails[order], counts[order].astype(np.float64)
        self.heads, head = np.unique(self.tails >> _BITS, return_inverse=True)
        self.seen = np.bincount(head, self.counts, len(self.heads))
        self.kinds = np.bincount(head, minlength=len(self.heads))
        single = np.bincount((self.tails & np.uint64(0xFF)).astype(np.int64), minlength=_ALPHABET)
        total = max(single.sum(), 1)
        left_over = DISCOUNT * (single > 0).sum() / total if single.any() else 1.0
        self.single = np.maximum(single - DISCOUNT, 0) / total + left_over / _ALPHABET

    def of(self, tails: np.ndarray) -> np.ndarray:
        """Probability of each tail's last symbol after those before it."""
        lower = self.single[(tails & np.uint64(0xFF)).astype(np.int64)]
        if not len(self.tails):
            return lower
        at = np.minimum(np.searchsorted(self.tails, tails), len(self.tails) - 1)
        count = np.where(self.tails[at] == tails, self.counts[at], 0)
        head = np.minimum(np.searchsorted(self.heads, tails >> _BITS), len(self.heads) - 1)
        seen = np.where(self.heads[head] == tails >> _BITS, self.seen[head], 0)
        share = np.maximum(seen, 1)
        left_over = np.where(seen > 0, DISCOUNT * self.kinds[head] / share, 1.0)
        return np.maximum(count - DISCOUNT, 0) / share + left_over * lower


def estimate(count: np.ndarray, seen: np.ndarray, kinds: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """A class's probability of a run's last symbol: the run's count, its context's count and kinds, the shared one.

    A context that the class does not have is left to the shared distribution.
    """
    share = np.maximum(seen, 1)
    left_over = np.where(seen > 0, DISCOUNT * kinds / share, 1.0)
    return np.maximum(count - DISCOUNT, 0) / share + left_over * shared


def _statistic(toxic_total: int, ordinary_total: int) -> Column:
    """Log-likelihood statistic of a run: how unlike its counts are to the classes' sizes."""
    everything = toxic_total + ordinary_total
    both = F.col("toxic") + F.col("ordinary")
    out = F.lit(0.0)
    for name, total in (("toxic", toxic_total), ("ordinary", ordinary_total)):
        expected = both * F.lit(total / everything)
        out = out + F.when(F.col(name) > 0, 2 * F.col(name) * F.log(F.col(name) / expected)).otherwise(0.0)
    return out


def _bounded(known: DataFrame, most: int) -> DataFrame:
    """About `most` of the labelled rows by a bound on a hash of id and text; all of them if there are no more."""
    n = known.count()
    if n <= most:
        return known
    return known.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31)) < int(most / n * (1 << 31)))


def train(docs: DataFrame, labels: DataFrame) -> Models:
    """Count, smooth and calibrate. `docs` has doc_id and text, `labels` doc_id and toxic.

    With no labels, or labels of one class only, every text gets the share of toxic ones (almost 0 without any).
    """
    known = stored(labelled(docs, labels, "toxic", FOLDS, HELD_OUT), "labelled-texts")
    counts = stored(
        _bounded(known.filter(fold(F.col("doc_id"), FOLDS) != CALIBRATION_FOLD), LABELLED_ROWS)
        .select("text", "label")
        .mapInArrow(_count_batches, "run bigint, toxic bigint, ordinary bigint")
        .groupBy("run")
        .agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")),
        "run-counts",
    )
    sums = counts.agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).first()
    models = Models(Lookup(np.empty(0, np.uint64), np.empty(0)), np.zeros(3))
    judged = bool(sums["toxic"] and sums["ordinary"])
    if judged:
        tail = F.col("run").bitwiseAND(F.lit((1 << 8 * SHARED_ORDER) - 1))
        tails = counts.groupBy(tail.alias("tail")).agg(F.count("*").alias("n")).toArrow()
        context = F.shiftright("run", 8)
        telling = counts.filter(_statistic(sums["toxic"], sums["ordinary"]) >= LEAST_G2).withColumn("context", context)
        wanted = telling.select("context").distinct()
        contexts = (
            counts.select(context.alias("context"), "toxic", "ordinary")
            .groupBy("context")
            .agg(
                F.sum("toxic").alias("seen_toxic"),
                F.sum("ordinary").alias("seen_ordinary"),
                F.count_if(F.col("toxic") > 0).alias("kinds_toxic"),
                F.count_if(F.col("ordinary") > 0).alias("kinds_ordinary"),
            )
            .join(wanted, "context", "left_semi")
        )
        kept = telling.join(contexts, "context").drop("context").toArrow()
        column = lambda name: kept.column(name).to_numpy()
        run = column("run").astype(np.uint64)
        shared = Shared(tails.column("tail").to_numpy().astype(np.uint64), tails.column("n").to_numpy()).of(
            run & np.uint64((1 << 8 * SHARED_ORDER) - 1)
        )
        toxic, ordinary = (
            estimate(column(name), column(f"seen_{name}"), column(f"kinds_{name}"), shared) for name in ("toxic", "ordinary")
        )
        models.runs = Lookup(run, np.log(toxic / ordinary))
    held = docs.sparkSession.sparkContext.broadcast(models)
    sample = (
        _bounded(known.filter(fold(F.col("doc_id"), FOLDS) == CALIBRATION_FOLD), CALIBRATION_ROWS)
        .select("doc_id", "label", _evidence(held)("text").alias("e"))
        .select("doc_id", "label", "e.whole", "e.worst")
        .toPandas()
        .sort_values(["doc_id", "whole", "worst"])
    )
    held.destroy()
    if sample["label"].nunique() < 2 or not judged:
        share = known.agg(F.coalesce(F.avg("label"), F.lit(0.0)).alias("share")).first()["share"]
        share = min(max(share, 1e-6), 1 - 1e-6)
        models.curve = np.array([0.0, 0.0, np.log(share / (1 - share))])
    else:
        models.curve = logistic(sample[["whole", "worst"]].to_numpy(), sample["label"].to_numpy(), TOXIC_WEIGHT)
    return models


def score_column(spark: SparkSession, models: Models):
    """Column function: text to its probability of being toxic."""
    held = spark.sparkContext.broadcast(models)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [held.value.scores(held.value.evidence(d, o)) for d, o in W.slices(batch, SLICE_BYTES)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Defined cases: a null, empty or wordless text has no evidence and gets the curve's value at 0; a null id
    is scored and is not held out (labels need an id, so it is never learned from); repeated rows are
    scored each; an empty table gives no rows; labels without a document and other columns are not used.
    """
    docs = two_columns(docs, id_col, text_col)
    score = score_column(docs.sparkSession, train(docs, labels))
    return docs.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), score("text").alias("score")
    ).select(
        "doc_id",
        F.coalesce(F.col("held_out") & F.col("doc_id").isNotNull(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
