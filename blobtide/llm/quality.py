"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A text's indicators say which words, and which runs of one to three word shapes, occur in it. A
shape is a word's case, length class, last sign, whether it holds digits or signs inside, and whether it
repeats the word before. Each indicator is scaled by the log ratio of its frequency in good and bad
texts, the vector is brought to length one, and a linear model with hinge loss is fitted by dual
coordinate descent. As usual for this model, its weights are drawn towards their mean magnitude.

The log-count ratios come from all labelled texts, counted by Spark into `SLOTS` slots (which bounds what
is collected and broadcast to about 2 MB); the linear model is fitted on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blobtide.llm import words as W
from blobtide.llm.labelled import labelled, logistic
from blobtide.llm.tables import fold, two_columns

SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
FOLDS, HELD_OUT, CALIBRATION_FOLD = 4, 2, 3
TRAIN_ROWS = 6_000  # most labelled texts that the linear model is fitted on
CALIBRATION_ROWS = 20_000  # most that the logistic curve is fitted on
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
MIXING = 0.5  # weight of the fitted model against its mean magnitude
THRESHOLD = 0.7

_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LOWER_CASE = np.zeros(256, np.int64)
_LOWER_CASE[97:123] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_SIGN = np.zeros(256, np.int64)
_SIGN[:128] = 1 - (_UPPER + _LOWER_CASE + _DIGIT)[:128]


def _shapes(words: W.Words) -> np.ndarray:
    """Integer code of each word's shape."""
    data, starts, ends = words.data, words.starts, words.ends

    def count(table):
        sums = np.concatenate([[0], np.cumsum(table[data])])
        return sums[ends] - sums[starts]

    upper, lower, digit, sign = count(_UPPER), count(_LOWER_CASE), count(_DIGIT), count(_SIGN)
    length = np.digitize(ends - starts, [2, 3, 5, 9, 17, 33])
    case = np.where(upper == 0, 0, np.where(lower > 0, np.where(upper == 1, 1, 2), 3))
    last = np.where(_SIGN[data[ends - 1]] == 1, data[ends - 1], 0).astype(np.int64)
    same = np.zeros(len(starts), np.int64)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    firsts = words.bounds[:-1][words.counts() > 0]
    same[firsts] = 0
    code = length + 8 * case + 32 * (digit > 0) + 64 * np.minimum(sign, 3) + 256 * same
    return code * 256 + last


def indicators(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(slots, bounds): the distinct slots of text i are slots[bounds[i]:bounds[i + 1]], ascending."""
    n = len(words.hashes)
    text = np.repeat(np.arange(words.n_texts), words.counts())
    shape = W.mix(_shapes(words).astype(np.uint64) + np.uint64(1 << 40))
    parts = [(text << SLOT_BITS) | (words.hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    for k in (1, 2, 3):
        if n >= k:
            whole = text[: n - k + 1] == text[k - 1 :]
            slot = (W.grams(shape, k) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            parts.append(((text[: n - k + 1] << SLOT_BITS) | slot)[whole])
    keys = np.unique(np.concatenate(parts))
    return keys & (SLOTS - 1), np.searchsorted(keys, np.arange(words.n_texts + 1) << SLOT_BITS)


def _words(data: np.ndarray, offsets: np.ndarray) -> W.Words:
    return W.words_of(data, offsets, W.NOT_SPACE)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many good and bad texts have an indicator, summed over the task."""
    good, bad = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    for batch in batches:
        labels = np.asarray(batch.column("label").to_pylist(), np.int64)
        at = 0
        for data, offsets in W.slices(batch.column("text")):
            slots, bounds = indicators(_words(data, offsets))
            n = len(offsets) - 1
            is_good = np.repeat(labels[at : at + n], np.diff(bounds)) == 1
            at += n
            good += np.bincount(slots[is_good], minlength=SLOTS)
            bad += np.bincount(slots[~is_good], minlength=SLOTS)
    used = np.flatnonzero(good + bad)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array(good[used]), pa.array(bad[used])], names=["slot", "good", "bad"]
    )


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _slots_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = []
        for data, offsets in W.slices(batch):
            slots, bounds = indicators(_words(data, offsets))
            rows += [slots[a:b].astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.array(rows, pa.list_(pa.int32()))


@dataclass
class Model:
    """Weight of each slot's indicator, its square length, and the curve from margin to probability."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    curve: np.ndarray

    def margins(self, slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[slots], dtype=np.float64)])
        squares = np.concatenate([[0.0], np.cumsum(self.squares[slots], dtype=np.float64)])
        low, high = bounds[:-1], bounds[1:]
        length = np.sqrt(np.maximum(squares[high] - squares[low], 1e-12))
        return np.where(high > low, (sums[high] - sums[low]) / length, 0.0) + self.bias

    def scores(self, slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        z = self.margins(slots, bounds) * self.curve[0] + self.curve[1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def dual_coordinate_descent(
    rows: list[np.ndarray], ratios: np.ndarray, labels: np.ndarray, cost: np.ndarray
) -> tuple[np.ndarray, float]:
    """Hinge-loss weights (per slot, before scaling by the ratio) and bias; labels are 1 and -1.

    Each row is the ratios of its slots, brought to length one, and a constant for the bias.
    """
    weights, bias = np.zeros(len(ratios)), 0.0
    values = [ratios[r] / max(np.linalg.norm(ratios[r]), 1e-9) for r in rows]
    diagonal = np.array([v @ v + 1.0 for v in values])
    alpha = np.zeros(len(rows))
    random = np.random.Generator(np.random.PCG64(7))
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            r, v, y = rows[i], values[i], labels[i]
            gradient = y * (weights[r] @ v + bias) - 1
            step = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                weights[r] += step * y * v
                bias += step * y
    return weights, bias


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows. `docs` has doc_id and text, `labels` doc_id and quality.

    With no labels, or labels of one class only, every text gets the share of good ones (0.5 without any).
    """
    known = labelled(docs, labels, "quality", FOLDS, HELD_OUT)
    fitted = known.filter(fold(F.col("doc_id"), FOLDS) != CALIBRATION_FOLD)
    counts = (
        fitted.select("text", "label")
        .mapInArrow(_count_batches, "slot int, good bigint, bad bigint")
        .groupBy("slot")
        .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        .toArrow()
    )
    good, bad = np.full(SLOTS, SMOOTHING), np.full(SLOTS, SMOOTHING)
    slot = counts.column("slot").to_numpy()
    good[slot] += counts.column("good").to_numpy()
    bad[slot] += counts.column("bad").to_numpy()
    ratios = np.log((good / good.sum()) / (bad / bad.sum()))
    unseen = np.ones(SLOTS, bool)
    unseen[slot] = False
    ratios[unseen] = 0.0

    table = (
        _sample(fitted, TRAIN_ROWS).select("label", "o", _slots_of("text").alias("slots")).orderBy("o", "label").limit(TRAIN_ROWS).toArrow()
    )
    labels_of = table.column("label").to_numpy()
    lists = table.column("slots").combine_chunks()
    rows = np.split(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(lists.value_lengths().to_numpy())[:-1])
    share = labels_of.mean() if len(labels_of) else 0.5
    if share in (0.0, 1.0) or not len(labels_of):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(SLOTS), ratios**2, 0.0, np.array([0.0, np.log(share / (1 - share))]))
    signs = np.where(labels_of == 1, 1.0, -1.0)
    # both classes weigh the same in the loss
    cost = COST * np.where(labels_of == 1, 0.5 / share, 0.5 / (1 - share))
    fitted_weights, bias = dual_coordinate_descent(rows, ratios, signs, cost)
    weights = (MIXING * fitted_weights + (1 - MIXING) * np.abs(fitted_weights).mean()) * ratios
    model = Model(weights.astype(np.float32), (ratios**2).astype(np.float32), bias, np.array([1.0, 0.0]))
    # the margins are taken where the texts are; two numbers a row come back
    margin = _text_column(docs.sparkSession, model, Model.margins)
    held = (
        _sample(known.filter(fold(F.col("doc_id"), FOLDS) == CALIBRATION_FOLD), CALIBRATION_ROWS)
        .select("label", "o", margin("text").alias("margin")).orderBy("o", "label").limit(CALIBRATION_ROWS).toArrow()
    )
    held_labels = held.column("label").to_numpy()
    if len(set(held_labels)) == 2:
        model.curve = logistic(held.column("margin").to_numpy()[:, None], held_labels)
    return model


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """(label, text, o): the rows of smallest hash o, a few more than `most`.

    The bound on the hash comes from the number of rows, so that no more than these are looked at, whatever the
    number of partitions.
    """
    hashed = rows.select("label", "text", F.xxhash64("doc_id", "text").alias("o"))
    share = (most + 6 * np.sqrt(most)) / max(rows.count(), 1)
    return hashed if share >= 1 else hashed.filter(F.col("o") < F.lit(int(share * 2**64) - 2**63))


def _text_column(spark: SparkSession, model: Model, of: Callable):
    """Column function: text to what `of` (model, slots, bounds) makes of it."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def value(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [of(held.value, *indicators(_words(d, o))) for d, o in W.slices(batch)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0))

    return value


def score_column(spark: SparkSession, model: Model):
    """Column function: text to its probability of being good."""
    return _text_column(spark, model, Model.scores)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Defined cases: a null, empty or wordless text has no indicators and gets the curve's value at the bias; a
    null id is scored and is not held out; repeated rows are scored each; an empty table gives no rows;
    labels without a document and other columns are not used.
    """
    docs = two_columns(docs, id_col, text_col)
    score = score_column(docs.sparkSession, train(docs, labels))
    return docs.select(
        "doc_id",
        F.coalesce((fold(F.col("doc_id"), FOLDS) == HELD_OUT) & F.col("doc_id").isNotNull(), F.lit(False)).alias("held_out"),
        score("text").alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
