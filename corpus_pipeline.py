"""From raw documents to encoded training text, stage by stage.

Each stage takes what its predecessor kept and returns it with the same columns; the last returns pieces.
The scratch tables of a stage are deleted when the next stage begins, so a stage's result must have been
written by then, as `run` does.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blobtide.llm import decontamination, line_dedup, near_duplicates, pieces, toxicity
from blobtide.llm.tables import read, stored, without
from blobtide.scratch import Scope

PIECE_MODEL = "piece_bpe_32k.model"
DROPOUT_SEED, DROPOUT_RATE = 17, 0.1
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_last_stage: dict[str, Scope] = {}


def _owns_tables(stage: Stage) -> Stage:
    """The stage with its scratch tables in a scope of its own, after deleting those of the stage before."""

    @wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        if app in _last_stage:
            _last_stage.pop(app).free()
        own = _last_stage[app] = Scope(spark)
        with own.open():
            return stage(spark, docs, sf_dir)

    return begin


@_owns_tables
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5. Null and empty texts have no evidence and stay."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    score = toxicity.score_column(spark, toxicity.train(plain, read(spark, sf_dir, "labels")))
    return docs.withColumn("_toxicity", score("text")).filter(F.col("_toxicity") < 0.5).select(*docs.columns)


@_owns_tables
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later matches of earlier lines. A document that is nothing but such lines goes."""
    cleaned = line_dedup.dedup_lines(docs, report="_lines")
    spent = (F.col("_lines.n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cleaned.filter(~F.coalesce(spent, F.lit(False))).select(
        *[F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    )


@_owns_tables
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id. Of repeated ids one row stays.

    Rows without an id cannot stand for a group: they go if a document with an id has the same words, else they stay.
    """
    found = stored(near_duplicates.near_duplicates(docs), "near-duplicates")
    left = without(docs, found.filter(~F.col("kept")))
    repeated = stored(
        found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_id")),
        "repeated-ids",
    )
    if repeated.isEmpty():
        return left
    once = left.join(repeated, left["doc_id"] == repeated["_id"], "left_semi").dropDuplicates(["doc_id"])
    return left.join(repeated, left["doc_id"] == repeated["_id"], "left_anti").unionByName(once)


@_owns_tables
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark passages."""
    found = decontamination.contamination(docs, read(spark, sf_dir, "benchmark"))
    hit = decontamination.words_hit(F.col("hits"))
    return without(docs, found.filter(decontamination.is_contaminated(hit, F.col("n_words"))))


@_owns_tables
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and the text they decode to."""
    model = public_tokenizers.path(PIECE_MODEL)
    key = pieces.document_key(F.col("doc_id").cast("bigint"), DROPOUT_SEED)
    coded = docs.select("doc_id", "lang", "source", pieces.coder(model, DROPOUT_RATE)("text", key).alias("coded"))
    return coded.select(
        "doc_id", "lang", "source", F.size("coded.ids").cast("bigint").alias("n_pieces"), "coded.ids", "coded.text"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is stored, and deleted once the next one's is."""
    docs, written = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept, output = stage(spark, docs, sf_dir), Scope(spark)
        with output.open():
            docs = stored(kept, name.replace(" ", "-"))
        if written is not None:
            written.free()
        written = output
    return STAGES[-1][1](spark, docs, sf_dir)
