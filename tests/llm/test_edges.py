"""Empty tables, clashing column names, null and repeated rows, very long texts; brute-force segmentation."""

import random
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blobtide import scratch
from blobtide.llm import line_dedup, personal_data, pieces, quality, secrets, token_counts, toxicity

VOCABULARY = "byte_bpe_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"
# names that the operators use inside
SCHEMA = "doc_id bigint, text string, spans string, slots string, label int, doc string, copy string, line int, o string, h int, n int, token string, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * 2, 1, "x", "x", 1, "x", 1, 1, "x", 0.5) for i, t in rows], SCHEMA)


def operators(spark):
    """name -> (function of documents, columns of its result that tell a document's outcome)"""
    tokens, words, model = (public_tokenizers.path(v) for v in VOCABULARY)
    no_labels = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    return {
        "secrets": lambda d: secrets.secrets(d, tokens),
        "token_counts": lambda d: token_counts.token_counts(d, words),
        "personal_data": personal_data.personal_data,
        "toxicity": lambda d: toxicity.toxicity(d, no_labels),
        "quality": lambda d: quality.quality(d, no_labels),
        "pieces": lambda d: pieces.decode(pieces.encode(d, model, seed=1, rate=0.1), model).select("doc_id", "ids", "decoded"),
        "line_dedup": lambda d: line_dedup.dedup_lines(d, report="lines").select("doc_id", "text", "lines"),
    }


@pytest.mark.parametrize("name", ["secrets", "token_counts", "personal_data", "toxicity", "quality", "pieces", "line_dedup"])
def test_empty_tables_clashing_names_null_and_repeated_rows(spark, name):
    run = operators(spark)[name]
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, None), (None, "null id 10.0.0.1"), (1, "twice a@b.co"), (1, "twice a@b.co"), (2, ""), (3, "one\ntwo\none")]
    out = run(table(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in rows)
    twice = [str(r) for r in out if r["doc_id"] == 1]
    assert twice[0] == twice[1]


def test_addresses_with_thousands_of_zeros(spark):
    text = "0" * 5000 + ".1.1.1 and " + "9" * 5000 + ".1.1.1"
    row = personal_data.personal_data(table(spark, [(1, text)])).first()
    assert [(s["kind"], s["start"], s["end"]) for s in row["spans"]] == [("ip", 0, 5006)]


def test_segmentation_is_the_best_of_all():
    r = np.random.default_rng(5)
    for text in ("1.2", "+1 (74", "a@b 12 3", "7 8 9", "x9y@", ""):
        lattice = personal_data.Lattice.of(text)
        weights = r.normal(size=(len(personal_data.KINDS), personal_data.FEATURES))
        scores = lattice.scores(weights) - 0.3
        best = 0.0
        for used in product([False, True], repeat=len(lattice.segments)):
            chosen = [s for s, u in enumerate(used) if u]
            spans = sorted(lattice.segments[s] for s in chosen)
            if all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)):
                best = max(best, sum(scores[s].max() for s in chosen))
        for block in (1, 2, 4096):
            got = personal_data.best_segmentation(text, weights, 0.3, block)
            place = {c: t for t, c in enumerate(lattice.places)}
            value = sum(scores[lattice.segments.index((place[a], place[b]))][k] for a, b, k in got)
            assert value == pytest.approx(best)
            assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_blocks_of_a_long_stretch_give_one_segmentation():
    r = random.Random(2)
    text = " ".join(str(r.randrange(10**6)) for _ in range(1500))
    weights = np.random.default_rng(1).normal(size=(len(personal_data.KINDS), personal_data.FEATURES))
    whole = personal_data.best_segmentation(text, weights, 0.5, 10**9)
    assert whole and personal_data.best_segmentation(text, weights, 0.5, 64) == whole


def test_bitmaps_never_differ_in_more_bits_than_sets_in_tokens(spark):
    r = random.Random(6)
    rows = []
    for _ in range(300):
        common = [r.getrandbits(63) for _ in range(r.randint(1, 60))]
        a, b = ({*common, *(r.getrandbits(63) for _ in range(r.randint(0, 30)))} for _ in range(2))
        rows.append((list(a), list(b), len(a ^ b)))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, apart int")
    for shift in (17, 41):
        unlike = F.bit_count(line_dedup._bitmap("a", shift).bitwiseXOR(line_dedup._bitmap("b", shift)))
        assert df.where(unlike > F.col("apart")).count() == 0
        assert df.where(unlike > 5).count() > 100


def test_a_stage_frees_the_tables_of_the_one_before(spark):
    docs = table(spark, [(i, f"line {i}\nthe same line of eight words for everybody") for i in range(40)])
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    first = corpus_pipeline.dedup_lines(spark, docs, "")
    app = spark.sparkContext.applicationId
    own = corpus_pipeline._last_stage[app]
    paths = list(own.paths)
    assert paths and first.count() == 40
    corpus_pipeline.drop_near_duplicates(spark, scratch.materialize(first), "")
    assert own.paths == [] and corpus_pipeline._last_stage[app] is not own
    for path in paths:
        file_system, at = scratch._hadoop_path(spark, path)
        assert not file_system.exists(at)
