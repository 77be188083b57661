"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Sources share a budget of words by weight. A source takes at most `epochs` times its own words, and
what it cannot take is shared by weight among the others until no source is above its cap. In order of
cap / weight the sources that stop at their cap are the first ones, so the water level follows from
running sums of caps and weights in that order; no source list passes through the driver, which only
sees one row of totals.

Within a source every document is taken `target div size of the source` whole times. What is left
of the target is taken from the documents in a seeded random order: whole documents until the remainder
is reached, and of the document that crosses it only its first words. So a source's words meet its target
to the word, however long its longest document is. The order is a running sum over all documents, range
partitioned by (source, seeded hash), so a source with a third of all rows is cut into many pieces.

Defined results: a null text has size 0, as has one without words; such documents are taken 0 words. A
null source is a source of its own, after all others. A null id hashes like an empty one. Repeated rows
are documents of their own; equal rows are interchangeable. A source without words has target 0. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobtide.llm.tables import stored
from blobtide.operators.joins import null_safe_join
from blobtide.operators.ordered import cumulative_sum, number_rows

WEIGHTS = (3, 1, 2)
EPOCHS = 2
SHARE = (3, 2)  # the budget as a fraction of all words
SEED = 13

# Separators of words.
_SPACE = r"\x20\x09-\x0D"
_WHOLE_NUMBER = "decimal(38,0)"
_COPIES = 1024


def word_count(text: Column) -> Column:
    """Number of runs of signs that are no separators: separators before a sign, plus a sign at the start."""
    tight = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{_SPACE}]+", "x")
    return F.char_length(F.regexp_replace(tight, f"[{_SPACE}]+", "")).cast("bigint")


def seeded_order(doc_id: Column, seed: int) -> Column:
    """60 bits of a digest of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def sizes(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, source, size, its place in the seeded order, and a hash of the text to break ties."""
    doc_id = F.col(f"`{id_col}`").cast("bigint")
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(
        doc_id.alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(text).alias("size"),
        seeded_order(doc_id, seed).alias("place"),
        F.xxhash64(text).alias("text_hash"),
    )


def water_fill(
    sources: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, share: tuple[int, int] = SHARE
) -> DataFrame:
    """Per source (source, source_size): its weight, cap and target.

    Weights repeat over the sources by code point, null last. The budget must not exceed `epochs` times all words.
    """
    above, below = share
    if not 0 <= above <= epochs * below or min(weights) <= 0:
        raise ValueError("weights must be positive and the budget within the caps")
    ranked = number_rows(sources.select("source", "source_size", F.col("source").isNull().alias("_last")), ["_last", "source", "source_size"])
    weight = F.get(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.col("_row") % len(weights)).cast("int"))
    capped = stored(
        ranked.select("source", "source_size", "_row", weight.alias("weight"), (F.col("source_size") * epochs).alias("cap")), "sources"
    )
    # cap / weight as a fraction with one denominator for all weights
    common = 1
    for w in set(weights):
        common *= w
    ratio = F.col("cap").cast(_WHOLE_NUMBER) * F.call_function("div", F.lit(common), F.col("weight"))
    running = cumulative_sum(capped.withColumn("_ratio", ratio), ["_ratio", "_row", "source", "source_size"], {"cap": "_caps", "weight": "_weights"}, stored=True)
    total = capped.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    words, all_weights = total["size"] or 0, total["weight"] or 0
    exact = {c: F.col(c).cast(_WHOLE_NUMBER) for c in ("cap", "weight", "_caps", "_weights")}
    # full at its share of what the sources before it leave: cap * weights left <= weight * budget left
    left = F.lit(above * words).cast(_WHOLE_NUMBER) - (exact["_caps"] - exact["cap"]) * below
    weights_left = F.lit(all_weights).cast(_WHOLE_NUMBER) - (exact["_weights"] - exact["weight"])
    filled = stored(
        running.withColumn("capped", exact["cap"] * weights_left * below <= exact["weight"] * left).drop("_caps", "_weights", "_ratio", "_row"),
        "filled",
    )
    full = filled.where("capped").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
    rest = all_weights - (full["weight"] or 0)
    level = (above * words / below - (full["cap"] or 0)) / rest if rest else 0.0
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.lit(float(level)) * F.col("weight"))
    return filled.withColumn("target", target)


def mixture(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    epochs: int = EPOCHS,
    share: tuple[int, int] = SHARE,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per document: doc_id, source, text_hash, size, source_size, target, whole repetitions, words of a last partial one."""
    sized = stored(sizes(docs, seed, id_col, text_col, source_col), "sizes")
    by_source = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    starts = cumulative_sum(by_source, ["source"], {"source_size": "_through"}, stored=True).select(
        "source", (F.col("_through") - F.col("source_size")).alias("_start")
    )
    targets = stored(
        null_safe_join(water_fill(by_source, weights, epochs, share), starts, ["source"]).select("source", "source_size", "target", "_start"),
        "targets",
    )
    running = cumulative_sum(sized, ["source", "place", "doc_id", "text_hash", "size"], {"size": "_upto"}, stored=True)
    aim = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * epochs)
    placed = null_safe_join(running, targets, ["source"]).select(
        "doc_id", "source", "text_hash", "size", "source_size", "target",
        aim.alias("_aim"),
        (F.col("_upto") - F.col("size") - F.col("_start")).alias("_before"),
    )
    times = F.call_function("div", F.col("_aim"), F.greatest("source_size", F.lit(1)))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_aim") - times * F.col("source_size") - F.col("_before")))
    once_more = (extra == F.col("size")) & (F.col("size") > 0)
    return placed.select(
        "doc_id", "source", "text_hash", "size", "source_size", "target",
        F.when(F.col("size") > 0, times + once_more.cast("bigint")).otherwise(F.lit(0)).cast("bigint").alias("whole"),
        F.when(once_more, F.lit(0)).otherwise(extra).cast("bigint").alias("part"),
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, with everything before it."""
    # cut before each separator that follows a word: every piece is separators and one word
    cut = F.split(text, f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
    return F.array_join(F.slice(cut, 1, n.cast("int")), "")


def mixed_texts(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row (doc_id, source, text) per repetition; a partial one has the first words of its text.

    `mix` comes from `mixture` of the same documents. Equal rows are counted together; at most one row
    of a source has a partial repetition. Copies are laid out in blocks, so that no array grows with their number.
    """
    keys = ["doc_id", "source", "text_hash"]
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        F.xxhash64(text).alias("text_hash"), text.alias("text"),
    ).dropDuplicates(keys)
    wanted = mix.groupBy(*keys).agg(F.sum("whole").alias("whole"), F.max("part").alias("part")).where("whole > 0 OR part > 0")
    found = null_safe_join(texts, wanted, keys)
    blocks = found.where("whole > 0").withColumn("_block", F.explode(F.expr(f"sequence(0L, (whole - 1) div {_COPIES})")))
    here = F.expr(f"least({_COPIES}L, whole - _block * {_COPIES})")
    whole = blocks.select("doc_id", "source", "text", F.explode(F.sequence(F.lit(1).cast("bigint"), here)).alias("_copy")).drop("_copy")
    partial = found.where("part > 0").select("doc_id", "source", first_words(F.col("text"), F.col("part")).alias("text"))
    return whole.unionByName(partial)
