"""Quality rules by distribution divergence, in DataFrame functions only.

Each text gets two histograms: of its signs by class, and of the most common words of its language (with one
bin for all others). The reference of a language is the mean share per bin over all documents of
that language, whole corpus. A text is rejected if the Jensen-Shannon distance of either histogram
from its language's reference exceeds a limit, which is looser for short texts: a guard keeps texts of few
words out of each test, since their histograms are mostly chance. Two rules about length and repetition come first.

Texts are scanned once; the features are stored, and references and verdicts are made from them. A
language has one reference row, joined on the language, so documents are never paired with each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobtide.llm.tables import join_on, stored

# A text of n words is rejected beyond FLOOR + SLOPE / sqrt(n): chance moves the histograms of short texts.
SIGN_FLOOR, SIGN_SLOPE = 0.11, 1.45
WORD_FLOOR, WORD_SLOPE = 0.03, 3.4
LEAST_WORDS_FOR_SIGNS = 20
LEAST_WORDS_FOR_WORDS = 100
LEAST_DOCUMENTS = 20  # a language with fewer documents is compared with the reference of all
WINDOW = 8

# Separators of words, and classes of signs as bodies of character sets.
_SPACE = r"\x20\x09-\x0D"
_CLASSES = {
    "lower": r"\p{Ll}\p{Lo}\p{Lm}",
    "upper": r"\p{Lu}\p{Lt}",
    "digit": r"\p{N}",
    "stop": r".,;:!?",
    "quote": r"'\"()\-",
    "symbol": r"#*$%&|<>",
}
# Common words of four languages, each once, so that the bins and the rest add up to all words.
COMMON_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "on", "for", "was", "be", "with", "as", "at", "this", "by",
    "der", "die", "und", "das", "den", "von", "zu", "ist", "im", "mit", "sich", "des", "auf", "für", "nicht", "ein", "eine",
    "de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es",
    "le", "les", "et", "est", "du", "une", "qui", "dans", "pas", "pour", "par", "sur", "au", "avec",
]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{_SPACE}]+"), lambda w: w != "")


def _n_matches(text: Column, inside: str) -> Column:
    """How many signs belong to a class: what is left of the text without all others."""
    return F.char_length(F.regexp_replace(text, f"[^{inside}]+", ""))


def _repeat_words(words: str, n_words: str) -> Column:
    """Words inside 8-word windows that occur twice or more. `words` holds hashes of words."""
    starts = F.sequence(F.lit(1), (F.col(n_words) - (WINDOW - 1)).cast("int"))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(WINDOW)]))
    return F.when(F.col(n_words) >= WINDOW, windows)


def _covered(windows: str) -> Column:
    """Words covered by repeated windows: positions of equal hashes side by side, then runs of at most 8."""
    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("h"), i.alias("i"))))
    # zip each with its neighbours; a hash equal to either neighbour's repeats
    n = F.size(placed)
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(placed, 1, F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice(placed, 2, n), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    joined = F.arrays_zip(placed.alias("w"), before.alias("b"), after.alias("a"))
    repeated = F.sort_array(
        F.transform(
            F.filter(joined, lambda x: (x["w"]["h"] == x["b"]["h"]) | (x["w"]["h"] == x["a"]["h"])),
            lambda x: x["w"]["i"],
        )
    )
    return F.aggregate(
        repeated,
        F.struct(F.lit(0).alias("until"), F.lit(0).cast("bigint").alias("total")),
        lambda seen, i: F.struct(
            (i + WINDOW).alias("until"),
            (seen["total"] + (i + WINDOW - F.greatest(seen["until"], i))).alias("total"),
        ),
        lambda seen: seen["total"],
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Per document: doc_id, lang, the base counts, and both histograms as arrays of shares."""
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col else F.lit(None).cast("string")
    texts = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        lang.alias("lang"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{_SPACE}]")))
    split = texts.select("doc_id", "lang", "text", _words(F.col("text")).alias("words"), lines.alias("lines")).select(
        "doc_id",
        "lang",
        "text",
        "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    counted = split.select(
        "doc_id", "lang", "n_words", "word_chars", "n_dup_lines",
        *[_n_matches(F.col("text"), body).alias(f"c_{name}") for name, body in _CLASSES.items()],
        F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(COMMON_WORDS)).alias("common"),
        _repeat_words("hashes", "n_words").alias("windows"),
    )
    repeats = (
        F.when(F.col("windows").isNull() | (F.size(F.array_distinct("windows")) == F.size("windows")), F.lit(0).cast("bigint"))
        .otherwise(_covered("windows"))
    )
    classes = [F.col(f"c_{name}") for name in _CLASSES]
    rest = F.col("word_chars") - reduce(lambda a, b: a + b, classes)
    # an expression per bin, so that bins and shares run as compiled code, which filter and transform do not
    bins = [F.size("common") - F.size(F.array_remove("common", w)) for w in COMMON_WORDS]
    shares = lambda counts, total: F.array(
        *[F.when(total > 0, c.cast("double") / total).otherwise(F.lit(0.0)) for c in counts]
    )
    return counted.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        F.col("c_symbol").cast("bigint").alias("n_symbols"),
        "n_dup_lines",
        repeats.alias("n_repeat_words"),
        shares([*classes, rest], F.col("word_chars")).alias("signs"),
        shares([*bins, F.col("n_words").cast("int") - F.size("common")], F.col("n_words")).alias("common_words"),
    )


def references(measured: DataFrame) -> DataFrame:
    """Mean histogram per language (null: over all documents) of the documents long enough to have one."""
    n_signs, n_common = len(_CLASSES) + 1, len(COMMON_WORDS) + 1
    means = [F.avg(F.col("signs")[i]).alias(f"s{i}") for i in range(n_signs)]
    means += [F.avg(F.col("common_words")[i]).alias(f"w{i}") for i in range(n_common)]
    usable = measured.filter(F.col("n_words") >= LEAST_WORDS_FOR_SIGNS)
    by_lang = (
        usable.filter(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n"), *means)
        .filter(F.col("n") >= LEAST_DOCUMENTS)
    )
    of_all = usable.agg(F.count("*").alias("n"), *means).withColumn("lang", F.lit(None).cast("string"))
    return by_lang.unionByName(of_all).select(
        "lang",
        F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(n_signs)]).alias("ref_signs"),
        F.array(*[F.coalesce(f"w{i}", F.lit(0.0)) for i in range(n_common)]).alias("ref_words"),
    )


def divergence(p: str, q: str) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares."""

    def part(x, m):
        return F.when((x > 0) & (m > 0), x * F.log2(x / m)).otherwise(0.0)

    total = F.aggregate(
        F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2)),
        F.lit(0.0),
        lambda a, b: a + b,
    )
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang"
) -> DataFrame:
    """One row per document: doc_id, base counts, sign_distance, word_distance, base_failed, kept.

    Defined cases: a null, empty or wordless text has zero counts and fails the length rule; a null, unknown or
    rare language is compared with the reference over all documents; null ids and repeated rows are judged like any
    others; an empty table gives no rows; other columns are not looked at.
    """
    measured = stored(features(docs, id_col, text_col, lang_col), "quality-features")
    refs = stored(references(measured), "quality-references")
    named = measured.join(
        refs.filter(F.col("lang").isNotNull()).select(F.col("lang").alias("ref_lang")), F.col("lang") == F.col("ref_lang"), "left"
    )
    judged = join_on(named, refs.withColumnRenamed("lang", "ref_lang"), ["ref_lang"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        divergence("signs", "ref_signs").alias("sign_distance"),
        divergence("common_words", "ref_words").alias("word_distance"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )
    chance = F.sqrt(F.greatest("n_words", F.lit(1)).cast("double"))
    far = (
        (F.col("n_words") >= LEAST_WORDS_FOR_SIGNS) & (F.col("sign_distance") > SIGN_FLOOR + SIGN_SLOPE / chance)
    ) | ((F.col("n_words") >= LEAST_WORDS_FOR_WORDS) & (F.col("word_distance") > WORD_FLOOR + WORD_SLOPE / chance))
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
