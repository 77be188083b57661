"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct five-word shingles (a shorter line is one token). A line is removed if its
Jaccard similarity with an earlier line of the corpus is at least 0.8, where lines are ordered by document id
and then by place; the earlier line counts whether or not it is itself removed.

1. Every line is cut into tokens once. Lines with equal sets collapse to the earliest one; the others are removed.
2. Prefix filter: in any total order of tokens that is the same everywhere, two sets of similarity 0.8 have the first k
   of their common tokens among the first n - ceil(0.8 n) + k of each, for k up to ceil(0.8 n). In the order of the hashes
   and with k = `COMMON` it tells the candidate lines: those with k tokens there that other lines have there too. Only
   their full token sets are made, and stored; the lines are taken out of their texts by place. The pairs are then told with k = 1.
3. Token counts over the candidate lines, in `BUCKETS` buckets, give each token a rarity level. The table of levels is
   one number a bucket, so what tasks receive never grows. The candidate lines are joined on their prefixes in the
   order of level and hash, rare tokens first; length and position filters thin out the pairs.
4. Bitmap filter: a line carries a bitmap with the parity per bit of its tokens that hash to the bit. Two sets
   differ in at least as many tokens as their bitmaps in bits, so a pair with too unlike bitmaps is dropped inside the join.
5. A line is first compared with the earliest line of each of its tokens. Only lines that this does not remove
   are compared with the other lines before them, so a large group of near copies costs one star.
6. Candidate pairs are verified on their full token sets.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobtide.llm.tables import join_on, stored
from blobtide.scratch import settled

SHINGLE = 5
COMMON = 3  # at most 4, since the smallest set that has partners other than equal ones has four tokens
BUCKETS = 1 << 16
# A list of at most so many hashes (16 MB in memory) is broadcast; a longer one is shuffled.
BROADCAST_ROWS = 1_000_000

_SPACES = r"[\x20\t\x0B\f\r]+"  # the line feed separates too, but no line has it
_DOC = ["doc", "copy"]  # a document: its id and a hash of its text


def _parts() -> Column:
    """The lines of a text, in order.

    Words have one space between them, so that a plain cut finds them. Few texts must be changed for that.
    """
    uneven = reduce(or_, [F.contains("text", F.lit(c)) for c in ("  ", "\t", "\x0b", "\f", "\r")])
    even = F.when(uneven, F.regexp_replace("text", _SPACES, " ")).otherwise(F.col("text"))
    return F.split(even, "\n")


def _raw_lines(docs: DataFrame) -> DataFrame:
    """(doc, copy, line, _line): place and text of every line; `docs` has doc, copy and text."""
    return docs.select(*_DOC, F.posexplode(_parts()).alias("line", "_line"))


def _some_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """`_raw_lines` of some lines only, taken by place, so that the others get no row; a stray line more does no harm."""
    grouped = lines.groupBy(F.xxhash64(*_DOC).alias("_key")).agg(F.collect_set("line").alias("_places"))
    places = stored(grouped, "line-documents")
    # a row has many places, so the lines are what is counted
    few = F.broadcast(places) if lines.count() <= BROADCAST_ROWS else places
    of_docs = docs.withColumn("_key", F.xxhash64(*_DOC)).join(few, "_key")
    cut = of_docs.select(*_DOC, "_places", _parts().alias("_parts"))  # a text is cut before its places become rows
    return cut.select(*_DOC, "_parts", F.explode("_places").alias("line")).select(*_DOC, "line", F.get("_parts", "line").alias("_line"))


def _trimmed(line: str) -> Column:
    """A line without spaces at its ends. Trimming walks over the whole line, and few lines need it."""
    ends = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(ends, F.btrim(line, F.lit(" "))).otherwise(F.col(line))


def _tokenized(raw: DataFrame) -> DataFrame:
    """(doc, copy, line, tokens) of the lines with a word: hashes of their shingles, in order.

    A shingle of five words is the hash of three hashes of neighbours: words 1 and 2, 3 and 4, 4 and 5. Behind the last
    word there is nothing to hash, so the one token of a shorter line comes out the same way. Lines without a word
    are told by their ends: a test of the words would have them split twice.
    """
    words = F.split(F.lower(_trimmed("_line")), " ")
    key = [*_DOC, "line"]
    # neighbours are taken by place: a slice for every word would copy its array
    five = F.transform("_two", lambda x, i: F.xxhash64(x, F.get("_two", i + 2), F.get("_two", i + 3)))
    return (
        raw.filter(_trimmed("_line") != "")
        .select(*key, words.alias("_words"))
        .select(*key, F.transform("_words", lambda x, i: F.xxhash64(x, F.get("_words", i + 1))).alias("_two"))
        .select(*key, F.slice(five, F.lit(1), F.greatest(F.size("_two") - (SHINGLE - 1), F.lit(1))).alias("tokens"))
    )


def _lines(docs: DataFrame) -> DataFrame:
    return _tokenized(_raw_lines(docs))


def _bucket(token: Column) -> Column:
    return token.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _levels(sets: DataFrame) -> list[int]:
    """Rarity level of each bucket: twice the binary logarithm of its count, at most 127."""
    counts = (
        sets.select(F.explode("tokens").alias("token"))
        .groupBy(_bucket(F.col("token")).alias("bucket"))
        .agg(F.count("*").alias("n"))
        .select("bucket", F.least(F.lit(127), (2 * F.log2("n")).cast("int")).alias("level"))
        .collect()
    )
    levels = [0] * BUCKETS
    for row in counts:
        levels[row["bucket"]] = row["level"]
    return levels


def _ordered(levels: list[int]) -> Column:
    """Distinct tokens as keys that sort by rarity level, then hash."""
    # one literal array, made while the plan is optimized; the levels are already where they stand in a key
    table = F.split(F.lit(",".join(str(level << 56) for level in levels)), ",").cast("array<bigint>")

    def key(token):
        return F.get(table, _bucket(token)).bitwiseOR(F.shiftrightunsigned(token, 8))

    return F.sort_array(F.array_distinct(F.transform("tokens", key)))


def _prefix(ordered: str, k: int = 1) -> Column:
    """The first n - ceil(0.8 n) + k of n ordered tokens. Sets of less than four have none but equal partners."""
    n = F.size(ordered)
    return F.slice(ordered, 1, F.when(n >= 4, n - F.floor((4 * n + 4) / 5).cast("int") + k).otherwise(0))


def _least_overlap(n: Column, m: Column) -> Column:
    """Fewest common tokens of sets of n and m tokens with similarity 0.8: ceil(4 (n + m) / 9)."""
    return F.floor((4 * (n + m) + 8) / 9)


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _bitmap(tokens: str, shift: int) -> Column:
    """Parity of the tokens per bit; the bit of a token is six of its hash's bits."""
    return F.aggregate(
        tokens,
        F.lit(0).cast("bigint"),
        lambda bits, t: bits.bitwiseXOR(
            F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(t, shift).bitwiseAND(F.lit(63)).cast("int"))
        ),
    )


def _sets(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, copy, line, tokens, bits): the distinct tokens and bitmap of each of `lines`, stored."""
    sets = _tokenized(_some_lines(docs, lines)).withColumn("tokens", F.array_distinct("tokens"))
    return stored(sets.withColumn("bits", _bitmap("tokens", 41)), "line-sets")


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Later lines (x_doc, x_copy, x_line) of the candidate pairs that reach the similarity."""
    x, y = ([f"{side}_{c}" for c in (*_DOC, "line")] for side in "xy")
    one, two = (sets.select(*[F.col(c).alias(f"{side}_{c}") for c in (*_DOC, "line", "tokens")]) for side in "xy")
    both = F.size(F.array_intersect("x_tokens", "y_tokens"))
    return (
        join_on(join_on(pairs.distinct(), one, x, "inner"), two, y, "inner")
        .filter(5 * both >= 4 * (F.size("x_tokens") + F.size("y_tokens") - both))
        .select(*x)
        .distinct()
    )


def _earlier(a: str, b: str) -> Column:
    """Whether line a comes before line b; a null id comes last."""
    keys = [
        (F.col(f"{a}_doc").isNull().cast("int"), F.col(f"{b}_doc").isNull().cast("int")),
        (F.coalesce(f"{a}_doc", F.lit(0)), F.coalesce(f"{b}_doc", F.lit(0))),
        (F.col(f"{a}_copy"), F.col(f"{b}_copy")),
        (F.col(f"{a}_line"), F.col(f"{b}_line")),
    ]
    out = F.lit(False)
    for p, q in reversed(keys):
        out = (p < q) | ((p == q) & out)
    return out


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("token", *[F.col(c).alias(f"{name}_{c}") for c in (*_DOC, "line", "n", "place", "bits")])


def _candidates(later: DataFrame, before: DataFrame) -> DataFrame:
    """Pairs with a common prefix token that pass the length, position and bitmap filters."""
    n, m, i, j = (F.col(c) for c in ("x_n", "y_n", "x_place", "y_place"))
    most = F.least(i, j) + F.least(n - i, m - j)
    unlike = F.bit_count(F.col("x_bits").bitwiseXOR(F.col("y_bits")))
    return (
        _side(later, "x").join(_side(before, "y"), "token")
        .filter(_earlier("y", "x") & (5 * n >= 4 * m) & (5 * m >= 4 * n) & (most >= _least_overlap(n, m)) & (unlike <= n + m - 2 * _least_overlap(n, m)))
        .select(*[f"{s}_{c}" for s in ("x", "y") for c in (*_DOC, "line")])
    )


def _marked(docs: DataFrame) -> DataFrame:
    """(doc, copy, line, prefix, leads) of the lines with a word; the earliest of equal sets leads."""
    sets = _lines(docs).select(*_DOC, "line", F.sort_array(F.array_distinct("tokens")).alias("keys"))
    lines = stored(
        sets.select(
            *_DOC, "line", F.size("keys").alias("n"), F.xxhash64("keys").alias("set_a"), F.hash("keys").alias("set_b"),
            _prefix("keys", COMMON).alias("prefix"),
        ),
        "lines",
    )
    same = ["set_a", "set_b", "n"]
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "copy", "line")
    # most sets are of one line only: the earliest is looked for among the lines of the others, in their first document
    twice = stored(
        lines.groupBy(*same).agg(F.count("*").alias("many"), F.min(_order()).alias("first_doc")).filter(F.col("many") > 1).drop("many"),
        "equal-sets",
    )
    heads = lines.drop("prefix").join(_few(twice), same).filter(_order() == F.col("first_doc"))
    first = stored(heads.groupBy(*same).agg(F.min(place).alias("first")), "first-lines")
    leads = F.col("first").isNull() | (place == F.col("first"))
    marked = lines.join(_few(first), same, "left").select(*_DOC, "line", "prefix", leads.alias("leads"))
    # a join with a short list is made anew by each reader
    return marked if first.count() <= BROADCAST_ROWS else stored(marked, "marked-lines")


def _order() -> Column:
    """The document's place as a number; a null id comes last."""
    return F.coalesce("doc", F.lit((1 << 63) - 1))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc, copy, line) of the lines that go. `docs` has doc, copy and text, one row per document."""
    key = [*_DOC, "line"]
    marked = _marked(docs)
    prefixes = marked.filter("leads").select(*key, F.posexplode("prefix").alias("place", "token"))
    # most tokens are of one line only: the rows of the others are few, and are told from them once
    shared = stored(prefixes.groupBy("token").agg(F.count("*").alias("many")).filter(F.col("many") > 1).select("token"), "shared-tokens")
    several = prefixes.join(_few(shared), "token", "left_semi").groupBy(*key).agg(F.count("*").alias("many")).filter(F.col("many") >= COMMON)
    sets = _sets(docs, stored(several.select(*key), "shared-rows"))
    ordered = sets.select(*key, "bits", _ordered(_levels(sets)).alias("keys"))
    rare = stored(ordered.select(*key, "bits", F.size("keys").alias("n"), _prefix("keys").alias("rare")), "rare-tokens")
    found = rare.select(*key, "n", "bits", F.posexplode("rare").alias("place", "token")).withColumn("place", F.col("place") + 1)
    common = found.groupBy("token").agg(F.min(_order()).alias("first_doc"), F.count("*").alias("many")).filter(F.col("many") > 1)
    rows = stored(found.join(_few(stored(common.drop("many"), "first-documents")), "token"), "token-rows")
    heads = rows.filter(_order() == F.col("first_doc"))
    head_line = heads.groupBy("token").agg(F.min("line").alias("head"))
    first = _candidates(rows, heads.join(head_line, "token").filter(F.col("line") == F.col("head")))
    gone = stored(_verified(sets, first).select(*[F.col(f"x_{c}").alias(c) for c in key]), "star-removed")
    left = join_on(rows, gone.withColumn("_gone", F.lit(True)), key, "left").filter(F.col("_gone").isNull())
    rest = _verified(sets, _candidates(left, rows)).select(*[F.col(f"x_{c}").alias(c) for c in key])
    return marked.filter(~F.col("leads")).select(*key).unionByName(gone).unionByName(rest)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: str | None = None
) -> DataFrame:
    """`docs` with later matches of earlier lines taken out of the text; all columns stay.

    With `report`, a column of that name holds struct<n_lines, n_removed> (lines, and lines taken out).

    Defined cases: lines without a word are never removed; a null text stays null and has no lines; an empty text
    has one line without a word; a text that loses all its lines becomes empty; rows that repeat id and text are
    one document and get the same result; rows that repeat an id with other texts are ordered by a hash of the text;
    a null id comes after all others; an empty table gives no rows. Columns of any name may be present.
    """
    taken = set(docs.columns)
    doc, copy = (next(n for n in (f"{base}{'_' * k}" for k in range(len(taken) + 1)) if n not in taken) for base in ("_doc", "_copy"))
    keyed = docs.withColumn(doc, F.col(f"`{id_col}`").cast("bigint")).withColumn(copy, F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    plain = keyed.select(F.col(doc).alias("doc"), F.col(copy).alias("copy"), F.col(f"`{text_col}`").cast("string").alias("text")).filter(
        F.col("text").isNotNull()
    )
    gone = settled(
        docs.sparkSession,
        lambda: removed_lines(plain).groupBy(*_DOC).agg(F.collect_set("line").alias("_gone")).withColumnsRenamed({"doc": "_r_doc", "copy": "_r_copy"}),
        "removed-lines",
    )
    total = gone.agg(F.coalesce(F.sum(F.size("_gone")), F.lit(0)).alias("n")).first()["n"]
    gone = F.broadcast(gone) if total <= 4 * BROADCAST_ROWS else gone
    none = F.expr("CAST(array() AS array<int>)")
    joined = keyed.join(gone, F.col(doc).eqNullSafe(F.col("_r_doc")) & F.col(copy).eqNullSafe(F.col("_r_copy")), "left")
    text = F.col(f"`{text_col}`").cast("string")
    parts = F.split(text, "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    new_text = F.when(F.col("_gone").isNull(), text).otherwise(kept)
    summary = F.struct(
        F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("bigint").alias("n_lines"),
        F.size(F.coalesce("_gone", none)).cast("bigint").alias("n_removed"),
    )
    columns = [new_text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, *([summary.alias(report)] if report else []))
