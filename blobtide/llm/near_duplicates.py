"""MinHash near-duplicate groups with sequential Bayesian verification.

1. One pass turns each text into the size of its set of word shingles, a 128-bit hash of the set
   and a MinHash signature. Texts with equal sets collapse to one node before anything is paired.
2. Bands of signature rows propose candidates. Within a bucket each node is first paired only with
   the bucket's smallest node. Buckets that this leaves in several components are searched across
   components in blocks of at most about `BLOCK` nodes: a task compares the signatures and sets of two
   blocks as arrays and emits only links, and a pair is looked at only in the first bucket it shares.
3. A candidate's signatures are compared in batches. After each, a pair whose posterior probability
   of reaching the threshold is below `MISS` is dropped. Survivors are confirmed on the full sets.
4. Confirmed links are joined to connected components.

Only connectivity is needed, so pairs inside a component that is already connected are never
made: a group of thousands of copies costs a star, not a clique.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtide.llm import words as W
from blobtide.llm.components import components
from blobtide.llm.tables import join_on, stored, two_columns

BANDS = 32
ROWS = 5  # a pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^32 = 3e-6
HASHES = BANDS * ROWS
BATCH = 32  # signature entries per verification step
BLOCK = 2_000  # nodes of a bucket that one task holds on either side
# A list of at most so many ids (about 50 MB in memory) is broadcast to pick texts; a longer one is shuffled.
BROADCAST_IDS = 1_000_000
MISS = 1e-6  # posterior probability of a link below which a candidate is dropped

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_FACTORS = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)

_SET = pa.struct(
    [("n_shingles", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("signature", pa.binary())]
)


def shingle_sets(words: W.Words, k: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text; a text of fewer than k words is one shingle."""
    grams = W.grams(words.hashes, k)
    for low, high in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if high - low >= k:
            yield np.unique(grams[low : high - k + 1])
        elif high > low:
            yield W.mix(W.grams(words.hashes[low:high], int(high - low)))
        else:
            yield grams[:0]


def _signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512]
        hashed = ((part[:, None] * _FACTORS + _SHIFTS) >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, hashed.min(axis=0), out=least)
    return least


def _summary(k: int):
    @F.arrow_udf("struct<n_shingles:bigint,high:bigint,low:bigint,signature:binary>")
    def summary(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes, high, low, signatures = [], [], [], []
            for data, offsets in W.slices(batch):
                for shingles in shingle_sets(W.words_of(data, offsets, W.NOT_SPACE, W.LOWER), k):
                    sizes.append(len(shingles))
                    high.append(W.mix(shingles).sum(dtype=np.uint64).astype(np.int64))
                    low.append(W.mix(shingles + np.uint64(0x51ED270B)).sum(dtype=np.uint64).astype(np.int64))
                    signatures.append(_signature(shingles).tobytes() if len(shingles) else None)
            yield pa.StructArray.from_arrays(
                [
                    pa.array(sizes, pa.int64()),
                    pa.array(high, pa.int64()),
                    pa.array(low, pa.int64()),
                    pa.array(signatures, pa.binary()),
                ],
                names=[f.name for f in _SET],
            )

    return summary


def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """After each batch, the fewest matching entries with which a pair may still be a link.

    With a uniform prior the similarity after m of n matches is Beta(m + 1, n - m + 1), whose upper
    tail at t is the chance of at most m successes in n + 1 trials of probability t.
    """
    t = percent / 100
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss or m == n:
                break
            m += 1
        out.append(m)
    return out


def _plausible(percent: int):
    least = least_matches(percent)

    @F.arrow_udf("boolean")
    def plausible(a: pa.Array, b: pa.Array) -> pa.Array:
        if len(a) == 0:
            return pa.array([], pa.bool_())
        left, right = (
            np.frombuffer(b"".join(x.to_pylist()), np.uint32).reshape(len(x), HASHES) for x in (a, b)
        )
        alive = np.arange(len(a))
        matches = np.zeros(len(a), np.int64)
        for step, needed in enumerate(least):
            part = slice(step * BATCH, (step + 1) * BATCH)
            matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
            alive = alive[matches[alive] >= needed]
        kept = np.zeros(len(a), bool)
        kept[alive] = True
        return pa.array(kept)

    return plausible


def _alike(k: int, percent: int):
    """Exact check of two texts on their full shingle sets."""

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        def sets(column: pa.Array) -> list[np.ndarray]:
            column = column.cast(pa.large_string()).dictionary_encode()
            distinct = [
                s
                for data, offsets in W.slices(column.dictionary)
                for s in shingle_sets(W.words_of(data, offsets, W.NOT_SPACE, W.LOWER), k)
            ]
            return [distinct[i] for i in column.indices.to_pylist()]

        out = []
        for x, y in zip(sets(a), sets(b), strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(bool(both and 100 * both >= percent * (len(x) + len(y) - both)))
        return pa.array(out, pa.bool_())

    return alike


class _Search:
    """Candidate pairs to confirmed links, for one table of documents."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, k: int, percent: int):
        self.docs, self.nodes, self.k, self.percent = docs, nodes, k, percent

    def _texts(self, ids: DataFrame) -> DataFrame:
        """(doc_id, text) of the ids in the one column of `ids`."""
        ids = ids.distinct()
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        return self.docs.join(ids, "doc_id", "left_semi")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Links (u, v) among candidate pairs (u, v)."""
        marked = self.nodes.select(F.col("node").alias("u"), F.col("signature").alias("su"))
        other = self.nodes.select(F.col("node").alias("v"), F.col("signature").alias("sv"))
        likely = stored(
            pairs.distinct()
            .join(marked, "u")
            .join(other, "v")
            .filter(_plausible(self.percent)("su", "sv"))
            .select("u", "v"),
            "likely",
        )
        texts = self._texts(likely.select(F.col("u").alias("doc_id")).union(likely.select("v")))
        return stored(
            likely.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu")), "u")
            .join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv")), "v")
            .filter(_alike(self.k, self.percent)("tu", "tv"))
            .select("u", "v")
            .distinct(),
            "confirmed",
        )

    def links(self) -> DataFrame:
        """Links that connect all documents connected by links."""
        band = F.array(
            *[F.xxhash64(F.lit(i), F.substring("signature", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)]
        )
        rows = self.nodes.select("node", F.posexplode(band).alias("band", "bucket"))
        shared = (
            rows.groupBy("bucket")
            .agg(F.min("node").alias("first"), F.max("node").alias("last"))
            .filter(F.col("first") != F.col("last"))
            .select("bucket", "first")
        )
        members = stored(rows.join(shared, "bucket"), "bucket-members")
        found = self.confirmed(
            members.filter(F.col("node") != F.col("first")).select(F.col("node").alias("u"), F.col("first").alias("v"))
        )
        split = self._split(members, found)
        if split.isEmpty():
            return found
        return found.unionByName(self.confirmed(self._across(split)))

    def _split(self, members: DataFrame, links: DataFrame) -> DataFrame:
        """Members of buckets that lie in several components, with their components and the bucket's size."""
        named = join_on(members, components(links), ["node"]).withColumn("component", F.coalesce("component", "node"))
        open_buckets = (
            named.groupBy("bucket")
            .agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n"))
            .filter(F.col("least") != F.col("most"))
            .select("bucket", "n")
        )
        return stored(
            named.join(open_buckets, "bucket").select("bucket", "band", "node", "component", "n"), "open-buckets"
        )

    def _across(self, split: DataFrame) -> DataFrame:
        """Candidates (u, v) between components of one bucket, by blocks."""
        texts = self._texts(split.select(F.col("node").alias("doc_id")))
        sets = texts.select(F.col("doc_id").alias("node"), _short_set(self.k)("text").alias("shingles"))
        held = sets.join(self.nodes.select("node", "signature"), "node")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        own = F.pmod(F.hash("node"), blocks)
        dealt = split.select("bucket", "band", "node", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        return (
            dealt.select("bucket", "band", "node", "component", "own",
                         F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
            .join(held, "node")
            .groupBy("bucket", "p", "q")
            .applyInArrow(_compare_blocks(self.percent), "u bigint, v bigint")
        )


def _short_set(k: int):
    """Column function: text to the sorted distinct 32-bit shingle hashes, as bytes."""

    @F.arrow_udf("binary")
    def short(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [
                np.unique((shingles >> np.uint64(32)).astype(np.uint32)).tobytes()
                for data, offsets in W.slices(batch)
                for shingles in shingle_sets(W.words_of(data, offsets, W.NOT_SPACE, W.LOWER), k)
            ]
            yield pa.array(out, pa.binary())

    return short


def _compare_blocks(percent: int):
    least = least_matches(percent)

    def compare(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        component = table.column("component").to_numpy()
        own = table.column("own").to_numpy()
        band, p, q = (table.column(c)[0].as_py() for c in ("band", "p", "q"))
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(node), HASHES)
        sets = [np.frombuffer(x, np.uint32) for x in table.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets])
        rows = signature.reshape(len(node), BANDS, ROWS)
        left = np.flatnonzero(own == p)
        right = left if p == q else np.flatnonzero(own == q)
        us, vs = [], []
        for at in range(0, len(left), 64):
            part = left[at : at + 64]
            open_ = component[part, None] != component[None, right]
            open_ &= 100 * np.minimum(size[part, None], size[None, right]) + 300 >= percent * np.maximum(size[part, None], size[None, right])
            if p == q:
                open_ &= part[:, None] < right[None, :]
            i, j = np.nonzero(open_)
            i, j = part[i], right[j]
            for b in range(band):  # a pair is looked at in the first bucket it shares
                fresh = (rows[i, b] != rows[j, b]).any(axis=1)
                i, j = i[fresh], j[fresh]
            matches = np.zeros(len(i), np.int64)
            for step, needed in enumerate(least):
                batch = slice(step * BATCH, (step + 1) * BATCH)
                matches = matches + (signature[i, batch] == signature[j, batch]).sum(axis=1)
                alive = matches >= needed
                i, j, matches = i[alive], j[alive], matches[alive]
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                a, b = sets[x], sets[y]
                found = np.searchsorted(a, b)
                found[found == len(a)] = 0
                both = int((a[found] == b).sum())
                # two to spare for equal short hashes; the texts are compared afterwards
                if 100 * (both + 2) >= percent * (len(a) + len(b) - both - 2):
                    us.append(max(node[x], node[y]))
                    vs.append(min(node[x], node[y]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return compare


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, kept.

    Two documents are linked if the Jaccard similarity of their sets of k-word shingles is at least
    `percent` / 100 (checked exactly, on the full sets). component_id is the smallest id reachable over
    links; kept marks the document whose id it is.

    Defined cases: a null, empty or wordless text has an empty set and is linked with nothing; a
    text of fewer than k words is one shingle; rows that repeat an id are one node, linked to all
    that any of them is linked to; a row with a null id takes part in no link but has the component
    of documents with the same set, and is kept if there are none; an empty table gives no rows;
    other columns are not looked at.
    """
    docs = two_columns(docs, id_col, text_col)
    sets = stored(
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _summary(k)("text").alias("s")).select(
            "doc_id", "text_hash", "s.*"
        ),
        "shingle-sets",
    )
    same_set = ["high", "low", "n_shingles"]
    groups = (
        sets.filter(F.col("n_shingles") > 0).groupBy(*same_set).agg(F.min("doc_id").alias("node"))
    )
    nodes = stored(
        sets.filter(F.col("doc_id").isNotNull())
        .withColumn("node", F.col("doc_id"))
        .join(groups, [*same_set, "node"])
        .select("node", *same_set, "signature")
        .dropDuplicates(["node", *same_set]),
        "nodes",
    )
    # A document that is not its set's node hangs on it; an id with several texts hangs on each.
    found = components(
        _Search(docs, nodes, k, percent)
        .links()
        .unionByName(_repeated_ids(sets, groups, same_set))
    )
    named = join_on(groups.filter(F.col("node").isNotNull()), found, ["node"]).select(
        *same_set, F.coalesce("component", "node").alias("component")
    )
    return join_on(sets.select("doc_id", "text_hash", *same_set), named, same_set).select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.col("component").isNull()).alias("kept"),
    )


def _repeated_ids(sets: DataFrame, groups: DataFrame, same_set: list[str]) -> DataFrame:
    """Links between the nodes of the several texts of one id."""
    several = (
        sets.filter(F.col("n_shingles") > 0)
        .groupBy("doc_id")
        .agg(F.min("high").alias("a"), F.max("high").alias("b"))
        .filter(F.col("a") != F.col("b"))
        .select("doc_id")
    )
    return (
        sets.join(several, "doc_id")
        .join(groups, same_set)
        .select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
        .filter(F.col("u") != F.col("v"))
    )
