"""Registered queries of this package and the SQL each must agree with, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blobtide.llm import centroids, decontamination, line_dedup, mixing, near_duplicates, personal_data, pieces, quality, quality_rules, secrets, spans, spelling, token_counts, toxicity
from blobtide.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontamination.words_hit(F.col("hits")).alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", decontamination.is_contaminated(F.col("n_hit"), F.col("n_words")))


QUERIES["op8_decontamination"] = op8_decontamination

_WORDS8 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL["op8_decontamination"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS8} AS w FROM documents),
b AS (SELECT item_id, {_WORDS8} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, CASE WHEN len(w) < 13 THEN w ELSE w[s:s + 12] END AS win
       FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS k FROM iw),
dw AS (SELECT doc_id, s, k, w[s:s + k - 1] AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT doc_id, s, k, item_id FROM dw JOIN iw ON dw.win = iw.win),
pos AS (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT doc_id, s, k FROM hit)),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"), k=2, percent=80).drop("text_hash")


QUERIES["op9_near_duplicates"] = op9_near_duplicates
ORACLE_SQL["op9_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
sets AS (SELECT s, list_sort(s) AS t, doc_id FROM s),
g AS (SELECT t, min(doc_id) AS node, len(any_value(s)) AS n FROM sets WHERE len(t) > 0 GROUP BY t),
x AS (SELECT node, n, unnest(t) AS sh FROM g),
rare AS (SELECT sh, count(*) AS df FROM x GROUP BY sh HAVING count(*) > 1),
p AS (SELECT x.*, row_number() OVER (PARTITION BY node ORDER BY coalesce(df, 1), sh) AS r FROM x LEFT JOIN rare USING (sh)),
c AS (SELECT DISTINCT a.node AS u, b.node AS v FROM (SELECT * FROM p WHERE 100 * (r - 1) <= 20 * n) a
      JOIN (SELECT * FROM p WHERE 100 * (r - 1) <= 20 * n) b ON a.sh = b.sh AND a.node > b.node AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
e AS (SELECT u, v FROM c JOIN g a ON a.node = u JOIN g b ON b.node = v
      WHERE 100 * len(list_intersect(a.t, b.t)) >= 80 * (a.n + b.n - len(list_intersect(a.t, b.t)))),
both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach(node, top) AS (SELECT node, node FROM g UNION SELECT both_ways.v, reach.top FROM reach JOIN both_ways ON both_ways.u = reach.node WHERE reach.top < both_ways.v),
comp AS (SELECT node, min(top) AS component_id FROM reach GROUP BY node)
SELECT sets.doc_id, len(sets.t)::BIGINT AS n_shingles, coalesce(component_id, sets.doc_id) AS component_id,
       coalesce(component_id, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN g ON sets.t = g.t LEFT JOIN comp USING (node)
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES["op5_toxicity"] = op5_toxicity


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES["op7_quality"] = op7_quality


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES["op3_token_counts"] = op3_token_counts


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.select(
        "doc_id",
        *[spans.count("spans", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        spans.base_digest("spans").alias("base_sha256"),
        spans.listed(F.col("spans")).alias("spans"),
    )


QUERIES["op1_secrets"] = op1_secrets


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_data(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[spans.count("spans", kind).alias(f"n_{kind}") for kind in personal_data.KINDS],
        spans.base_digest("spans").alias("base_sha256"),
        spans.listed(F.col("spans")).alias("spans"),
    )


QUERIES["op4_personal_data"] = op4_personal_data


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.decode(pieces.encode(read(spark, sf_dir, "documents"), model, seed=17, rate=0.1), model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


QUERIES["op6_pieces"] = op6_pieces


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


QUERIES["op10_quality_rules"] = op10_quality_rules


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), report="lines")
    return cleaned.select(
        "doc_id", "lines.n_lines", "lines.n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


QUERIES["op2_line_dedup"] = op2_line_dedup
_LINES = r"""
lines AS (SELECT doc_id, pos, line, list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM {docs} WHERE text IS NOT NULL)),
tokens AS (SELECT doc_id, pos, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS t FROM lines WHERE len(w) > 0),
lead AS (SELECT t, len(t) AS n, min({{'d': doc_id, 'p': pos}}) AS first FROM tokens GROUP BY t),
flat AS (SELECT first, n, unnest(t) AS tok FROM lead),
near AS (SELECT DISTINCT x.first AS first FROM flat x JOIN flat y ON x.tok = y.tok AND y.first < x.first AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n
         GROUP BY x.first, x.n, y.first, y.n HAVING 5 * count(*) >= 4 * (x.n + y.n - count(*))),
gone AS (SELECT doc_id, pos FROM tokens JOIN lead USING (t) WHERE first.d <> doc_id OR first.p <> pos
         UNION SELECT first.d, first.p FROM near),
cleaned AS (SELECT doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed,
              coalesce(string_agg(CASE WHEN gone.pos IS NULL THEN line END, chr(10) ORDER BY pos), '') AS text
            FROM lines LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id)
"""
ORACLE_SQL["op2_line_dedup"] = f"""
WITH {_LINES.format(docs='documents')}
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(c.text, '')) AS text_sha256
FROM documents d LEFT JOIN cleaned c USING (doc_id)
"""


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector of `embeddings` with its cluster after three rounds of 16 centroids (see `centroids`)."""
    return centroids.centroid_clusters(read(spark, sf_dir, "embeddings"), k=16, rounds=3, seed="1")


QUERIES["op11_centroids"] = op11_centroids

# What each of the rounds does: nearest centroid per vector, then the floor of each component's mean.
_ASSIGN = """a{i} AS (SELECT id, any_value(v) AS v, min({{'d': d, 'k': k}}) AS near
  FROM (SELECT id, v, k, list_sum(list_transform(range(1, 65), lambda j: (v[j] - c[j]) * (v[j] - c[j])))::BIGINT AS d FROM kept, c{i}) GROUP BY id)"""
_MOVE = """s{i} AS (SELECT near.k AS k, j, sum(v[j])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, range(1, 65) r(j) GROUP BY near.k, j),
m{i} AS (SELECT k, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY j) AS c FROM s{i} GROUP BY k),
c{next} AS (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))"""
_ROUNDS = ",\n".join(f"{_ASSIGN.format(i=i)},\n{_MOVE.format(i=i, next=i + 1)}" for i in range(3)) + ",\n" + _ASSIGN.format(i=3)
ORACLE_SQL["op11_centroids"] = f"""
WITH kept AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c
  FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, v FROM kept ORDER BY h, v LIMIT 16)),
{_ROUNDS}
SELECT vec_id, near.k::INTEGER AS cluster, near.d AS distance, sum(near.d) OVER (PARTITION BY near.k)::BIGINT AS cluster_inertia,
       sum(near.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN kept USING (id) JOIN c3 ON c3.k = near.k
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the vocabulary of `documents` with the form and root it is a variant of (see `spelling`)."""
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


QUERIES["op12_spelling"] = op12_spelling
ORACLE_SQL["op12_spelling"] = """
WITH RECURSIVE t AS (
  SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{6,}')) AS run FROM documents WHERE text IS NOT NULL),
named AS (SELECT doc_id, run, count(*) AS times, hex(encode(doc_id || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, times, xor(list_reduce(list_transform(range(0, len(x), 2), lambda i: ('0x' || x[i + 1:i + 2])::BIGINT),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM named, t),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, times FROM hashed),
v AS (SELECT word, sum(times)::BIGINT AS n FROM cut WHERE len(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
gaps AS (SELECT word, p, word[1:p] || word[p + 2:] AS gap FROM v, LATERAL (SELECT unnest(range(len(word))) AS p)),
near AS (SELECT x.word AS word, y.word AS other FROM gaps x JOIN gaps y ON x.gap = y.gap AND x.p = y.p AND x.word <> y.word AND len(x.word) = len(y.word)
         UNION SELECT gaps.word, gap FROM gaps JOIN v y ON y.word = gap UNION SELECT gap, gaps.word FROM gaps JOIN v y ON y.word = gap),
best AS (SELECT near.word, count(*) AS n_near, max(o.n) AS most, arg_min(other, {'n': -o.n, 'w': other}) AS other
         FROM near JOIN v o ON o.word = near.other GROUP BY near.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 5 * v.n THEN other END AS form,
             CASE WHEN most >= 5 * v.n THEN most END::BIGINT AS form_n FROM v LEFT JOIN best USING (word)),
walk(word, top) AS (SELECT word, form FROM f WHERE form IS NOT NULL UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.top WHERE f.form IS NOT NULL),
root AS (SELECT walk.word, any_value(walk.top) AS root FROM walk JOIN f ON f.word = walk.top WHERE f.form IS NULL GROUP BY walk.word)
SELECT f.word, f.form, coalesce(root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN root USING (word)
"""


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words the mix of sources takes of it (see `mixing`)."""
    mix = mixing.mixture(read(spark, sf_dir, "documents"), weights=(3, 1, 2), epochs=2, share=(3, 2), seed=13)
    taken = F.col("whole") * F.col("size") + F.col("part")
    return mix.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


QUERIES["op13_mixing"] = op13_mixing
ORACLE_SQL["op13_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || md5('13:' || doc_id::VARCHAR)[1:15])::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][r % 3 + 1] AS weight, 2 * size AS cap, sum(size) OVER () AS words, sum([3, 1, 2][r % 3 + 1]) OVER () AS weights FROM s),
x AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS caps, coalesce(sum(weight) OVER before, 0) AS gone FROM w
      WINDOW before AS (ORDER BY cap * 6 // weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, 2 * cap * (weights - gone) <= weight * (3 * words - 2 * caps) AS capped FROM x),
l AS (SELECT (3 * any_value(words)::DOUBLE / 2 - coalesce(sum(cap) FILTER (capped), 0)::DOUBLE) / (any_value(weights) - coalesce(sum(weight) FILTER (capped), 0))::DOUBLE AS level FROM y),
z AS (SELECT source, size::BIGINT AS source_size, CASE WHEN capped THEN cap::DOUBLE ELSE level * weight::DOUBLE END AS target,
             least(floor(target + 0.5)::BIGINT, cap::BIGINT) AS aim FROM y, l),
o AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id) - size AS before FROM d)
SELECT doc_id, size, source_size, target,
       (aim // greatest(source_size, 1) * size + greatest(0, least(size, aim - aim // greatest(source_size, 1) * source_size - before)))::BIGINT AS taken
FROM o JOIN z ON z.source IS NOT DISTINCT FROM o.source
"""
