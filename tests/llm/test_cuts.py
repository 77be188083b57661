"""Lines and words are cut up once, and by expressions that copy no array for every word."""

import random
import re

from pyspark.sql import functions as F

from blobtide.llm import line_dedup, quality_rules


def shingles(line):
    w = re.findall(r"[^\x20\x09-\x0D]+", line.lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def test_lines_are_cut_once(spark, monkeypatch):
    calls = []
    lines = line_dedup._lines
    monkeypatch.setattr(line_dedup, "_lines", lambda docs: calls.append(1) or lines(docs))
    docs = spark.createDataFrame([(i, f"one two three four five six seven {i % 2}\nx") for i in range(6)], "doc_id bigint, text string")
    assert line_dedup.dedup_lines(docs).filter("text = ''").count() == 4
    assert calls == [1]  # none for counts over the whole corpus


def test_tokens_are_equal_where_shingles_are(spark):
    r = random.Random(8)
    texts = ["", " ", "\t\r", "a", " a", "a\x0b", "A", "a b", "b a", "\ta  b ", "a b c", "a b c d", "a b c d e", "É b c d e f", "é B\tc d e f"]
    texts += ["".join(r.choice(["a", "b", "c", " ", " ", "\t", "\r"]) for _ in range(r.randint(1, 24))) for _ in range(300)]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc bigint, copy bigint, text string")
    got = {x["doc"]: x["tokens"] for x in line_dedup._lines(docs).collect()}
    assert set(got) == {i for i, t in enumerate(texts) if shingles(t)}
    names = {}
    for i, tokens in got.items():
        want = shingles(texts[i])
        assert len(tokens) == len(want), texts[i]
        assert all(names.setdefault(s, t) == t for s, t in zip(want, tokens, strict=True))
    assert len(set(names.values())) == len(names)


def test_one_shared_token_makes_no_candidate(spark, monkeypatch):
    counts = {}
    stored = line_dedup.stored

    def noted(df, label):
        out = stored(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "stored", noted)
    docs = [(i, f"one two three four five x{i} y{i} z{i}") for i in range(60)]  # four tokens, the first of all lines
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted(map(tuple, out.collect())) == docs
    assert counts["shared-tokens"] == 1 and counts["shared-rows"] == counts["line-sets"] == 0


def test_two_shared_tokens_make_no_candidate(spark, monkeypatch):
    counts = {}
    stored = line_dedup.stored

    def noted(df, label):
        out = stored(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "stored", noted)
    docs = [(i, f"one two three four five six x{i} y{i} z{i}") for i in range(200)]  # five tokens, the first two of all lines
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted(map(tuple, out.collect())) == docs
    assert counts["shared-tokens"] == 2 and counts["shared-rows"] == counts["line-sets"] == 0


def test_small_sets_at_the_limit_lose_no_pair(spark):
    # n tokens and one word more: n of n + 1 tokens are common, which is 0.8 from four on
    lines = [" ".join(f"{n}{c}" for c in "abcdefghijklm"[: n + 4 + more]) for n in range(1, 8) for more in (0, 1)]
    out = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string"))
    gone = {i for i, text in out.collect() if text == ""}
    assert gone == {2 * (n - 1) + 1 for n in range(4, 8)}


def test_lines_are_taken_by_place(spark, monkeypatch):
    plans = {}
    stored = line_dedup.stored

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, label)

    monkeypatch.setattr(line_dedup, "stored", noted)
    texts = ["a\nb  c\n\td\n\ne f", "a", "", "x y\nz\n"]
    docs = spark.createDataFrame([(i, 7, t) for i, t in [*enumerate(texts), (None, "g\nh")]], "doc bigint, copy bigint, text string")
    rows = line_dedup._raw_lines(docs).collect()
    some = [r for r in rows if r["line"] % 2 or r["doc"] in (None, 2)]
    wanted = spark.createDataFrame([tuple(r)[:3] for r in [*some, some[0]]], "doc bigint, copy bigint, line int")
    got = line_dedup._some_lines(docs, wanted).collect()
    assert sorted(map(str, got)) == sorted(map(str, some))
    line_dedup.dedup_lines(spark.createDataFrame([(1, "a b c d e f g h\nz"), (2, "a b c d e f g h i")], "doc_id bigint, text string"))
    assert "explode(_places" in plans["line-sets"] and "posexplode" not in plans["line-sets"]
    below = plans["line-sets"].split("explode(_places", 1)
    assert "split(" not in below[0].replace("split(lower", "") and "split(" in below[1]  # once a text, not once a line


def test_keys_sort_by_level_then_hash(spark):
    r = random.Random(4)
    levels = [r.randrange(128) for _ in range(line_dedup.BUCKETS)]
    tokens = [r.getrandbits(64) - (1 << 63) for _ in range(300)] + [0, -1, 65535, 65536]
    df = spark.createDataFrame([(tokens + tokens[:9],)], "tokens array<bigint>")
    want = sorted({levels[t % line_dedup.BUCKETS] << 56 | (t % (1 << 64)) >> 8 for t in tokens})
    assert df.select(line_dedup._ordered(levels).alias("keys")).first()["keys"] == want


def test_marks_of_equal_lines_do_not_shuffle_prefixes(spark, monkeypatch):
    plans = {}
    stored = line_dedup.stored

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, label)

    monkeypatch.setattr(line_dedup, "stored", noted)
    line_dedup.dedup_lines(spark.createDataFrame([(1, "a b c d e f g h\nz"), (2, "a b c d e f g h")], "doc_id bigint, text string"))
    assert {"equal-sets", "first-lines"} <= set(plans)
    assert not any("prefix" in plans[label] for label in ("equal-sets", "first-lines"))


def test_equal_lines_of_one_document_and_of_null_ids(spark):
    line = "a b c d e f g h i"
    rows = [(None, f"{line}\nq"), (None, f"r\n{line}"), (7, f"s\n{line}\n{line}"), (9, line), (3, "t")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(None, "q"), (None, "r"), (7, f"s\n{line}"), (9, ""), (3, "t")], key=str)


def test_features_have_no_filter_per_bin_and_no_slice_per_window(spark):
    text = "The end of der Anfang " * 40 + "des"
    docs = spark.createDataFrame([(1, text, "en"), (2, None, None), (3, "the", "en")], "doc_id bigint, text string, lang string")
    measured = quality_rules.features(docs)
    plan = measured._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(common" not in plan and not re.search(r"lambdafunction\(xxhash64\(slice", plan)
    rows = {x["doc_id"]: x for x in measured.collect()}
    for i, t in ((1, text), (2, ""), (3, "the")):
        words = t.lower().split()
        counts = [words.count(w) for w in quality_rules.COMMON_WORDS]
        want = [n / len(words) if words else 0.0 for n in [*counts, len(words) - sum(counts)]]
        assert rows[i]["common_words"] == want and len(rows[i]["signs"]) == len(quality_rules._CLASSES) + 1
    assert rows[1]["n_repeat_words"] == 200 and rows[1]["n_words"] == 201
    assert measured.select(F.size("common_words").alias("n")).distinct().count() == 1
