"""Mixing against the plain procedure: clamp, share the excess again, until no source is above its cap."""

import random
import re
from collections import defaultdict
from fractions import Fraction
from hashlib import md5

import pytest

from blobtide.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size bigint, target string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, "x") for i, t, s in rows], SCHEMA).repartition(3)


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(3, 1, 2), epochs=2, share=Fraction(3, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full = set()
    while True:
        rest = [s for s in order if s not in full]
        left = share * sum(sizes.values()) - sum(epochs * sizes[s] for s in full)
        level = Fraction(left, sum(weight[s] for s in rest)) if rest else Fraction(0)
        more = {s for s in rest if level * weight[s] > epochs * sizes[s]}
        if not more:
            return {s: Fraction(epochs * sizes[s]) if s in full else level * weight[s] for s in order}
        full |= more


def corpus(r, sources, n):
    rows = []
    for i in range(n):
        words = r.choice([0, 1, 5, 40, 400]) if r.random() < 0.95 else 4000
        text = r.choice(["", " ", "\n"]) + r.choice([" ", "\t\n"]).join(["wé"] * words)
        rows.append((i, text, r.choice(sources)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken_words(spark, seed):
    r = random.Random(seed)
    names = ["a", "B", "é", "", "zz", None, "😀"][: 3 + seed]
    # one source holds most rows, and one has no words at all
    rows = corpus(r, [names[0]] * 8 + names, 300) + [(900, None, "empty"), (901, "", "empty")]
    rows += [(5, "same text here", names[1])] * 5 + [(None, "no id", names[0])]
    out = [x.asDict() for x in mixing.mixture(table(spark, rows)).collect()]
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += n_words(t)
    want, taken = targets(sizes), defaultdict(int)
    for x in out:
        assert x["source_size"] == sizes[x["source"]]
        assert x["target"] == pytest.approx(float(want[x["source"]]), abs=1e-6)
        assert 0 <= x["part"] < max(x["size"], 1)
        mine = x["whole"] * x["size"] + x["part"]
        assert mine <= 2 * x["size"]
        taken[x["source"]] += mine
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= Fraction(1, 2)
    again = [x.asDict() for x in mixing.mixture(table(spark, rows).repartition(7)).collect()]
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_order_is_the_seeded_one(spark):
    rows = [(i, "one two three", "a") for i in range(50)] + [(100 + i, "word " * 30, "b") for i in range(50)]
    out = {x["doc_id"]: x for x in mixing.mixture(table(spark, rows), weights=(1,)).collect()}
    assert out[0]["target"] == 300  # twice its words; the rest goes to b
    place = sorted(range(100, 150), key=lambda i: (int(md5(f"13:{i}".encode()).hexdigest()[:15], 16), i))
    whole = [out[i]["whole"] for i in place]
    assert whole == sorted(whole, reverse=True) and set(whole) <= {1, 2}
    assert sum(out[i]["part"] > 0 for i in place) <= 1
    other = {x["doc_id"]: x["whole"] for x in mixing.mixture(table(spark, rows), weights=(1,), seed=14).collect()}
    assert any(other[i] != out[i]["whole"] for i in place)


def test_texts_of_the_mix(spark):
    rows = [(1, "a b\nc  d e", "x"), (2, " f g", "y"), (2, " f g", "y"), (3, None, "y"), (None, "h i j k l m n o p", None)]
    docs = table(spark, rows)
    mix = mixing.mixture(docs)
    texts = mixing.mixed_texts(docs, mix).collect()
    assert sum(n_words(t["text"]) for t in texts) == sum(x["whole"] * x["size"] + x["part"] for x in mix.collect())
    full = {t for _, t, _ in rows}
    assert all(t["text"] in full or any((f or "").startswith(t["text"]) for f in full) for t in texts)


def test_empty_tables_and_bad_parameters(spark):
    for rows in ([], [(1, None, None), (2, " ", "a")]):
        docs = table(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
        out = mixing.mixture(docs).collect()
        assert len(out) == len(rows) and all(x["target"] == 0 and x["whole"] == 0 and x["part"] == 0 for x in out)
    with pytest.raises(ValueError, match="budget"):
        mixing.mixture(docs, share=(5, 2))


def test_runs_without_python(spark, monkeypatch):
    plans = []
    stored = mixing.stored

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, label)

    monkeypatch.setattr(mixing, "stored", noted)
    out = mixing.mixture(table(spark, [(1, "a b", "x"), (2, "c", "y")]))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4
    assert not any(re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", p) for p in plans)


def test_word_count_is_that_of_the_pattern(spark):
    texts = ["", " ", "a", " a", "a ", "a b", "\ta\n\nb\x0b\x0c\rc ", "x y z w", "é😀 \x1c", None, "w " * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(mixing.word_count(df["text"])).collect()] == [n_words(t) for t in texts]
