"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from blobtide.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n bigint, root string"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "w", 1, "r") for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


def near(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute(rows, least_count, drop=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % drop == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least_count}
    form, others = {}, {}
    for w in counts:
        others[w] = [x for x in counts if near(w, x)]
        best = min(others[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, len(others[w]), counts.get(form[w])) for w, n in counts.items())


def rows_of(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def variants(r, n, letters="abé", least=6, most=9):
    return ["".join(r.choice(letters) for _ in range(r.randint(least, most))) for _ in range(n)]


def changed(r, w):
    at = r.randrange(len(w))
    return r.choice([w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "y" + w[at + 1 :]])


@pytest.mark.parametrize("most", [2, 10, 4096])
def test_equal_to_brute_force(spark, most):
    r = random.Random(most)
    common = variants(r, 12, "abcdeé÷", 6, 14)
    texts = []
    for _ in range(60):
        words = [w.upper() if r.random() < 0.1 else w for w in r.choices(common, range(1, 13), k=40)]
        words += [changed(r, w) for w in r.choices(common, k=6)] + variants(r, 20)
        texts.append(r.choice([" ", "-", "\n", "1"]).join(words))
    texts += [" ".join(["mmmmmmé"] * 75 + ["mmmmmé"] * 15 + ["mxmmmé"] * 3)]
    texts += [None, "", "short", "Ābcdefg", texts[0], texts[0]]
    ids = [*range(len(texts) - 3), None, 7, 7]
    got = spelling.spelling_variants(table(spark, texts, ids), least_count=2, most=most)
    want = brute(list(zip(ids, texts, strict=True)), 2)
    assert rows_of(got) == want
    assert any(w[1] for w in want) and any(w[1] and w[2] != w[1] for w in want)


def test_runs_of_any_length_and_ties(spark):
    long = "ab" * 40_000
    texts = [" ".join([long] * 10 + [long + "c"] * 2 + [long[:-1]] + ["zzzzzz"] * 5 + ["zzzzzy"] * 5 + ["zzzzz"])] * 2
    got = spelling.spelling_variants(table(spark, texts), least_count=1, drop_modulus=None)
    counts = {r["word"]: r for r in got.collect()}
    assert counts[long + "c"]["form"] == long and counts[long[:-1]]["root"] == long
    assert counts["zzzzzy"]["n_near"] == 1 and counts["zzzzzz"]["form"] is None


def test_empty_tables(spark):
    for docs in (spark.createDataFrame([], SCHEMA), table(spark, [None, "", "few words"])):
        assert rows_of(spelling.spelling_variants(docs)) == []


def test_index_over_several_lanes_and_ranges_of_positions(monkeypatch):
    r = random.Random(5)
    words = sorted({"".join(r.choice("ab") for _ in range(n)) for n in (7, 8) for _ in range(400)})
    r.shuffle(words)
    codes = spelling._letters(words, 8)
    short = np.array([len(w) == 7 for w in words])
    bounds = np.array([0, len(words) // 3, len(words) // 3 + 1, len(words)])
    want = {
        (i, j)
        for g in range(3)
        for i in range(bounds[g], bounds[g + 1])
        for j in range(bounds[g], bounds[g + 1])
        if short[i] and near(words[i], words[j])
    }
    for size in (1, 40, 1 << 21):
        monkeypatch.setattr(spelling, "_TABLE_WORDS", size)
        query, other = spelling.near_pairs(codes, short, bounds)
        assert len(query) == len(want) and set(zip(query.tolist(), other.tolist(), strict=True)) == want


def test_groups_stay_whole_over_batches():
    keys = ["a"] * 3 + ["b"] * 7 + ["c"] + ["d"] * 4
    for size in (1, 2, 3, 5, 20):
        cuts = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size])], names=["key"]) for i in range(0, len(keys), size)]
        seen = [t.column("key").to_pylist() for t in spelling._batches(iter(cuts))]
        assert sum(seen, []) == keys
        assert all(not set(x) & set(y) for x, y in zip(seen, seen[1:], strict=False))
