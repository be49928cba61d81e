"""Nearest neighbours, Jaccard join, repeat removal and components against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from rekindle.llm import components, nearest, repeats, similar

# -- nearest neighbours ------------------------------------------------------------------------


def test_nearest_with_ties_and_unusable_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.choice([1, 2])) for _ in range(3)]) for i in range(60)]
    rows += [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0, float("nan"), 1.0]), (63, [1.0, 2.0]), (64, [1.0, None, 2.0]), (65, []), (66, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (80, [1.0, 2.0, 2.0]), (80, [1.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS block", "2 AS strip", "'x' AS dim")
    got = nearest.nearest(df.filter("vec_id % 20 = 0"), df, k=5, query_rows=2, block_rows=10).collect()
    good = {i: e for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    want = []
    for q in sorted(good):
        if q % 20 == 0:
            best = sorted((-float(np.dot(good[q], good[c])), c) for c in good if c != q and len(good[c]) == len(good[q]))[:5]
            want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == want
    assert nearest.nearest(df.limit(0), df).count() == 0
    few = nearest.nearest(df.filter("vec_id = 0"), df.filter("vec_id < 4"), k=20).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3]


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 16)) * 10.0 ** rng.integers(-3, 4, (40, 1)), rng.normal(size=(3000, 16))
    y[::7] = y[0]
    query, found, score = nearest.best_of_block(x, np.arange(40), y, np.arange(3000) + 100, 20)
    exact = x @ y.T
    for q in range(40):
        want = sorted(zip(-exact[q], np.arange(3000) + 100))[:20]
        np.testing.assert_allclose(score[query == q], [-w[0] for w in want], rtol=1e-12)
        assert set(found[query == q]) <= {int(i) for i in np.flatnonzero(exact[q] >= -want[-1][0] - 1e-9 * abs(want[-1][0])) + 100}


# -- Jaccard join --------------------------------------------------------------------------------


def linked_by_hand(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets[key] = {tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {k: (len(sets[k]), find(k)) for k in keys}


def near_copies():
    rng, rows = random.Random(5), []
    for _ in range(14):
        words = [rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 9)) for _ in range(rng.choice([3, 5, 30, 60, 150]))]
        for _ in range(10):
            own = list(words)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = rng.choice([*words, "Zz", "q"])
            rows.append((len(rows), " ".join(own[:len(own) * 9 // 10] if rng.random() < 0.3 else own)))
    tail = [None, "", " \n", "one", "ONE", "one two three", "One  two\tthree", "É é", "é é", "a\x1cb c\x85d e"]
    return rows + [(1000 + i, t) for i, t in enumerate(tail)]


def test_components_by_hand(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}
    for a, b in pairs:
        if a is not None and a != b:
            near = [s for s in set(map(frozenset, root.values())) if s & {a, b}]
            new = frozenset({a, b}).union(*near)
            root.update({x: new for x in new})
    assert got == {k: min(s) for k, s in root.items()}


def test_jaccard_links_by_hand(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS token", "2 AS comp", "3 AS cls").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in similar.link(df).collect()} == linked_by_hand(rows)


def test_jaccard_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = linked_by_hand([tuple(r) for r in docs.collect()])
    assert len({c for _, c in want.values()}) < len(want)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in similar.op7_jaccard(spark, "/root/testdata/sf0.01").collect()} == want


def test_jaccard_edges(spark, messy):
    got = similar.link(messy).collect()
    assert len(got) == messy.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].component_id is None and by_id[2].component_id == 2 and by_id[2].n_shingles == 0 and by_id[8].n_shingles == 1
    assert similar.link(messy.limit(0)).count() == 0


def test_parity_bound():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = np.unique(rng.integers(0, 5000, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, len(a)), rng.integers(0, 5000, rng.integers(1, 200)).astype(np.uint64)]))
        assert similar.least_different(similar.parity(a), similar.parity(b)) <= len(np.setxor1d(a, b))
        assert np.bitwise_count(similar.sketch(a).view(np.uint64) ^ similar.sketch(b).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


# -- repeats ---------------------------------------------------------------------------------------


def cut_by_hand(rows, length):
    seen, raws = defaultdict(int), [(k, (t or "").encode()) for k, t in rows]
    for _, raw in raws:
        for s in range(len(raw) - length + 1):
            seen[raw[s:s + length]] += 1
    out = []
    for key, raw in raws:
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if seen[raw[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((key, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def patched_texts(seed):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [letters(rng.randint(20, 200)) for _ in range(10)]
    rows = []
    for k in range(120):
        parts = [rng.choice([letters(rng.randint(0, 60)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 10):], "é" * rng.randint(0, 50), "same line\n" * rng.randint(0, 12)]) for _ in range(rng.randint(0, 6))]
        rows.append((k, "".join(parts)))
    return rows


def check_cut(spark, rows, length, window):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS kind", "3 AS start").repartition(5)
    got = sorted((tuple(r)[:5] for r in repeats.find_repeats(df, length=length, window=window).collect()), key=str)
    assert got == cut_by_hand(rows, length)


@pytest.mark.parametrize("length,window", [(40, 12), (40, 33), (64, 1)])
def test_repeats_by_hand(spark, length, window):
    check_cut(spark, patched_texts(length + window), length, window)


def test_repeats_with_repeated_rows_and_ids(spark):
    rows = patched_texts(9)
    rows += [(k + 1000, t) for k, t in rows[:20]] + [(5, "another text " + rows[3][1]), (None, rows[4][1] + "x"), (7, None), rows[3], rows[3]]
    check_cut(spark, rows, 40, 12)
    assert repeats.find_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeats_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in repeats.op2_repeats(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == cut_by_hand(rows, 400) and any(r[2] for r in got)


def test_runs_in_blocks(monkeypatch):
    text = "".join(random.Random(3).choice("abc ") for _ in range(5000)).encode()
    whole = list(repeats.runs(text, 40, 12))
    monkeypatch.setattr(repeats, "BLOCK", 700)
    parts = list(repeats.runs(text, 40, 12))
    place = lambda found: {s: a for a, lo, hi in found for s in range(lo, hi + 1)}
    assert place(whole) == place(parts) and set(place(whole)) == set(range(len(text) - 39))
