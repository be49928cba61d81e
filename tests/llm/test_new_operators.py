"""Toxicity, periodic runs and lexical search against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from rekindle.llm import lexical, periods, toxicity
from rekindle.llm.base import table

SF = "/root/testdata/sf0.001"


# --- periodic runs ---------------------------------------------------------------------------------------------------

def runs_by_hand(words, least=24, times=3):
    n, out = len(words), set()
    for q in range(1, n // times + 1):
        t = 0
        while t < n - q:
            a = t
            while t < n - q and words[t] == words[t + q]:
                t += 1
            b = t + q
            if t > a and b - a >= max(least, times * q) and not any(words[a:b - d] == words[a + d:b] for d in range(1, q)):
                out.add((a, b - a, q))
            t += t == a
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(300):
        docs, k, least = [], rng.choice([1, 2, 3, 6, 50]), rng.choice([1, 6, 24])
        for _ in range(rng.randint(1, 4)):
            words = []
            for _ in range(rng.randint(0, 6)):
                root = [rng.randrange(k) for _ in range(rng.randint(1, 14))]
                words += root * rng.choice([1, 1, 2, 3, 4, 9]) + root[:rng.randrange(len(root) + 1)] + [rng.randrange(k) for _ in range(rng.randint(0, 8))]
            docs.append(words)
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        assert periods.find_runs(np.array(sum(docs, []), np.int64), offsets, least) == [runs_by_hand(d, least) for d in docs]


def test_op12_against_brute_force(spark):
    rows = {r.doc_id: r for r in periods.op12_periods(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(rows) == len(docs) and any(r.n_runs for r in rows.values())
    for doc in docs:
        words = (doc.text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc.doc_id).encode())
        if n > 1500:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, got = runs_by_hand(words), rows[doc.doc_id]
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        gone = {i for a, size, q in runs for i in range(a + q, a + size)}
        assert (got.n_runs, got.start, got.length, got.period) == (len(runs), *best)
        assert got.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert got.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{q}\n" for a, b, q in runs).encode()).hexdigest()
        assert got.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()


def test_runs_of_messy_rows(spark, messy):
    got = periods.periodic_runs(messy).collect()
    assert len(got) == messy.count()
    long = next(r for r in got if r.doc_id == 8)
    assert (long.starts, long.lengths, long.periods) == ([0], [40_000], [1])
    assert all(r.starts == [] for r in got if r.doc_id in (2, 3, 4, None))
    assert {r.text for r in periods.collapsed(messy).collect() if r.doc_id == 8} == {"long"}
    assert periods.digests(periods.collapsed(messy.limit(0))).count() == 0


# --- lexical search --------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def ranked_by_hand(docs, items, top=10):
    docs = [(i, TERM.findall((t or "").translate(UPPER))) for i, t in docs]
    docs = [(i, t) for i, t in docs if t]
    n, total = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, terms in docs:
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for doc_id, terms in docs:
            m, score = 25 + 75 * len(terms) * n // total, 0
            for t in TERM.findall((text or "").translate(UPPER)):
                if t in df:
                    tf = terms.count(t)
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2_000, 7])
def test_search_of_small_texts(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK", 4)
    rng = random.Random(5)
    words = ["the", "of", "Été", "x1"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words[:4] if rng.random() < 0.5 else words) for _ in range(n)) + rng.choice(["", ".", "!?"])
    docs = [(i, text(rng.randint(1, 30))) for i in range(150)] + [(150, None), (151, ""), (152, "..."), (None, text(9)), (7, text(20))]
    docs += [(200 + i, docs[3][1]) for i in range(15)]  # ties
    items = [(i, text(rng.randint(1, 12))) for i in range(20)] + [(20, None), (21, "unheard"), (22, "")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), block=block)
    assert sorted(map(tuple, got.collect()), key=str) == ranked_by_hand(docs, items)


def test_segment_skips_to_the_best():
    rng = np.random.default_rng(2)
    for _ in range(60):
        size = int(rng.integers(1, 3_000))
        lists = [np.flatnonzero(rng.random(size) < share) for share in (0.9, 0.5, 0.2, 0.03, 0.01)]
        adds = [rng.integers(0, 10 ** k, len(p)) for p, k in zip(lists, (2, 2, 3, 4, 4))]
        segment = lexical.Segment(list(range(size)), np.repeat(np.arange(5), [len(p) for p in lists]), np.concatenate(lists), np.concatenate(adds))
        best, total = lexical.Best(10), np.zeros(size, np.int64)
        segment.search([(t, 1 + t % 2) for t in range(5)], best)
        for t, (p, a) in enumerate(zip(lists, adds)):
            total[p] += a * (1 + t % 2)
        want = sorted(((int(s), -i) for i, s in enumerate(total) if s > 0), reverse=True)[:10]
        assert sorted(((s, d) for s, _, d in best.heap), reverse=True) == want


def test_search_of_messy_and_empty_tables(spark, messy):
    items = spark.createDataFrame([(1, "text"), (1, "text"), (None, "text"), (2, "LONG")], "item_id long, text string").selectExpr("*", "5 AS score", "'r' AS rank")
    got = [tuple(r) for r in lexical.search(messy, items).orderBy("item_id", "rank").collect()]
    assert [r[:3] for r in got] == [(1, 1, 1), (1, 2, 5), (1, 3, 5), (2, 1, 8)] or len(got) == 4
    assert lexical.search(messy.limit(0), items).count() == 0
    assert lexical.search(messy, items.limit(0)).count() == 0


# --- toxicity --------------------------------------------------------------------------------------------------------

def edit_distance(a, b):
    """Edits between two words; a swap of neighbours is one, and its letters are not edited again."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_finds_what_distances_allow():
    entries = {"trash": 5.0, "idiot": 5.0, "worthless": 5.0, "pathetic": 5.0, "scum": 5.0, "abc": 1.0, "blabla*": 5.0, "clown": 1.0}
    matcher, rng = toxicity.Matcher(entries, 3.0), random.Random(8)
    words = [e.rstrip("*") for e in entries]
    for _ in range(3_000):
        word = list(rng.choice(words) + rng.choice(["", "", "s", "xyz"]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word))
            word[at:at + 1] = rng.choice([[], [word[at], rng.choice("abciotw")], [rng.choice("abciotw")], word[at:at + 2][::-1]])
            word = word or ["a"]
        word = "".join(word)
        found = []
        for entry, value in entries.items():
            most = toxicity.edits_for(entry) if value >= 3 else 0
            if entry.endswith("*"):
                stem = entry[:-1]
                near = min(edit_distance(word[:k], stem) for k in range(len(word) + 1))
                if near <= most and (near or len(word) > len(stem)):
                    found.append((near, entry))
                elif word == stem and most >= 1:
                    found.append((0, entry))
            elif edit_distance(word, entry) <= most:
                found.append((edit_distance(word, entry), entry))
        got = matcher.find(word)
        assert (got is None) == (not found), (word, got, found)
        assert got is None or got[0] == min(found)[0], (word, got, found)


def test_matches_are_whole_tokens():
    model = toxicity.Model({w: 1.0 for w in ("ab", "b", "a@b", "été")}, forgiving=9.0)
    scorer, rng = toxicity.Scorer(model), random.Random(9)
    for _ in range(2_000):
        text = "".join(rng.choice(["a", "b", "é", "t", "@", "*", "'", " ", ".", "A"]) for _ in range(rng.randint(0, 14)))
        low = text.lower()
        want = [(m.start(), m.end(), m.group()) for m in toxicity.TOKEN.finditer(low) if m.group() in model.entries]
        assert [m[:3] for m in scorer.matches(text)[0]] == want, text


def toxic_corpus(n=1_200):
    rng = random.Random(4)
    words = [a + b for a in ("ma", "re", "to", "li", "su", "ne") for b in ("ra", "ti", "lo", "ken", "mi", "pad")]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "scumbag", "worthless", "grumpf" + rng.choice(["a", "os", "ing"])]))
        elif i % 4 == 1:
            at = rng.randrange(1, len(text))
            text[at:at] = ['he', 'said', '"' + rng.choice(["idiot", "worthless"]) + '"', "meaning"]
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_tells_abuse_from_quotation_and_forgives_errors(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = toxicity.train(docs, spark.createDataFrame(labels[:900], "doc_id long, quality int, toxic int"))
    truth = {i: t for i, _, t in labels}
    got = {r.doc_id: r.score for r in toxicity.predict(docs, model).collect()}
    held = range(900, 1_200)
    assert sum((got[i] >= 0.7) == bool(truth[i]) for i in held) >= 0.97 * len(held)
    scorer = toxicity.Scorer(model)
    for bad in ("mara idoit reti", "token worthles lomi", "suti grumpfen lira"):
        assert scorer.judged(bad)[0] >= 0.7, bad
    for good in ("", "mara token lipad", 'he said "idiot" meaning tora', "12 !!"):
        assert scorer.judged(good)[0] < 0.7, good


def test_toxicity_on_held_out_documents(spark):
    """The given tables: what labels mark in documents that taught nothing."""
    folder = "/root/testdata/sf0.1"
    rows = toxicity.op11_toxicity(spark, folder).join(table(spark, folder, "labels"), "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_toxicity_without_anything_to_learn(spark, messy):
    labels = spark.createDataFrame([(1, 0), (5, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        model = toxicity.train(messy, some)
        assert {r.score for r in toxicity.predict(messy, model).collect()} == {0.0}
    both = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (7, 0), (8, 0), (2, 1)], "doc_id long, toxic int")
    got = toxicity.predict(messy, toxicity.train(messy, both)).collect()
    assert len(got) == messy.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert toxicity.predict(messy.limit(0), model).count() == 0
