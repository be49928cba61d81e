"""The order of tokens changes the comparisons of the n-gram join, never its links."""

import numpy as np
import pytest

from rekindle.llm import similar


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    texts = []
    for n in range(40):
        words = rng.integers(0, 300, 60).astype(str)
        texts += [" ".join(words)]
        for edits in (1, 2, 3):
            copy = words.copy()
            copy[rng.integers(0, 60, edits)] = "new"
            texts += ["the same first words of all " + " ".join(copy)] if edits == 3 else [" ".join(copy)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def brute(rows, words=4):
    sets = {r.doc_id: set(zip(*[r.text.split()[i:] for i in range(words)])) for r in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("order", ["sampled", "none", "random"])
def test_any_order_gives_the_same_links(spark, docs, monkeypatch, order):
    whole = similar.frequent_tokens

    def other(df, measure):
        if order == "sampled":
            return whole(df, measure, sample_rows=10, least=1)
        if order == "none":
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        tokens, n = whole(df, measure, least=1)
        return tokens, np.random.default_rng(5).permutation(n) + np.random.default_rng(6).integers(0, 50, len(n))

    monkeypatch.setattr(similar, "frequent_tokens", other)
    got = {r["doc_id"]: r["component_id"] for r in similar.link(docs).collect()}
    want = brute(docs.collect())
    assert got == want
    assert len(set(want.values())) < len(want)
