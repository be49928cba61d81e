import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rekindle import session
from rekindle.operators import popularity, topk
from rekindle.operators.numbering import number_rows
from rekindle.operators.pairs import pair_products


@pytest.mark.parametrize("width,rows", [(2048, 500_000), (16, 500_000), (16, 60), (2, 1000)])
def test_pair_products(spark, planted, width, rows):
    df, x, _ = planted
    # one user holds a large part of the rows, one item too
    got = {}
    for r in pair_products(df, "userID", "itemID", "rating", width, rows).named().collect():
        key = tuple(sorted((r["a"], r["b"])))
        assert key not in got
        got[key] = (r["dot"], r["co"])
    gram, co = x.T @ x, (x > 0).astype(float).T @ (x > 0)
    want = {(f"i{a:02d}", f"i{b:02d}"): (gram[a, b], co[a, b]) for a, b in itertools.combinations(range(40), 2) if gram[a, b]}
    assert got == want


def test_factor_top_on_both_paths(spark, planted):
    df = planted[0]
    rng = np.random.default_rng(5)
    p, q = np.round(rng.normal(size=(60, 6)), 1), np.round(rng.normal(size=(40, 6)), 1)
    users = spark.createDataFrame([(f"u{i:02d}", v.tolist()) for i, v in enumerate(p)], "userID string, vec array<double>")
    items = spark.createDataFrame([(f"i{i:02d}", v.tolist()) for i, v in enumerate(q)], "itemID string, vec array<double>")
    scores = np.round(p @ q.T, 10)
    seen = {(r["userID"], r["itemID"]) for r in df.collect()}
    want = set()
    for u in range(60):
        free = sorted((-scores[u, i], f"i{i:02d}") for i in range(40) if (f"u{u:02d}", f"i{i:02d}") not in seen)
        want |= {(f"u{u:02d}", i, r + 1) for r, (_, i) in enumerate(free[:5])}
    for limit in (1 << 20, 700):
        got = topk.factor_top(users, items, df, 5, limit)
        assert {(r["userID"], r["itemID"], r["rank"]) for r in got.collect()} == want


def test_popular_unseen_is_brute_force(spark, planted):
    df = planted[0]
    scores = popularity.item_popularity(df, 0.95, 1)
    order = [r["itemID"] for r in scores.orderBy(F.desc("score"), "itemID").collect()]
    seen = {(r["userID"], r["itemID"]) for r in df.collect()}
    users = df.select("userID").distinct()
    want = {(u, i, r + 1) for u in {p[0] for p in seen}
            for r, i in enumerate([i for i in order if (u, i) not in seen][:7])}
    got = popularity.popular_unseen(scores, df, users, 7)
    assert {(r["userID"], r["itemID"], r["rank"]) for r in got.collect()} == want


def test_numbers_are_consecutive(spark):
    df = number_rows(spark.range(1000).repartition(7).orderBy(F.desc("id")), "n", start=1)
    assert all(r["n"] == 1000 - r["id"] for r in df.collect())


def test_skew_join_equals_join(spark, monkeypatch):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    want = sorted(map(tuple, big.join(small, "k").select("k", "v", "w").collect()))
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    joined = session.skew_join(big, small, "k")
    assert sorted(map(tuple, joined.select("k", "v", "w").collect())) == want
    left = session.skew_join(big, small, "k", "left")
    assert left.count() == 3000 and left.filter("w is null").count() == big.filter("k >= 40").count()
