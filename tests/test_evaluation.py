import math

import numpy as np
import pytest

from rekindle.operators import evaluate


def brute(ranked, relevant, k):
    p, r, n, m = [], [], [], []
    for user, items in ranked.items():
        rel = relevant.get(user)
        if not rel:
            continue
        hit = [i in rel for i in items[:k]]
        p.append(sum(hit) / k)
        r.append(sum(hit) / len(rel))
        ideal = sum(1 / math.log2(x + 2) for x in range(min(len(rel), k)))
        n.append(sum(h / math.log2(x + 2) for x, h in enumerate(hit)) / ideal)
        m.append(sum(sum(hit[: x + 1]) / (x + 1) for x, h in enumerate(hit) if h) / min(len(rel), k))
    return [round(float(np.mean(x)), 4) for x in (p, r, n, m)]


@pytest.mark.parametrize("k", [5, 10])
def test_ranking_metrics(spark, k):
    rng = np.random.default_rng(k)
    users = [f"u{x}" for x in range(20)]
    ranked = {u: [f"i{x}" for x in rng.permutation(30)[: rng.integers(1, 12)]] for u in users[:15]}
    relevant = {u: {f"i{x}" for x in rng.permutation(30)[: rng.integers(1, 15)]} for u in users[5:]}
    lists = spark.createDataFrame([(u, i, float(-x)) for u, xs in ranked.items() for x, i in enumerate(xs)],
                                  "userID string, itemID string, score double")
    test = spark.createDataFrame([(u, i, 1.0) for u, xs in relevant.items() for i in xs], "userID string, itemID string, rating double")
    assert list(evaluate.ranking_quality(test, lists, k).first()) == brute(ranked, relevant, k)


def test_rating_errors(spark):
    test = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 5.0)], "userID string, itemID string, rating double")
    preds = spark.createDataFrame([("a", "x", 2.0), ("b", "x", 3.0), ("c", "x", 3.0), ("a", "y", float("nan"))],
                                  "userID string, itemID string, prediction double")
    assert tuple(evaluate.rating_errors(test, preds).first()) == (round(math.sqrt(2.5), 4), 1.5)
    none = evaluate.rating_errors(test, preds.filter("false")).first()
    assert none["RMSE"] is None and none["MAE"] is None
    row = evaluate.evaluate_all(test, None, None, "X").first()
    assert row["algorithm"] == "X" and row["RMSE"] is None and row["ndcg_at_k"] is None
