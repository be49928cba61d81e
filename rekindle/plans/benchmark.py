"""Fit, rank and evaluate many algorithms, and tune the best ones."""

from __future__ import annotations

import itertools
import math
import random
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekindle.catalogue import CATALOGUE, incompatibility, primary_metric
from rekindle.operators import evaluate, leaderboard
from rekindle.operators.clean import matrix_stats
from rekindle.operators.split import Split, train_test
from rekindle.operators.topk import target_users
from rekindle.plans.algorithms import fit
from rekindle.session import local_table

RUN_SCHEMA = (
    "experiment_id string, algorithm string, skipped boolean, skip_reason string, failed boolean, error string, "
    "elapsed_s double, scalability double, RMSE double, MAE double, precision_at_k double, "
    "recall_at_k double, ndcg_at_k double, map_at_k double, metric double"
)
TRIAL_SCHEMA = (
    "experiment_id string, algorithm string, trial int, params string, metric_name string, value double, elapsed_s double, "
    "error string"
)
# Search ranges as (low, high, step) for whole numbers, (low, high) for even and
# (low, high, "log") for logarithmic draws, and the number of trials per algorithm.
SPACES = {
    "SVD": {"n_components": (10, 200, 10)},
    "SVD++": {"n_components": (10, 100, 10), "n_epochs": (10, 50, 5), "lr": (1e-4, 0.1, "log"), "reg": (1e-4, 0.5, "log")},
    "NMF": {"n_components": (5, 100, 5), "max_iter": (100, 1000, 100), "l1_ratio": (0.0, 1.0)},
    "ALS": {"n_factors": (10, 200, 10), "n_iterations": (5, 30, 1), "regularization": (1e-4, 1.0, "log"), "alpha": (1.0, 100.0)},
    "BPR": {"n_factors": (10, 200, 10), "n_epochs": (20, 200, 20), "lr": (1e-4, 0.1, "log"), "reg": (1e-5, 0.1, "log")},
    "Ecommerce-Popularity": {"recency_decay": (0.8, 1.0), "min_interactions": (1, 20, 1)},
    "Ecommerce-Purchase-ALS": {"n_factors": (10, 200, 10), "n_iterations": (5, 30, 1), "regularization": (1e-4, 1.0, "log"),
                               "purchase_weight": (2.0, 10.0)},
    "Movie-Item-KNN": {"k_neighbours": (5, 100, 5), "genre_boost": (0.0, 0.5)},
    "Temporal-SVD": {"n_components": (10, 100, 10), "n_time_bins": (3, 20, 1)},
    "LightFM": {"n_components": (16, 96, 16), "content_weight": (0.1, 0.7), "user_feature_weight": (0.05, 0.4),
                "max_features": (500, 3000, 500)},
    "Autoencoder-CF": {"hidden_dim": (16, 128, 16), "alpha": (1e-5, 1e-2, "log"), "max_iter": (75, 200, 25)},
    "Content-Based TF-IDF": {"max_features": (500, 5000, 500), "embedding_dim": (16, 128, 16)},
    "Factorization Machines": {"n_factors": (8, 48, 8), "n_epochs": (10, 30, 5), "learning_rate": (1e-3, 5e-2, "log"),
                               "regularization": (1e-4, 1e-1, "log"), "max_features": (500, 2500, 500)},
}
TRIALS = {"SVD": 20, "SVD++": 20, "NMF": 25, "ALS": 20, "BPR": 15, "Ecommerce-Popularity": 10,
          "Ecommerce-Purchase-ALS": 20, "Movie-Item-KNN": 15, "Temporal-SVD": 20, "LightFM": 20, "Autoencoder-CF": 12,
          "Content-Based TF-IDF": 12, "Factorization Machines": 15}
DEFAULT_TRIALS = 20
AUTO_TRIALS = -1
METRIC_COLUMN = {"RMSE": "RMSE", "NDCG@K": "ndcg_at_k"}


@dataclass
class Benchmark:
    runs: DataFrame
    mode: str
    metric: str
    direction: str

    def leaderboard(self) -> DataFrame:
        done = self.runs.filter("not skipped and not failed")
        return leaderboard.leaderboard(done, self.direction == "maximize")

    def selection(self) -> DataFrame:
        return leaderboard.selection_scores(self.leaderboard(), self.metric, self.direction == "maximize")

    def serving_choice(self, shortlist: int = 10) -> DataFrame:
        return leaderboard.serving_choice(self.selection(), shortlist)


def score_model(name: str, parts: Split, top_k: int, params: dict) -> dict:
    """Metrics of one fitted algorithm as a dict."""
    model = fit(name, parts.train, **params)
    predicted = model.predict(parts.test) if model.predict else None
    ranking = model.lists(target_users(parts.test), top_k)
    return evaluate.evaluate_all(parts.test, predicted, ranking, name, top_k).first().asDict()


def run_benchmark(parts: Split, mode: str, algorithms: list[str] | None = None, top_k: int = 10,
                  params: dict[str, dict] | None = None, both_is_universal: bool = False,
                  experiment_id: str | None = None) -> Benchmark:
    """One row per algorithm; an incompatible one is skipped and an error becomes a failed row."""
    if top_k not in (5, 10):
        raise ValueError("top_k must be 5 or 10")
    spark = parts.train.sparkSession
    experiment_id = experiment_id or uuid.uuid4().hex[:12]
    metric, direction = primary_metric(mode)
    sizes = matrix_stats(parts.train).first()
    rows = []
    for name in algorithms or list(CATALOGUE):
        entry = CATALOGUE[name]
        reason = incompatibility(entry, mode, both_is_universal)
        if reason:
            rows.append((experiment_id, name, True, reason, False, "", 0.0, 0.0) + (None,) * 7)
            continue
        score = leaderboard.scalability_score(
            F.lit(entry.scalability), F.lit(float(sizes["n_users"])), F.lit(float(sizes["n_items"])),
            F.lit(entry.max_users), F.lit(entry.max_items),
        )
        scale = spark.range(1).select(score.alias("s")).first()["s"]
        start = time.time()
        try:
            found, failed, error = score_model(name, parts, top_k, (params or {}).get(name, {})), False, ""
        except Exception as e:  # noqa: BLE001 - a failing algorithm is a result
            found, failed, error = {}, True, str(e)[:500]
        values = tuple(found.get(c) for c in ("RMSE", "MAE", "precision_at_k", "recall_at_k", "ndcg_at_k", "map_at_k"))
        rows.append((experiment_id, name, False, "", failed, error, round(time.time() - start, 2), scale,
                     *values, found.get(METRIC_COLUMN[metric])))
    return Benchmark(local_table(spark, rows, RUN_SCHEMA), mode, metric, direction)


def draw(space: dict, rng: random.Random) -> dict:
    out = {}
    for name, (low, high, *how) in space.items():
        if how and how[0] == "log":
            out[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
        elif how:
            out[name] = rng.randrange(low, high + 1, how[0])
        else:
            out[name] = rng.uniform(low, high)
    return out


def grid(space: dict, points: int = 3) -> list[dict]:
    """Evenly spread combinations: ``points`` values per parameter."""
    def values(low, high, *how):
        if how and how[0] == "log":
            return [low * (high / low) ** (i / (points - 1)) for i in range(points)]
        if how:
            every = list(range(low, high + 1, how[0]))
            return sorted({every[round(i * (len(every) - 1) / (points - 1))] for i in range(points)})
        return [low + (high - low) * i / (points - 1) for i in range(points)]

    names = list(space)
    return [dict(zip(names, combo)) for combo in itertools.product(*[values(*space[n]) for n in names])]


def tune(algorithm: str, train: DataFrame, implicit: bool, n_trials: int = AUTO_TRIALS, top_k: int = 10, seed: int = 42,
         trials: list[dict] | None = None) -> tuple[dict, DataFrame]:
    """Seeded random search on a validation split of ``train``; returns the result and the trial table."""
    spark = train.sparkSession
    metric, direction = primary_metric("implicit" if implicit else "explicit")
    budget = TRIALS.get(algorithm, DEFAULT_TRIALS) if n_trials == AUTO_TRIALS else n_trials
    label = f"auto({budget})" if n_trials == AUTO_TRIALS else f"fixed({budget})"
    result = {"algorithm": algorithm, "best_params": {}, "best_value": None, "metric_name": metric, "n_trials": 0,
              "elapsed_s": 0.0, "status": "ok", "reason": "", "trial_budget": label}
    empty = local_table(spark, [], TRIAL_SCHEMA)
    if algorithm not in CATALOGUE:
        return {**result, "status": "failed", "reason": f"unknown algorithm: {algorithm}"}, empty
    if budget < 0:
        return {**result, "status": "failed", "reason": "n_trials must be -1 (auto) or >= 0"}, empty
    if budget == 0:
        return {**result, "status": "skipped", "reason": "n_trials=0"}, empty
    rng = random.Random(seed)
    space = SPACES.get(algorithm, {})
    planned = trials if trials is not None else [draw(space, rng) for _ in range(budget if space else 1)]
    parts = train_test(train, salt="|validation")
    rows, best, start = [], None, time.time()
    for number, params in enumerate(planned):
        began, value, error = time.time(), None, ""
        try:
            value = score_model(algorithm, parts, top_k, params).get(METRIC_COLUMN[metric])
        except Exception as e:  # noqa: BLE001 - a failing trial is a result
            error = str(e)[:500]
        rows.append(("", algorithm, number, repr(params), metric, value, round(time.time() - began, 2), error))
        better = value is not None and math.isfinite(value) and (
            best is None or (value > best[0] if direction == "maximize" else value < best[0])
        )
        if better:
            best = (value, params)
    result |= {"n_trials": len(rows), "elapsed_s": round(time.time() - start, 1)}
    if best is None:
        result |= {"status": "fallback", "reason": "no trial gave a finite value"}
    else:
        result |= {"best_value": best[0], "best_params": best[1]}
    return result, local_table(spark, rows, TRIAL_SCHEMA)
