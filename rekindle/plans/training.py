"""From a raw table to a saved and promoted model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekindle.operators.clean import k_core, standardise
from rekindle.operators.feedback import feedback_profile, resolve_mode
from rekindle.operators import saved as store
from rekindle.operators.registry import ModelRegistry
from rekindle.operators.roles import column_facts, detect_roles, mapping_warnings
from rekindle.operators.split import Split, train_test
from rekindle.plans.algorithms import fit
from rekindle.plans.benchmark import Benchmark, run_benchmark, tune
from rekindle.session import materialise


@dataclass
class Training:
    mode: str
    split: Split
    benchmark: Benchmark
    model_ids: dict[str, str]
    best: str | None
    tuning: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def prepare(raw: DataFrame, overrides: dict[str, str] | None = None, min_user: int = 3, min_item: int = 3):
    """Roles, feedback profile and the clean, pruned interaction table."""
    facts = column_facts(raw)
    detection = detect_roles(raw, overrides)
    warnings = mapping_warnings(facts, detection.roles)
    if detection.roles.userID is None or detection.roles.itemID is None:
        raise ValueError("; ".join(warnings))
    clean = materialise(standardise(raw, detection.roles))
    has_rating = detection.roles.rating is not None
    profile = feedback_profile(clean if has_rating else clean.drop("rating")).first()
    return k_core(clean, min_user, min_item).df, profile, warnings


def train(raw: DataFrame, registry: ModelRegistry, mode: str = "auto", top_k: int = 10, keep: int = 5,
          algorithms: list[str] | None = None, n_trials: int = 0, overrides: dict[str, str] | None = None,
          params: dict[str, dict] | None = None, min_user: int = 3, min_item: int = 3) -> Training:
    """Benchmark the algorithms, tune and refit the best ones on the training part, save and promote."""
    if keep not in (5, 10):
        raise ValueError("keep must be 5 or 10")
    pruned, profile, warnings = prepare(raw, overrides, min_user, min_item)
    resolved = resolve_mode(profile, mode)
    split = train_test(materialise(pruned))
    bench = run_benchmark(split, resolved, algorithms, top_k, params)
    ranked = bench.leaderboard().orderBy("rank").limit(keep).collect()  # at most 10 rows
    saved, tuning = {}, []
    for row in ranked:
        name = row["algorithm"]
        chosen = dict((params or {}).get(name, {}))
        if n_trials != 0:
            result, _ = tune(name, split.train, resolved == "implicit", n_trials, top_k)
            tuning.append(result)
            chosen |= result["best_params"]
        model = fit(name, split.train, **chosen)
        metrics = {c: row[c] for c in ("RMSE", "MAE", "precision_at_k", "recall_at_k", "ndcg_at_k", "map_at_k")}
        saved[name] = store.save(
            registry, name, model.tables, split.train, metrics=metrics, params=chosen, is_implicit=resolved == "implicit")
    best = ranked[0]["algorithm"] if ranked else None
    if best:
        registry.promote(saved[best])
    return Training(resolved, split, bench, saved, best, tuning, warnings)


def option_rows(training: Training) -> DataFrame:
    """Saved models with their rank and metric, in the order a user chooses from them."""
    board = training.benchmark.leaderboard()
    saved = F.create_map(*[F.lit(x) for pair in training.model_ids.items() for x in pair])
    return board.filter(F.col("algorithm").isin(list(training.model_ids))).select(
        saved[F.col("algorithm")].alias("model_id"), "algorithm", "rank", F.lit(training.benchmark.metric).alias("metric_name"),
        F.col("metric").alias("metric_value"), (F.col("algorithm") == F.lit(training.best)).alias("promoted"),
        F.lit(True).alias("recommendation_eligible"),
    )
