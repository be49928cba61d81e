"""Ranking of benchmark runs, tuning results and serving choices, for many experiments at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of quality, speed and scalability; prior of each scalability rating.
QUALITY, SPEED, SCALE = 0.7, 0.2, 0.1
PRIORS = {"low": 0.35, "medium": 0.65, "high": 0.9}
EXPERIMENT = "experiment_id"


def scalability_score(rating: Column, n_users: Column, n_items: Column, max_users: Column, max_items: Column) -> Column:
    """Blend of the rating's prior and the room below the size limits; no limit counts as full room."""
    prior = F.lit(PRIORS["medium"])
    for name, value in PRIORS.items():
        prior = F.when(F.lower(rating) == name, F.lit(value)).otherwise(prior)
    room = lambda n, top: F.when(top.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - n / top))
    fit = (room(n_users, max_users) + room(n_items, max_items)) / 2
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * prior + 0.4 * fit))


def _minmax(c: Column, maximize: bool, w) -> Column:
    """0..1 inside the experiment; all equal is 1, an experiment without values is 0, null stays null."""
    low, high = F.min(c).over(w), F.max(c).over(w)
    scaled = (c - low) / (high - low) if maximize else (high - c) / (high - low)
    return F.when(low.isNull(), F.lit(0.0)).when(low == high, F.lit(1.0)).otherwise(scaled)


def leaderboard(runs: DataFrame, maximize: bool = True) -> DataFrame:
    """``experiment_id, algorithm, metric, elapsed_s, scalability`` with scores and rank per experiment."""
    w = Window.partitionBy(EXPERIMENT)
    scale = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("scalability", F.lit(0.5))))
    scored = runs.withColumn("_perf", _minmax(F.col("metric"), maximize, w)).withColumn(
        "_speed", _minmax(F.col("elapsed_s"), False, w)
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    composite = QUALITY * zero("_perf") + SPEED * zero("_speed") + SCALE * scale
    scored = scored.select(
        *runs.columns,
        F.round("_perf", 4).alias("performance_score"),
        F.round("_speed", 4).alias("speed_score"),
        F.round(composite, 4).alias("composite_score"),
    )
    order = w.orderBy(
        F.col("composite_score").desc(), F.col("performance_score").desc_nulls_last(),
        F.col("speed_score").desc_nulls_last(), F.col("algorithm").asc(),
    )
    return scored.withColumn("rank", F.row_number().over(order))


def selection_scores(board: DataFrame, metric_name: str = "NDCG@K", maximize: bool = True) -> DataFrame:
    """Percentage per row: weighted mean of the signals that exist for it."""
    w = Window.partitionBy(EXPERIMENT)
    metric, composite = F.col("metric"), F.col("composite_score")
    inside = lambda c: F.least(F.lit(100.0), F.greatest(F.lit(0.0), c))
    bounded = F.lit(None).cast("double")
    if maximize:
        bounded = F.when((metric >= 0) & (metric <= 1), metric * 100)
    if metric_name.upper() == "RMSE":
        bounded = F.when(metric.isNotNull(), 100 / (1 + F.greatest(metric, F.lit(0.0))))

    def spread(c: Column, up: bool) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        part = (c - low) / (high - low) * 100 if up else (high - c) / (high - low) * 100
        return F.when(c.isNull(), F.lit(None)).when(high - low <= 1e-12, F.lit(100.0)).otherwise(inside(part))

    signals = [
        (bounded, 0.5),
        (F.when((composite >= 0) & (composite <= 1), composite * 100), 0.25),
        (spread(metric, maximize), 0.25),
        (spread(composite, True), 0.25),
    ]
    named = board
    for i, (value, _) in enumerate(signals):
        named = named.withColumn(f"_s{i}", value)
    top = sum((F.coalesce(F.col(f"_s{i}") * wt, F.lit(0.0)) for i, (_, wt) in enumerate(signals)), F.lit(0.0))
    weight = sum((F.when(F.col(f"_s{i}").isNotNull(), wt).otherwise(0.0) for i, (_, wt) in enumerate(signals)), F.lit(0.0))
    score = F.when(weight > 0, F.round(top / weight, 2)).otherwise(F.lit(0.0))
    return named.withColumn("selection_score_pct", score).drop(*[f"_s{i}" for i in range(len(signals))])


def serving_choice(scored: DataFrame, shortlist: int = 10) -> DataFrame:
    """Models to serve per experiment: a clear winner alone, otherwise the best few."""
    if shortlist not in (5, 10):
        raise ValueError("shortlist must be 5 or 10")
    w = Window.partitionBy(EXPERIMENT).orderBy("rank")
    everyone = Window.partitionBy(EXPERIMENT)
    led = scored.withColumn("_next", F.lead("selection_score_pct").over(w))
    first = F.col("rank") == 1
    n = F.count(F.lit(1)).over(everyone)
    top = F.max(F.when(first, F.col("selection_score_pct"))).over(everyone)
    gap = F.max(F.when(first, F.round(F.col("selection_score_pct") - F.col("_next"), 2))).over(everyone)
    marked = led.withColumn("_n", n).withColumn("_top", top).withColumn("_gap", F.coalesce(gap, F.lit(100.0)))
    alone = (F.col("_n") == 1) | (F.col("_top") >= 90) | ((F.col("_top") >= 75) & (F.col("_gap") >= 10))
    size = F.when(alone, 1).otherwise(F.least(F.col("_n"), F.lit(shortlist), F.lit(5)))
    served = marked.filter(F.col("rank") <= size)
    return served.select(
        EXPERIMENT, "rank", "algorithm", "selection_score_pct", F.col("_gap").alias("score_gap"),
        F.when(alone, "single_model").otherwise("ensemble_weighted").alias("strategy"),
    )


def rank_tuning(results: DataFrame, maximize: bool = True) -> DataFrame:
    """``algorithm, status, best_value, benchmark_value``: ok, fallback, skipped, failed, then the metric."""
    status = F.when(F.col("status") == "ok", 0).when(F.col("status") == "fallback", 1)
    status = status.when(F.col("status") == "skipped", 2).when(F.col("status") == "failed", 3).otherwise(4)
    value = F.coalesce("best_value", "benchmark_value")
    worst = F.lit(float("-inf") if maximize else float("inf"))
    key = F.coalesce(value, worst)
    by = [EXPERIMENT] if EXPERIMENT in results.columns else []
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(
        status, key.desc() if maximize else key.asc(), F.col("algorithm")
    )
    return results.withColumn("rank", F.row_number().over(order))
