"""Rating and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRIC_DIGITS = 4


def rating_errors(test: DataFrame, predictions: DataFrame, digits: int = METRIC_DIGITS) -> DataFrame:
    """RMSE and MAE over the pairs present on both sides; null when there are none."""
    both = test.select("userID", "itemID", "rating").join(
        predictions.select("userID", "itemID", "prediction"), ["userID", "itemID"]
    )
    gap = F.col("rating") - F.col("prediction")
    gap = F.when(~F.isnan(gap), gap)
    return both.agg(
        F.round(F.sqrt(F.avg(gap * gap)), digits).alias("RMSE"),
        F.round(F.avg(F.abs(gap)), digits).alias("MAE"),
    )


def ranking_per_user(test: DataFrame, ranking: DataFrame, k: int = 10) -> DataFrame:
    """Precision, recall, NDCG and average precision of every user with a list and test items."""
    relevant = test.select("userID", "itemID").distinct()
    sizes = relevant.groupBy("userID").agg(F.count(F.lit(1)).alias("n_rel"))
    order = Window.partitionBy("userID").orderBy(F.col("score").desc(), F.col("itemID").asc())
    listed = ranking.select("userID", "itemID", "score").withColumn("pos", F.row_number().over(order))
    listed = listed.filter(F.col("pos") <= k).select("userID", "itemID", "pos")
    marked = listed.join(relevant.withColumn("hit", F.lit(1)), ["userID", "itemID"], "left")
    so_far = Window.partitionBy("userID").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.coalesce(F.col("hit"), F.lit(0))
    gains = marked.withColumn("hit", hit).withColumn("hits", F.sum("hit").over(so_far))
    per_user = gains.groupBy("userID").agg(
        F.sum("hit").alias("n_hits"),
        F.sum(F.col("hit") / F.log2(F.col("pos") + 1.0)).alias("dcg"),
        F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("pos")).otherwise(0.0)).alias("ap"),
    )
    best = F.least(F.col("n_rel"), F.lit(k)).cast("int")
    # ideal gain of a list whose first `best` places all hit
    ideal = F.aggregate(
        F.sequence(F.lit(1), best), F.lit(0.0), lambda acc, p: acc + F.lit(1.0) / F.log2(p + 1.0)
    )
    return per_user.join(sizes, "userID").select(
        "userID",
        (F.col("n_hits") / F.lit(float(k))).alias("precision"),
        (F.col("n_hits") / F.col("n_rel")).alias("recall"),
        (F.col("dcg") / ideal).alias("ndcg"),
        (F.col("ap") / best).alias("ap"),
    )


def ranking_quality(test: DataFrame, ranking: DataFrame, k: int = 10, digits: int = METRIC_DIGITS) -> DataFrame:
    """Means over users; users without a list or without test items do not count."""
    return ranking_per_user(test, ranking, k).agg(
        F.round(F.avg("precision"), digits).alias("precision_at_k"),
        F.round(F.avg("recall"), digits).alias("recall_at_k"),
        F.round(F.avg("ndcg"), digits).alias("ndcg_at_k"),
        F.round(F.avg("ap"), digits).alias("map_at_k"),
    )


def evaluate_all(test: DataFrame, predictions: DataFrame | None, ranking: DataFrame | None, algorithm: str,
                 k: int = 10) -> DataFrame:
    """One row with both metric families; a missing input leaves its metrics null."""
    spark = test.sparkSession
    none = "cast(null as double)"
    errors = (
        rating_errors(test, predictions)
        if predictions is not None
        else spark.range(1).selectExpr(f"{none} as RMSE", f"{none} as MAE")
    )
    quality = (
        ranking_quality(test, ranking, k)
        if ranking is not None
        else spark.range(1).selectExpr(
            *[f"{none} as {c}" for c in ("precision_at_k", "recall_at_k", "ndcg_at_k", "map_at_k")]
        )
    )
    # both sides are one-row aggregates
    return errors.crossJoin(quality).select(F.lit(algorithm).alias("algorithm"), "*")
