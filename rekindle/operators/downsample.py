"""The densest part of an interaction table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Users and items kept.
NORMAL_SIZE = (10_000, 5_000)
BROADCAST_IDS = 1_000_000


def _busiest(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).count().orderBy(F.col("count").desc(), F.col(key).asc()).limit(n).select(key)


def densest(df: DataFrame, n_users: int = NORMAL_SIZE[0], n_items: int = NORMAL_SIZE[1]) -> DataFrame:
    """Rows of the busiest users, then of their busiest items; up to a million ids are broadcast."""
    def kept(rows: DataFrame, key: str, n: int) -> DataFrame:
        ids = _busiest(rows, key, n)
        return rows.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, "left_semi")

    return kept(kept(df, "userID", n_users), "itemID", n_items)


def follow(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test rows whose user and item the sampled training part still holds."""
    for key in ("userID", "itemID"):
        test = test.join(train.select(key).distinct(), key, "left_semi")
    return test
