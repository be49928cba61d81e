"""Train/test split by a stable hash of the pair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekindle.functions.scalars import split_bucket

TEST_RATIO = 0.25


@dataclass
class Split:
    train: DataFrame
    test: DataFrame


def hash_split(df: DataFrame, test_ratio: float = TEST_RATIO, salt: str = "") -> Split:
    """Both parts are filters on the same hash, so neither needs a shuffle."""
    bucket = split_bucket(F.col("userID"), F.col("itemID"), salt)
    cut = int(test_ratio * 10000)
    return Split(df.filter(bucket >= cut), df.filter(bucket < cut))


def drop_cold_users(split: Split) -> Split:
    known = split.train.select("userID").distinct()
    return Split(split.train, split.test.join(known, "userID", "left_semi"))


def cold_users(split: Split) -> DataFrame:
    """Test users without any training row."""
    known = split.train.select("userID").distinct()
    return split.test.select("userID").distinct().join(known, "userID", "left_anti")


def check_splittable(df: DataFrame) -> None:
    n = df.limit(2).count()
    if n == 0:
        raise ValueError("Dataset validation failed: no interactions remained after cleaning")
    if n < 2:
        raise ValueError("Dataset validation failed: only 1 interaction row remained; at least 2 are required")


def train_test(df: DataFrame, test_ratio: float = TEST_RATIO, salt: str = "") -> Split:
    """Validated split without cold test users."""
    check_splittable(df)
    return drop_cold_users(hash_split(df, test_ratio, salt))
