import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def planted(spark):
    """Ratings round(3 + p·q) of rank 3 on 60 users × 40 items, 40 % observed, with the dense matrix."""
    rng = np.random.default_rng(7)
    p, q = rng.normal(0, 0.8, (60, 3)), rng.normal(0, 0.8, (40, 3))
    full = np.clip(np.round(3 + p @ q.T), 1, 5)
    mask = rng.random(full.shape) < 0.4
    rows = [(f"u{u:02d}", f"i{i:02d}", float(full[u, i]), float(u * 40 + i)) for u, i in zip(*np.nonzero(mask))]
    df = spark.createDataFrame(rows, "userID string, itemID string, rating double, timestamp double")
    matrix = np.where(mask, full, 0.0)
    keep_u, keep_i = mask.any(1), mask.any(0)
    assert keep_u.all() and keep_i.all()
    return df.cache(), matrix, full


def dense(factors, n_users=60, n_items=40):
    """Score matrix of a factor model with ids uNN and iNN."""
    users = {r["userID"]: np.array(r["vec"]) for r in factors.users.collect()}
    items = {r["itemID"]: np.array(r["vec"]) for r in factors.items.collect()}
    p = np.stack([users[f"u{u:02d}"] for u in range(n_users)])
    q = np.stack([items[f"i{i:02d}"] for i in range(n_items)])
    return p @ q.T
