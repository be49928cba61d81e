"""Consecutive numbers for the rows of a distributed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekindle.session import local_table, materialise

PART_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def number_and_count(df: DataFrame, name: str, start: int = 0, kind: str = "int") -> tuple[DataFrame, int]:
    """Add ``name``: start, start+1, … in the partition order of ``df``, as ``kind`` (bigint above 2^31 rows).

    The row number inside the partition plus one offset per partition; no task sees all rows and
    the driver sees one count per partition, whose sum is the second result.
    """
    placed = materialise(df.withColumn("_at", F.monotonically_increasing_id()))
    offsets, total = [], start
    for row in placed.groupBy(F.shiftright("_at", PART_BITS).alias("p")).count().orderBy("p").collect():
        offsets.append((row["p"], total - (row["p"] << PART_BITS)))
        total += row["count"]
    shift = local_table(df.sparkSession, offsets, "_part bigint, _shift bigint")
    numbered = (
        placed.join(F.broadcast(shift), F.shiftright("_at", PART_BITS) == F.col("_part"))
        .withColumn(name, (F.col("_at") + F.col("_shift")).cast(kind))
        .drop("_at", "_part", "_shift")
    )
    return numbered, total - start


def number_rows(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    return number_and_count(df, name, start)[0]


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Interpolated quantiles of the non-null values: a range-partitioned sort, and the few rows at the wanted ranks.

    No task holds the distinct values of the column. An empty column gives an empty list.
    """
    ordered = df.select(F.col(column).alias("_v")).filter("_v IS NOT NULL").orderBy("_v")
    numbered, n = number_and_count(ordered, "_rank", kind="bigint")
    if not n:
        return []
    places = [share * (n - 1) for share in shares]
    ranks = sorted({int(p) for p in places} | {min(int(p) + 1, n - 1) for p in places})
    at = {r["_rank"]: r["_v"] for r in numbered.filter(F.col("_rank").isin(ranks)).collect()}
    low = lambda p: int(p)
    return [at[low(p)] if p == low(p) else (low(p) + 1 - p) * at[low(p)] + (p - low(p)) * at[low(p) + 1] for p in places]
