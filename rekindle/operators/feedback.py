"""Explicit, implicit or hybrid: what kind of feedback a table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Name parts of behaviour columns.
IMPLICIT_WORDS = "click view purchase buy order watch play impression dwell count event interaction".split()
MODES = ("explicit", "implicit", "hybrid", "auto")


def implicit_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c != "rating" and any(w in c.lower() for w in IMPLICIT_WORDS)]


def feedback_profile(df: DataFrame) -> DataFrame:
    """One row: range, distinct values, inferred kind, supported modes and the reason."""
    signals = implicit_columns(df.columns)
    names = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    if "rating" not in df.columns:
        return df.sparkSession.range(1).select(
            F.lit(0.0).alias("rating_min"), F.lit(1.0).alias("rating_max"), F.lit(1).cast("bigint").alias("n_unique"),
            F.lit(True).alias("is_implicit"), F.lit(False).alias("supports_explicit"),
            F.lit(True).alias("supports_implicit"), F.lit("implicit").alias("detected_mode"),
            F.lit("no rating column; treating as implicit").alias("reason"),
            names([]).alias("explicit_signals"), names(signals or ["interaction"]).alias("implicit_signals"),
        )
    value = F.col("rating").cast("double")
    stats = df.agg(
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
        F.count_distinct(value).alias("n"),
        F.coalesce(F.max((value % 1 != 0)), F.lit(False)).alias("decimals"),
        F.coalesce(F.min(value.isin(0.0, 1.0)), F.lit(True)).alias("binary"),
    )
    lo, hi, n, decimals = F.col("lo"), F.col("hi"), F.col("n"), F.col("decimals")
    scale = (lo >= 1) & hi.isin(5.0, 10.0) & (n >= 3)
    counts = (n <= 5) & (hi <= 10) & ~hi.isin(5.0, 10.0) & ~decimals
    whole = lambda c: c.cast("bigint").cast("string")
    implicit = (
        F.when((n == 0) | F.col("binary"), True)
        .when(scale, False)
        .when(counts, True)
        .when((n > 20) & decimals, False)
        .otherwise(hi <= 1)
    )
    reason = (
        F.when(n == 0, "empty rating column; treating as implicit")
        .when(F.col("binary"), "binary values {0,1}; interpreted as implicit")
        .when(scale, F.concat(F.lit("classic "), whole(lo), F.lit("-"), whole(hi), F.lit(" rating scale")))
        .when(counts, "low-cardinality integer counts; likely implicit")
        .when((n > 20) & decimals, F.concat(n.cast("string"), F.lit(" decimal-like values; likely explicit")))
        .when(hi > 1, "max value > 1; assuming explicit")
        .otherwise("max value <= 1; assuming implicit")
    )
    explicit = F.coalesce((decimals & (n >= 5)) | ((hi > 1) & (n >= 3)), F.lit(False))
    return stats.select(
        F.coalesce(lo, F.lit(0.0)).alias("rating_min"),
        F.coalesce(hi, F.lit(0.0)).alias("rating_max"),
        n.alias("n_unique"),
        implicit.alias("is_implicit"),
        explicit.alias("supports_explicit"),
        F.lit(True).alias("supports_implicit"),
        F.when(explicit, "hybrid").otherwise("implicit").alias("detected_mode"),
        reason.alias("reason"),
        F.when(explicit, names(["rating"])).otherwise(names([])).alias("explicit_signals"),
        names(sorted({"rating", *signals})).alias("implicit_signals"),
    )


def resolve_mode(profile, requested: str = "auto") -> str:
    """Mode to train in, given one row of :func:`feedback_profile`."""
    mode = (requested or "auto").lower().strip()
    if mode not in MODES:
        raise ValueError(f"Invalid algorithm_mode='{requested}'. Allowed: {', '.join(MODES)}.")
    if mode == "auto":
        return profile["detected_mode"]
    if mode in ("explicit", "hybrid") and not profile["supports_explicit"]:
        raise ValueError(f"{mode.capitalize()} mode requested but the table has no explicit feedback.")
    return mode
