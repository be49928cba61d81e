"""From a raw table to a clean interaction table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekindle.functions.scalars import epoch_micros, safe_double
from rekindle.session import broadcast_if_small, discard, materialise

ROLES = ("userID", "itemID", "rating", "timestamp")


@dataclass(frozen=True)
class Roles:
    """Source column of each role; None where the table has no such column."""

    userID: str | None = None
    itemID: str | None = None
    rating: str | None = None
    timestamp: str | None = None

    def items(self):
        return [(role, getattr(self, role)) for role in ROLES if getattr(self, role)]


def project_roles(df: DataFrame, roles: Roles) -> DataFrame:
    """Rename the mapped columns and keep the rest; the first of equal names wins."""
    names = {source: role for role, source in roles.items()}
    chosen, taken = [], set()
    for source in df.columns:
        name = names.get(source, source)
        if name not in taken:
            taken.add(name)
            chosen.append(F.col(f"`{source}`").alias(name))
    return df.select(*chosen)


def drop_null_ids(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["userID", "itemID"])


def keep_last(df: DataFrame) -> DataFrame:
    """One row per (user, item): the latest, then the highest rating, then the other columns.

    ``max`` of a struct combines on the map side, so a pair that repeats in a large part of the
    table never meets in one task.
    """
    order = [c for c in ("timestamp", "rating") if c in df.columns]
    rest = [c for c in df.columns if c not in ("userID", "itemID", *order)]
    picked = [*order, *rest]
    if not picked:
        return df.distinct()
    best = df.groupBy("userID", "itemID").agg(F.max(F.struct(*[F.col(f"`{c}`") for c in picked])).alias("_r"))
    at = {c: F.col(f"_r.`{c}`") for c in picked}
    return best.select(*[at[c].alias(c) if c in at else F.col(c) for c in df.columns])


def coerce_types(df: DataFrame) -> DataFrame:
    """Ids to text, bad ratings to 0 (1 when there is no rating column), times to epoch micros."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for c in df.columns:
        if c in ("userID", "itemID"):
            cols.append(F.col(c).cast("string").alias(c))
        elif c == "rating":
            cols.append(F.coalesce(safe_double(F.col(c), types[c]), F.lit(0.0)).alias(c))
        elif c == "timestamp":
            cols.append(epoch_micros(F.col(c), types[c]).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    if "rating" not in types:
        cols.insert(2, F.lit(1.0).alias("rating"))
    return df.select(*cols)


def standardise(df: DataFrame, roles: Roles) -> DataFrame:
    """Projection, null filter, dedup and coercion in one lazy plan."""
    return coerce_types(keep_last(drop_null_ids(project_roles(df, roles))))


@dataclass
class CoreResult:
    df: DataFrame
    removed_users: int
    removed_items: int
    rounds: int
    rows: int
    users: int
    items: int


def _lost(pairs: DataFrame, key: str, gone: DataFrame, other: str) -> DataFrame:
    """How many pairs each ``key`` loses with the ids of ``other`` in ``gone``."""
    hit = pairs.join(broadcast_if_small(gone), other, "left_semi")
    return hit.groupBy(key).agg(F.count(F.lit(1)).alias("_lost"))


def _without(pairs: DataFrame, key: str, gone: DataFrame | None) -> DataFrame:
    return pairs if gone is None else pairs.join(broadcast_if_small(gone), key, "left_anti")


def k_core(df: DataFrame, min_user: int = 3, min_item: int = 3) -> CoreResult:
    """Drop users, then items, below the thresholds until nothing changes. ``df`` holds a pair once.

    The table is written once. Ids keep a count, and a round counts only the pairs of the ids that it drops: it reads the two id columns,
    joined with few ids, and shuffles what these ids lose. The pairs are written again only when half of them are gone.
    """
    df = materialise(df)
    pairs = df.select("userID", "itemID")
    count = lambda key: materialise(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
    sides = {"userID": [count("userID"), min_user, 0], "itemID": [count("itemID"), min_item, 0]}
    total = left = sides["userID"][0].agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    gone: dict[str, DataFrame | None] = {"userID": None, "itemID": None}  # dropped since the pairs were written
    rounds = 0
    while True:
        rounds += 1
        before = left
        for key, other in (("userID", "itemID"), ("itemID", "userID")):
            counts, least, _ = sides[key]
            weak = materialise(counts.filter(F.col("_n") < least))
            found = weak.agg(F.count(F.lit(1)).alias("ids"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).first()
            if not found["ids"]:
                discard(weak)
                continue
            ids = weak.select(key)
            sides[key] = [materialise(counts.filter(F.col("_n") >= least)), least, sides[key][2] + found["ids"]]
            if found["rows"]:
                lost = materialise(_lost(_without(pairs, other, gone[other]), other, ids, key))
                fewer = sides[other][0].join(broadcast_if_small(lost), other, "left")
                fewer = fewer.select(other, (F.col("_n") - F.coalesce("_lost", F.lit(0))).alias("_n"))
                now = materialise(fewer.filter("_n > 0"))  # ids that lost all their pairs are gone with them, not dropped
                discard(lost)
                discard(sides[other][0])
                sides[other][0] = now
            discard(counts)
            known = gone[key]
            gone[key] = materialise(ids if known is None else known.union(ids))
            discard(known)
            discard(weak)
            left -= found["rows"]
        if left == before:
            break
        if 2 * left < total:
            kept = materialise(_without(_without(pairs, "userID", gone["userID"]), "itemID", gone["itemID"]))
            discard(pairs)
            pairs, total = kept, left
            for key in gone:
                discard(gone[key])
                gone[key] = None
    core = df
    for key in ("userID", "itemID"):
        core = core.join(broadcast_if_small(sides[key][0].select(key)), key, "left_semi")
    users, items = (sides[key][0].count() for key in ("userID", "itemID"))
    return CoreResult(core.select(*df.columns), sides["userID"][2], sides["itemID"][2], rounds, left, users, items)


def cleaning_report(raw: DataFrame, roles: Roles, min_user: int = 3, min_item: int = 3) -> DataFrame:
    """One row: rows after each step, users, items and sparsity."""
    selected = project_roles(raw, roles)
    # the raw table is read once: pair multiplicities carry every count up to the dedup
    pairs = materialise(
        selected.groupBy("userID", "itemID").agg(F.count(F.lit(1)).alias("n"))
    )
    valid = F.col("userID").isNotNull() & F.col("itemID").isNotNull()
    first = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("initial_rows"),
        F.coalesce(F.sum(F.when(valid, F.col("n"))), F.lit(0)).alias("after_dropna"),
        F.count(F.when(valid, 1)).alias("after_dedup"),
    ).first()
    core = k_core(
        pairs.filter(valid).select(F.col("userID").cast("string"), F.col("itemID").cast("string")),
        min_user,
        min_item,
    )
    # the rounds know what is left: no pass over the core
    left = [F.lit(n).cast("bigint").alias(name) for name, n in (("after_kcore", core.rows), ("n_users", core.users), ("n_items", core.items))]
    return raw.sparkSession.range(1).select(*left).select(
        F.lit(first["initial_rows"]).cast("bigint").alias("initial_rows"),
        F.lit(first["initial_rows"]).cast("bigint").alias("after_column_select"),
        F.lit(first["after_dropna"]).cast("bigint").alias("after_dropna"),
        F.lit(first["after_dedup"]).cast("bigint").alias("after_dedup"),
        "after_kcore",
        "n_users",
        "n_items",
        sparsity(F.col("after_kcore"), F.col("n_users"), F.col("n_items")).alias("sparsity"),
        F.lit(first["initial_rows"] - first["after_dropna"]).cast("bigint").alias("removed_null"),
        F.lit(first["after_dropna"] - first["after_dedup"]).cast("bigint").alias("removed_dup"),
        F.lit(core.removed_users).cast("bigint").alias("removed_kcore_users"),
        F.lit(core.removed_items).cast("bigint").alias("removed_kcore_items"),
    )


def sparsity(rows, users, items):
    cells = users.cast("double") * items.cast("double")
    return F.when(cells > 0, F.lit(1.0) - rows / cells).otherwise(F.lit(1.0))


def matrix_stats(df: DataFrame) -> DataFrame:
    """Users, items, stored cells and density of an interaction table."""
    stats = df.agg(
        F.count_distinct("userID").alias("n_users"),
        F.count_distinct("itemID").alias("n_items"),
        F.count(F.lit(1)).alias("nnz"),
    )
    cells = F.col("n_users").cast("double") * F.col("n_items").cast("double")
    return stats.withColumn("density", F.when(cells > 0, F.col("nnz") / cells))


def user_vector(df: DataFrame, user: str) -> DataFrame:
    return df.filter(F.col("userID") == F.lit(user)).select("itemID", "rating")


def item_vector(df: DataFrame, item: str) -> DataFrame:
    return df.filter(F.col("itemID") == F.lit(item)).select("userID", "rating")
