"""The registered queries: name -> callable(spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rekindle.catalogue import CATALOGUE
from rekindle.functions import scalars
from rekindle.operators import (
    assemble,
    clean,
    content,
    downsample,
    evaluate,
    explain,
    factors,
    feedback,
    gradient,
    hybrid,
    implicit,
    leaderboard as boards,
    linear,
    neighbours,
    popularity,
    registry,
    roles,
    saved,
    serving,
    split,
)
from rekindle.operators.registry import ModelRegistry
from rekindle.operators.sparse import nearest
from rekindle.plans import tables
from rekindle.plans.algorithms import fit
from rekindle.session import local_table, work_dir
from rekindle.sources import readers

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round ``cols``; ranks become bigint and -0.0 becomes 0.0."""
    def shape(c):
        if c in cols:
            return (F.round(c, digits) + F.lit(0.0)).alias(c)
        return F.col(c).cast("bigint").alias(c) if c == "rank" else F.col(c)

    return df.select(*[shape(c) for c in df.columns])


def part_genres(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("itemID"), F.replace("p_name", F.lit(" "), F.lit("|")).alias("genres")
    )


# -- sources, cleaning, profiling ------------------------------------------------------------


@query
def interaction_query(spark: SparkSession, folder: str) -> DataFrame:
    lines = tables.read(spark, folder, "lineitem")
    return readers.interaction_columns(lines, "l_suppkey", "l_partkey", "l_quantity", where="l_quantity >= 45")


@query
def table_profile(spark: SparkSession, folder: str) -> DataFrame:
    return readers.profile_table(tables.read(spark, folder, "orders"))


@query
def raw_sql_dataset(spark: SparkSession, folder: str) -> DataFrame:
    tables.read(spark, folder, "events").createOrReplaceTempView("rekindle_events")
    return assemble.raw_sql_dataset(
        spark,
        "select user_id, get_json_object(props, '$.k') as item_id, event_type from rekindle_events where value > :least",
        least=20.0,
    )


@query
def clean_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return tables.order_interactions(spark, folder)


@query
def kcore(spark: SparkSession, folder: str) -> DataFrame:
    return clean.k_core(tables.order_interactions(spark, folder), 20, 22).df


@query
def cleaning_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(clean.cleaning_report(tables.order_rows(spark, folder), tables.ORDER_ROLES, 20, 22), "sparsity")


@query
def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    parts = split.drop_cold_users(split.hash_split(tables.order_interactions(spark, folder)))
    label = lambda df, name: df.select("userID", "itemID", F.lit(name).alias("part"))
    return label(parts.train, "train").unionByName(label(parts.test, "test"))


@query
def cold_users(spark: SparkSession, folder: str) -> DataFrame:
    return split.cold_users(split.hash_split(tables.order_interactions(spark, folder), 0.95))


@query
def feedback_profile(spark: SparkSession, folder: str) -> DataFrame:
    orders = tables.order_rows(spark, folder).select(F.col("l_quantity").alias("rating"))
    stars = orders.select((F.floor((F.col("rating") - 1) / 10) + 1).cast("double").alias("rating"))
    sources = {"orders": orders, "stars": stars, "events": tables.event_rows(spark, folder)}
    rows = [feedback.feedback_profile(df).withColumn("source", F.lit(name)) for name, df in sources.items()]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return out.withColumns({c: F.array_join(c, ",") for c in ("explicit_signals", "implicit_signals")})


@query
def matrix_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(clean.matrix_stats(tables.order_interactions(spark, folder)), "density", digits=9)


@query
def user_vector(spark: SparkSession, folder: str) -> DataFrame:
    return clean.user_vector(tables.order_interactions(spark, folder), "7")


@query
def name_functions(spark: SparkSession, folder: str) -> DataFrame:
    part = tables.read(spark, folder, "part")
    name = F.concat_ws("-", "p_brand", "p_name")
    return part.select(
        "p_partkey",
        scalars.plain_name(name).alias("plain"),
        scalars.compact_name(name).alias("compact"),
        F.array_join(scalars.name_tokens(name), ",").alias("tokens"),
        scalars.content_token(name).alias("content"),
        F.levenshtein("p_name", "p_type").cast("bigint").alias("distance"),
    )


# -- several sources -------------------------------------------------------------------------


@query
def key_normalise(spark: SparkSession, folder: str) -> DataFrame:
    orders = tables.read(spark, folder, "orders")
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice")
    kind = F.col("o_orderkey") % 7
    raw = (
        F.when(kind == 0, F.concat(F.lit("  "), key, F.lit(" ")))
        .when(kind == 1, F.concat(key, F.lit(".0")))
        .when(kind == 2, F.concat(F.lit("00"), key))
        .when(kind == 3, F.concat(key, F.lit(".50")))
        .when(kind == 4, F.concat(F.lit("A"), key))
        .when(kind == 5, F.concat(key, F.lit("e-3")))
        .otherwise(F.format_string("%.2f", price))
    )
    return orders.select("o_orderkey", raw.alias("raw"), scalars.join_key(raw).alias("join_key"))


@query
def outer_merge(spark: SparkSession, folder: str) -> DataFrame:
    nothing = spark.range(1)
    left = tables.read(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("cust"), "c_mktsegment")
    left = left.union(nothing.select(F.lit(None).cast("string"), F.lit("NONE")))
    right = tables.read(spark, folder, "orders").select(
        F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("cust"), "o_orderkey"
    )
    right = right.union(nothing.select(F.lit(None).cast("string"), F.lit(-1).cast("bigint")))
    keys = ["cust"]
    return assemble.outer_merge(assemble.normalise_keys(left, keys), assemble.normalise_keys(right, keys), keys)


@query
def coalesce_columns(spark: SparkSession, folder: str) -> DataFrame:
    nation = tables.read(spark, folder, "nation").select(
        F.col("n_nationkey").alias("nation"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("label")
    )
    customer = tables.read(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.min("c_name").alias("label"), F.count(F.lit(1)).alias("customers")
    )
    layout = assemble.Layout([("nation", nation.columns), ("customer", customer.columns)], ["nation"], ["label"])
    frames = [layout.renamed(i, df) for i, df in enumerate((nation, customer))]
    return layout.coalesced(assemble.outer_merge(*[assemble.normalise_keys(f, ["nation"]) for f in frames], ["nation"]))


@query
def output_order(spark: SparkSession, folder: str) -> DataFrame:
    """All lines with two sources that share a column: roles first, then the requested column, then the rest."""
    lines = tables.read(spark, folder, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("string").alias("segment"), "l_quantity")
    orders = tables.read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("segment"))
    frames = [("lines", lines.withColumnsRenamed({"l_partkey": "product_id", "l_quantity": "rating"}), {}), ("orders", orders, {})]
    out = assemble.assemble_interactions(frames, ["l_orderkey"], ["segment"])
    position = F.lit(",".join(out.columns))
    return out.withColumn("column_order", position)


@query
def assembled_dataset(spark: SparkSession, folder: str) -> DataFrame:
    lines = tables.read(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = tables.read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = tables.read(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    aliases, keys = assemble.apply_relationships(
        {"lineitem": {"l_partkey": "product_id", "l_quantity": "rating"},
         "orders": {"o_custkey": "customer_id", "o_orderdate": "created_at"}, "customer": {}},
        [("lineitem.l_orderkey", "orders.o_orderkey"), ("orders.o_custkey", "customer.c_custkey")],
    )
    sources = {"lineitem": lines, "orders": orders, "customer": customer}
    return assemble.assemble_interactions([(n, df, aliases[n]) for n, df in sources.items()], keys)


@query
def role_detection(spark: SparkSession, folder: str) -> DataFrame:
    """Distance, penalty, stand-in and evidence of each column in each role."""
    lines = tables.read(spark, folder, "lineitem").select(*[F.col(c).alias(name) for c, name in tables.ROLE_COLUMNS.items()])
    scores = roles.role_scores(spark, roles.column_facts(lines))
    numbers = [F.col(c).cast("bigint").alias(c) for c in ("distance", "penalty", "evidence")]
    return scores.select("column", "role", *numbers, "stands_in")


@query
def flatten_props(spark: SparkSession, folder: str) -> DataFrame:
    events = tables.read(spark, folder, "events")
    nested = events.select("event_id", F.struct("user_id", F.from_json("props", "k bigint").alias("props")).alias("doc"))
    return assemble.flatten(nested).withColumnsRenamed({"doc.user_id": "user_id", "doc.props.k": "props_k"})


# -- recommenders with exact SQL counterparts ------------------------------------------------


@query
def popularity_topk(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    return rounded(popularity.popularity_top(parts.train, parts.test, 10), "score")


@query
def eval_explicit(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    means = parts.train.groupBy("itemID").agg(F.avg("rating").alias("prediction"))
    predicted = parts.test.select("userID", "itemID").join(means, "itemID")
    return evaluate.rating_errors(parts.test, predicted)


@query
def eval_ranking(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    return evaluate.ranking_quality(parts.test, popularity.popularity_top(parts.train, parts.test, 10), 10)


@query
def item_cosine(spark: SparkSession, folder: str) -> DataFrame:
    near = nearest(tables.order_split(spark, folder).train, "itemID", "userID", 10)
    return rounded(near, "sim")


@query
def user_cosine(spark: SparkSession, folder: str) -> DataFrame:
    near = nearest(tables.order_split(spark, folder).train, "userID", "itemID", 10)
    return rounded(near, "sim")


@query
def user_knn(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    return rounded(neighbours.user_knn_top(parts.train, parts.test, 10), "score")


@query
def item_knn(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    return rounded(neighbours.item_knn_top(parts.train, parts.test, 10), "score")


@query
def genre_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neighbours.genre_jaccard(part_genres(spark, folder))
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")
    return rounded(ordered, "jaccard")


@query
def item_knn_predictions(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    near = neighbours.item_knn_neighbours(parts.train)
    scores = neighbours.item_predictions(parts.test, parts.train, near)
    return rounded(neighbours.predictions(parts.test, scores, parts.train), "prediction")


@query
def user_knn_predictions(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    near = neighbours.user_knn_neighbours(parts.train)
    scores = neighbours.user_predictions(parts.test, parts.train, near)
    return rounded(neighbours.predictions(parts.test, scores, parts.train), "prediction")


@query
def movie_item_knn(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    top = neighbours.movie_item_knn_top(parts.train, parts.test, 10, metadata=part_genres(spark, folder))
    return rounded(top, "score")


@query
def dominant_value(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.with_part_features(tables.order_interactions(spark, folder), spark, folder)
    return content.dominant_values(rows, "userID")


@query
def tfidf_items(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    rows = tables.with_part_features(parts.train, spark, folder)
    return rounded(content.item_tfidf(rows).drop("df", "terms_cut"), "weight")


@query
def content_topk(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    train = tables.with_part_features(parts.train, spark, folder)
    return rounded(content.content_top(train, parts.test, 10), "score")


@query
def purchase_weights(spark: SparkSession, folder: str) -> DataFrame:
    return implicit.purchase_weighted(tables.event_split(spark, folder).train).select(
        "userID", "itemID", "event_type", "rating"
    )


@query
def bm25_weights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(implicit.bm25_weights(tables.order_split(spark, folder).train).select("userID", "itemID", "weight"), "weight")


@query
def time_bins(spark: SparkSession, folder: str) -> DataFrame:
    binned = factors.time_bins(tables.order_interactions(spark, folder), 5)
    return binned.select("userID", "itemID", F.col("bin").cast("bigint").alias("bin"))


@query
def downsampled(spark: SparkSession, folder: str) -> DataFrame:
    return downsample.densest(tables.order_interactions(spark, folder), 500, 300)


# -- models that SQL cannot express ----------------------------------------------------------


def model_lists(model, parts) -> DataFrame:
    return rounded(model.top(parts.train, parts.test, 10), "score")


@query
def svd_topk(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    return model_lists(factors.svd(parts.train), parts)


@query
def temporal_svd_topk(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    return model_lists(factors.temporal_svd(parts.train), parts)


@query
def nmf_topk(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    return model_lists(factors.nmf(parts.train), parts)


@query
def als_topk(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    return model_lists(implicit.als(parts.train), parts)


@query
def bm25_als_topk(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    return model_lists(implicit.bm25_als(parts.train), parts)


@query
def purchase_als_topk(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.event_split(spark, folder)
    return model_lists(implicit.purchase_als(parts.train), parts)


@query
def ease_topk(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    return rounded(linear.ease_top(parts.train, parts.test, 10), "score")


@query
def svdpp_topk(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    return model_lists(gradient.svdpp(parts.train), parts)


@query
def fm_topk(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    train = tables.with_part_features(parts.train, spark, folder)
    return model_lists(hybrid.factorization_machine_model(train), parts)


@query
def bpr_topk(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    return model_lists(gradient.bpr(parts.train), parts)


@query
def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    train = tables.with_segment(tables.with_part_features(parts.train, spark, folder), spark, folder)
    return model_lists(hybrid.lightfm_style(train), parts)


@query
def autoencoder_topk(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.order_split(spark, folder)
    return model_lists(gradient.autoencoder(parts.train), parts)


# -- benchmark tables ------------------------------------------------------------------------


@query
def scalability_score(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(e.name, e.scalability, e.max_users, e.max_items) for e in CATALOGUE.values()]
    entries = local_table(spark, rows, "algorithm string, rating string, max_users bigint, max_items bigint")
    sizes = clean.matrix_stats(tables.order_interactions(spark, folder))
    score = boards.scalability_score(*[F.col(c) for c in ("rating", "n_users", "n_items", "max_users", "max_items")])
    return sizes.crossJoin(F.broadcast(entries)).select("algorithm", F.round(score, 6).alias("score"))


def board(spark: SparkSession, folder: str) -> DataFrame:
    return boards.leaderboard(tables.run_rows(spark, folder))


@query
def leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(board(spark, folder))


@query
def selection_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = boards.selection_scores(board(spark, folder))
    return rounded(scored.select("experiment_id", "algorithm", "rank", "selection_score_pct"))


@query
def serving_choice(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(boards.serving_choice(boards.selection_scores(board(spark, folder))))


def registry_log(spark: SparkSession, folder: str) -> DataFrame:
    """The event log read as a model log: users are models, purchases promote, large errors delete."""
    events = tables.read(spark, folder, "events")
    first = events.groupBy("user_id").agg(F.min("event_id").alias("seq"))
    logged = events.filter((F.col("event_type") == "purchase") | ((F.col("event_type") == "error") & (F.col("value") > 95)))
    kind = F.when(F.col("event_type") == "purchase", "promoted").otherwise("deleted")
    rows = first.select("seq", F.lit("saved").alias("event"), "user_id").union(logged.select("event_id", kind, "user_id"))
    return rows.select(
        "seq", "event", F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model_id"),
        F.concat(F.lit("a"), (F.col("user_id") % 7).cast("string")).alias("algorithm"),
        F.col("seq").cast("double").alias("created_at"),
    )


@query
def model_states(spark: SparkSession, folder: str) -> DataFrame:
    return registry.model_states(registry_log(spark, folder))


@query
def model_latest(spark: SparkSession, folder: str) -> DataFrame:
    return registry.latest(registry.model_states(registry_log(spark, folder)))


# -- ensembles and explanations --------------------------------------------------------------

WEIGHTS = [("count", "Count", 50.0), ("value", "Value", 30.0), ("recent", "Recent", 20.0)]


def candidate_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Three lists per event user: its keys by number of events, by mean value and by newest event."""
    events = tables.read(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("userID"), F.get_json_object("props", "$.k").alias("itemID"), "value", "event_id"
    )
    stats = events.groupBy("userID", "itemID").agg(
        F.count(F.lit(1)).cast("double").alias("count"),
        F.round(F.avg("value"), 6).alias("value"),
        F.max("event_id").cast("double").alias("recent"),
    )
    long = stats.unpivot(["userID", "itemID"], ["count", "value", "recent"], "model_id", "score")
    w = Window.partitionBy("userID", "model_id").orderBy(F.col("score").desc(), F.col("itemID").asc())
    depth = serving.candidate_depth(5)
    return long.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= depth).drop("_r")


@query
def minmax_models(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(serving.minmax_scores(candidate_lists(spark, folder)), "normalized_score")


def ensemble_lists(spark: SparkSession, folder: str) -> DataFrame:
    weights = serving.normalise_weights(spark, WEIGHTS)
    return serving.ensemble(candidate_lists(spark, folder), weights, 5)


@query
def ensemble_weighted(spark: SparkSession, folder: str) -> DataFrame:
    flat = ensemble_lists(spark, folder).select("userID", "rank", "itemID", "final_score", F.inline("contributions"))
    return rounded(flat, "normalized_score", "weighted_score", "share_pct", digits=4)


@query
def single_model(spark: SparkSession, folder: str) -> DataFrame:
    one = candidate_lists(spark, folder).filter(F.col("model_id") == "value")
    return rounded(serving.single_model(one, 5).drop("contributions"))


@query
def contribution_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(serving.contribution_breakdown(ensemble_lists(spark, folder)), "weighted_score", "share_pct", digits=3)


@query
def weight_rebalance(spark: SparkSession, folder: str) -> DataFrame:
    lists = candidate_lists(spark, folder).filter((F.col("model_id") != "recent") | (F.col("userID").cast("bigint") % 2 == 0))
    return rounded(serving.rebalance(lists, serving.normalise_weights(spark, WEIGHTS)), "normalized_weight")


@query
def popularity_fallback(spark: SparkSession, folder: str) -> DataFrame:
    train = tables.order_split(spark, folder).train
    users = tables.read(spark, folder, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("userID"))
    users = users.union(tables.read(spark, folder, "customer").select(F.col("c_custkey").cast("string")))
    scores = popularity.item_popularity(train)
    lists = lambda known, n: popularity.popular_unseen(scores, train, known, n)
    return rounded(serving.recommend_for(users, lists, train, "Ecommerce-Popularity", 5), "score")


def saved_models(spark: SparkSession, folder: str):
    """A new registry with the fitted popularity and item neighbour models of the orders, and their ids."""
    train = tables.order_split(spark, folder).train
    registry = ModelRegistry(spark, f"{work_dir(spark)}/models-{uuid.uuid4().hex}")
    names = ("Ecommerce-Popularity", "Item-KNN")
    return registry, [saved.save(registry, name, fit(name, train).tables, train) for name in names]


@query
def serve_saved(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of the saved neighbour model for all customers, and for suppliers, whom it does not know."""
    registry, (_, model_id) = saved_models(spark, folder)
    registry.promote(model_id)
    users = tables.read(spark, folder, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("userID"))
    users = users.union(tables.read(spark, folder, "customer").select(F.col("c_custkey").cast("string")))
    return rounded(saved.serve_promoted(registry, users, 5), "score")


@query
def serve_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    registry, ids = saved_models(spark, folder)
    users = tables.read(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("userID"))
    return saved.serve_ensemble(registry, list(zip(ids, (60.0, 40.0))), users, 5).drop("contributions")


def vectors(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Embeddings under the ids of event users or event keys."""
    table = tables.read(spark, folder, "embeddings")
    return table.select(F.col("vec_id").cast("string").alias(key), F.col("embedding").cast("array<double>").alias("vec"))


@query
def similar_items(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(serving.similar_items(vectors(spark, folder, "itemID"), 10), "similarity")


def event_recommendations(spark: SparkSession, folder: str):
    train = tables.event_split(spark, folder).train
    users = train.select("userID").distinct()
    recs = popularity.popular_unseen(popularity.item_popularity(train), train, users, 5)
    return train, recs.select("userID", "itemID", "score")


@query
def explain_items(spark: SparkSession, folder: str) -> DataFrame:
    train, recs = event_recommendations(spark, folder)
    return rounded(explain.similar_history(recs, train, vectors(spark, folder, "itemID")))


@query
def explain_users(spark: SparkSession, folder: str) -> DataFrame:
    train, recs = event_recommendations(spark, folder)
    return rounded(explain.similar_users(recs, train, vectors(spark, folder, "userID")))


@query
def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    _, recs = event_recommendations(spark, folder)
    top = explain.feature_importance(recs, vectors(spark, folder, "userID"), vectors(spark, folder, "itemID"))
    return rounded(top.withColumn("dimension", F.col("dimension").cast("bigint")))


@query
def explain_reason(spark: SparkSession, folder: str) -> DataFrame:
    train, recs = event_recommendations(spark, folder)
    history = explain.first_history(recs, train)
    near = explain.first_users(recs, train)
    out = explain.explanations(recs, history, near)
    return out.select("userID", "itemID", "primary_reason", "confidence")
