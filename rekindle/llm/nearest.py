"""Nearest neighbours by inner product: a block matrix join over int8 tiles with error bounds.

Query rows and candidate rows fall into blocks of bounded size, and each pair of blocks is one group. In it, vectors are
quantised to int8 with one scale each, tiles of the integer product estimate all inner products, and the norms of
the quantisation residuals bound the error. Pairs whose upper bound reaches the k-th largest lower bound of their query
are recomputed from the original vectors in double precision; heaps merge the k best of each block.
So no neighbour is lost: the result is exact.
"""

from __future__ import annotations

import heapq
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rekindle.llm.base import schema_of, table

FOUND = "query_id bigint, vec_id bigint, score double"
TILE = 256


def usable(vector: Column) -> Column:
    """Neither null, zero nor with null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as floats for the product), scales, norms of the coded vectors, norms of the residuals."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes.astype(np.float32 if x.shape[1] <= 1000 else np.float64), scale, np.linalg.norm(coded, axis=1), np.linalg.norm(x - coded, axis=1)


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """(query id, vector id, score) of the k largest inner products of each query, itself left out, best first."""
    q8, qs, qn, qe = quantised(queries)
    c8, cs, _, ce = quantised(vectors)
    cn = np.linalg.norm(vectors, axis=1)
    out = []
    for at in range(0, len(queries), TILE):
        rows = slice(at, at + TILE)
        near = (q8[rows] @ c8.T) * (qs[rows, None] * cs[None, :])
        error = qe[rows, None] * cn[None, :] + qn[rows, None] * ce[None, :]
        error = error * 1.0001 + 1e-12 * (qn[rows, None] + qe[rows, None]) * cn[None, :]
        own = query_ids[rows, None] == ids[None, :]
        lower = np.where(own, -np.inf, near - error)
        if len(ids) > k:
            least = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            least = np.full(len(lower), -np.inf)
        row, col = np.nonzero((near + error >= least[:, None]) & ~own)
        score = np.empty(len(row))
        for s in range(0, len(row), 1 << 15):
            part = slice(s, s + (1 << 15))
            # added up from left to right, as a plain loop does
            score[part] = np.add.accumulate(queries[at + row[part]] * vectors[col[part]], axis=1)[:, -1]
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        keep = rank < k
        out.append((query_ids[at + row[keep]], ids[col[keep]], score[keep]))
    return [np.concatenate(c) for c in zip(*out)]


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20, query_rows: int = 2048, block_rows: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest candidates of each query, all of them if there are fewer.

    Both frames have vec_id and embedding; other columns are ignored. Rows with a null id or an unusable vector take no part,
    vectors of other lengths than the query's are no candidates of it. Rows that repeat an id count once, with the largest
    vector; a candidate with the query's id is its own row. Ties go to the smaller vec_id. An empty side gives no rows.
    """

    def clean(df: DataFrame) -> DataFrame:
        kind = "array<float>" if dict(df.dtypes)["embedding"] == "array<float>" else "array<double>"
        rows = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
        rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        return rows.groupBy("vec_id").agg(F.max("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))

    left, right = clean(queries), clean(candidates)
    strips = max(1, -(-left.count() // query_rows))
    blocks = max(1, -(-right.count() // block_rows))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("strip", block(strips)).withColumn("block", every(blocks))
    right = right.withColumn("block", block(blocks)).withColumn("strip", every(strips))
    target = to_arrow_schema(schema_of(FOUND))

    def matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        vectors = rows.column("embedding").combine_chunks()
        return rows.column("vec_id").to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)

    def tiles(asked: pa.Table, given: pa.Table) -> pa.Table:
        if not len(asked) or not len(given):
            return target.empty_table()
        ids, vectors = matrix(given)
        query_ids, rows = matrix(asked)
        return pa.Table.from_arrays([pa.array(c) for c in best_of_block(rows, query_ids, vectors, ids, k)], schema=target)

    found = left.groupBy("strip", "block", "dim").cogroup(right.groupBy("strip", "block", "dim")).applyInArrow(tiles, FOUND)
    final = "query_id bigint, rank int, vec_id bigint, score double"
    out = to_arrow_schema(schema_of(final))

    def merged(rows: pa.Table) -> pa.Table:
        data = zip((-rows.column("score").to_numpy()).tolist(), rows.column("vec_id").to_pylist())
        # each block's rows are in order; a fall of the key starts the next block's
        runs, last = [], None
        for key in data:
            if last is None or key < last:
                runs.append([])
            runs[-1].append(key)
            last = key
        best = list(islice((key for key, _ in groupby(heapq.merge(*runs))), k))
        query = rows.column("query_id")[0].as_py()
        return pa.Table.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(([query] * len(best), range(1, len(best) + 1), [b[1] for b in best], [-b[0] for b in best]), out)],
            schema=out,
        )

    return found.groupBy("query_id").applyInArrow(merged, final)


def op4_nearest(spark, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest(vectors.filter("vec_id % 20 = 0"), vectors)


SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s
)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 20
"""
