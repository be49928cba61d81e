"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id bigint, text string), null text as empty; all other columns go, whatever their names."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str) -> DataFrame:
    """``mapInArrow`` whose state is made once per task: ``make()`` returns batch -> column dicts.

    ``schema`` is a DDL string. Each dict holds one list or array per output column. ``make`` may return a
    second function, which gives the last column dicts after all batches.
    """
    target = to_arrow_schema(_parse_datatype_string(schema))

    def rows(out):
        return pa.RecordBatch.from_arrays([as_arrow(out[f.name], f.type) for f in target], schema=target)

    def run(batches):
        made = make()
        work, end = made if isinstance(made, tuple) else (made, None)
        for batch in batches:
            for out in work(batch):
                yield rows(out)
        if end:
            for out in end():
                yield rows(out)

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """Batches of ``df`` to batches of the same columns; ``make()`` is called once per task."""

    def run(batches):
        work = make()
        for batch in batches:
            yield work(batch)

    return df.mapInArrow(run, df.schema)


def with_texts(batch: pa.RecordBatch, texts: list[str | None], text_col: str = "text", chars_col: str = "n_chars") -> pa.RecordBatch:
    """``batch`` with new texts and, if it has that column, their lengths in code points."""
    new = {text_col: texts, chars_col: [None if t is None else len(t) for t in texts]}
    arrays = [pa.array(new[f.name], type=f.type) if f.name in new else batch.column(i) for i, f in enumerate(batch.schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)


def small_enough(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` hinted for a broadcast if its counted rows (a few numbers each) are few, else unchanged."""
    return F.broadcast(df) if df.count() <= rows else df


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def pieces_of(texts: list[str], limit: int = 2_000_000) -> Iterator[slice]:
    """Slices of ``texts`` with at most ``limit`` characters each (or one text)."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every (start, length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def sha_hex(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)
