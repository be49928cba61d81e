"""File, database and document sources, and table profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File endings and their formats.
FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".parquet": "parquet"}


def file_format(path: str, requested: str = "auto") -> str:
    if requested != "auto":
        return requested.lower()
    for ending, name in FORMATS.items():
        if path.lower().rstrip("/").endswith(ending):
            return name
    raise ValueError(f"Cannot infer format of '{path}'; pass one of {sorted(set(FORMATS.values()))}")


def read_file(spark: SparkSession, path: str, format: str = "auto", schema=None, multi_line: bool = True) -> DataFrame:
    """CSV with header, JSON, JSON lines, or parquet. With a ``schema`` nothing is read twice.

    ``json`` files hold one array or one record each, over any number of lines; ``jsonl`` files hold a record per
    line and split over tasks. The caller or the file ending says which; no file is guessed from another. CSV fields may hold line breaks; pass ``multi_line=False`` when they do not, so that a large file
    splits over tasks.
    """
    kind = file_format(path, format)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None, multiLine=multi_line, escape='"')
    if kind == "jsonl":
        return reader.json(path)
    if kind == "json":
        return reader.json(path, multiLine=True)
    if kind == "parquet":
        return reader.parquet(path)
    raise ValueError(f"Unsupported format '{kind}'. Choose from: {sorted(set(FORMATS.values()))}")


def read_source(spark: SparkSession, format: str, options: dict[str, str], where: str | None = None) -> DataFrame:
    """Any installed Spark data source (document stores, warehouses) with an optional pushed filter."""
    df = spark.read.format(format).options(**options).load()
    return df.filter(where) if where else df


def read_jdbc(spark: SparkSession, url: str, query: str | None = None, table: str | None = None,
              partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 1,
              properties: dict[str, str] | None = None) -> DataFrame:
    """A database query or table; with a partition column the scan runs in parallel."""
    if (query is None) == (table is None):
        raise ValueError("pass either query or table")
    options = {"url": url, **(properties or {})}
    if partition_column:
        low, high = bounds
        options |= {"partitionColumn": partition_column, "lowerBound": str(low), "upperBound": str(high),
                    "numPartitions": str(partitions),
                    "dbtable": table or f"({query}) q"}
    else:
        options |= {"dbtable": table} if table else {"query": query}
    return read_source(spark, "jdbc", options)


def query_views(spark: SparkSession, statement: str, **params) -> DataFrame:
    """A SQL text with ``:name`` parameters over registered views or catalog tables."""
    return spark.sql(statement, args=params or None)


def interaction_columns(df: DataFrame, user: str, item: str, rating: str | None = None,
                        timestamp: str | None = None, where: str | None = None, limit: int | None = None) -> DataFrame:
    """Projection, filter and limit of an interaction query; all three reach the scan."""
    out = df.filter(where) if where else df
    out = out.select(*[c for c in (user, item, rating, timestamp) if c])
    return out.limit(limit) if limit else out


def list_tables(spark: SparkSession) -> DataFrame:
    return spark.sql("show tables").select(F.col("tableName").alias("table_name"))


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: type, nullability, counts and range, from one aggregate."""
    plain = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]

    def facts(f):
        c = F.col(f"`{f.name}`")
        return F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(f.nullable).alias("nullable"),
            F.count(F.lit(1)).alias("row_count"),
            F.sum(c.isNull().cast("bigint")).alias("null_count"),
            F.count_distinct(c).alias("distinct_count"),
            F.min(c).cast("string").alias("min_value"),
            F.max(c).cast("string").alias("max_value"),
        )

    wide = df.agg(F.array(*[facts(f) for f in plain]).alias("f"))
    return wide.select(F.explode("f").alias("f")).select("f.*")


def sample_values(df: DataFrame, column: str, n: int = 3) -> DataFrame:
    """``n`` non-null values of a column; Spark stops scanning when it has them."""
    return df.select(column).filter(F.col(f"`{column}`").isNotNull()).limit(n)
