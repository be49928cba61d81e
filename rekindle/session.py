"""Materialising intermediate tables, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

BROADCAST_BYTES = 128 * 1024 * 1024
FILE_COMPRESSION = 4
PARTITION_BYTES = 64 * 1024 * 1024
ARROW_BATCH = "4m"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the cluster names, or a temporary one in local mode."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="rekindle-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_shipped_to: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in tasks are pickled by reference, so workers outside the repository need the modules.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped_to:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="rekindle-"), "rekindle.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped_to.add(app)


@contextmanager
def conf_of(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for a while; those set before come back."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialise(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy has no lineage, survives lost executors and has exact size statistics, so later
    joins get their strategy from the real size.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/rekindle/{uuid.uuid4().hex}"
    # a shuffle of the result alone: coalesce would put the work before it into as few tasks
    out = df.repartition(partitions) if partitions else df
    # nothing reads the shuffles of this write again; without this they stay on disk until the driver collects garbage
    # and Arrow batches of whole texts count several times: in the JVM, in its buffer, in Python and as Python's strings
    with conf_of(spark, {SHUFFLE_CLEANUP: "true", ARROW_BYTES: ARROW_BATCH}):
        out.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._rekindle_path = path
    return back


def discard(df: DataFrame | None) -> None:
    """Delete a table written by :func:`materialise` once a later one replaces it."""
    path = getattr(df, "_rekindle_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def size_in_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate; a scan of a materialised table counts with its files, hence the factor."""
    return FILE_COMPRESSION * int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the measured size allows it, otherwise leave a shuffle join."""
    return F.broadcast(df) if size_in_bytes(df) <= limit else df


def task_count(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts_for(df: DataFrame) -> int:
    """Partitions for a shuffle of a written table that keep what one task sorts bounded, whatever the session's number."""
    return max(task_count(df.sparkSession), -(-size_in_bytes(df) // PARTITION_BYTES))


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small driver-side table whose size the optimizer knows (an RDD-backed one would count as huge)."""
    names = [part.split()[0] for part in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    target = to_arrow_schema(_parse_datatype_string(schema))
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, target)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=target))


class HeavyKeys:
    """Keys that hold more than 1/H of a table's rows, found on first use and kept for later joins.

    There are at most H of them per column, which bounds their broadcast.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self.found: dict[str, DataFrame] = {}

    def of(self, key: str) -> DataFrame:
        if key not in self.found:
            parts = task_count(self.df.sparkSession)
            counts = self.df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
            total = counts.agg(F.sum("_n").alias("_all"))
            hot = counts.crossJoin(F.broadcast(total)).filter(F.col("_n") * parts > F.col("_all"))  # one row
            salts = F.ceil(F.col("_n") * (2 * parts) / F.col("_all")).cast("int")
            self.found[key] = materialise(hot.select(key, salts.alias("_salts")), 1)
        return self.found[key]


def skew_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner",
              heavy: HeavyKeys | None = None, size: int | None = None) -> DataFrame:
    """Join on ``key`` when ``big`` may hold most of its rows under a few keys and ``small`` has few rows per key.

    A ``small`` of checked size is broadcast. Otherwise the rows of heavy keys in ``big`` are spread
    over salts, and only those keys of ``small`` are repeated, once per salt. ``size`` is the byte
    size of ``small`` where the caller has counted it.
    """
    if (size_in_bytes(small) if size is None else size) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), key, how)
    hot = (heavy or HeavyKeys(big)).of(key)
    rest = [c for c in big.columns if c != key]
    salt = F.pmod(F.xxhash64(*rest), F.col("_salts")).cast("int")
    spread = big.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(salt, F.lit(0)))
    copies = small.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    )
    return spread.drop("_salts").join(copies.drop("_salts"), [key, "_salt"], how).drop("_salt")
