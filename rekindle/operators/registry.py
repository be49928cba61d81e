"""Versioned models as append-only event tables."""

from __future__ import annotations

import hashlib
import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "seq bigint, event string, model_id string, algorithm string, version int, metrics map<string,double>, "
    "params map<string,string>, is_implicit boolean, created_at double, path string, notes string, tags array<string>"
)


def model_states(events: DataFrame) -> DataFrame:
    """Current models from their ``saved``, ``promoted`` and ``deleted`` events.

    The newest promotion of an algorithm that was not deleted later is the promoted model.
    """
    by_model = events.groupBy("model_id").agg(
        F.max(F.when(F.col("event") == "deleted", F.col("seq"))).alias("_deleted"),
        F.max(F.when(F.col("event") == "promoted", F.col("seq"))).alias("_promoted"),
    )
    saved = events.filter(F.col("event") == "saved").join(by_model, "model_id").withColumn(
        "_top", F.max("_promoted").over(Window.partitionBy("algorithm"))
    )
    alive = saved.filter(F.col("_deleted").isNull())
    return alive.withColumn("promoted", F.coalesce(F.col("_promoted") == F.col("_top"), F.lit(False))).drop(
        "event", "_deleted", "_promoted", "_top"
    )


def newest_first(models: DataFrame, algorithm: str | None = None, promoted_only: bool = False) -> DataFrame:
    out = models.filter(F.col("algorithm") == algorithm) if algorithm else models
    out = out.filter("promoted") if promoted_only else out
    return out.orderBy(F.col("created_at").desc(), F.col("seq").desc())


def latest(models: DataFrame) -> DataFrame:
    """Newest model of each algorithm."""
    w = Window.partitionBy("algorithm").orderBy(F.col("created_at").desc(), F.col("seq").desc())
    return models.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def option_order(options: DataFrame) -> DataFrame:
    """Eligible first, then promoted, rank, metric (RMSE ascending, others descending), name."""
    metric = F.when(F.col("metric_name") == "RMSE", F.col("metric_value")).otherwise(-F.col("metric_value"))
    return options.orderBy(
        F.col("recommendation_eligible").desc(), F.col("promoted").desc(), F.col("rank").asc_nulls_last(),
        metric.asc_nulls_last(), F.col("algorithm").asc(),
    )


class ModelRegistry:
    """Event log and model tables under one shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    @property
    def _log(self) -> str:
        return f"{self.folder}/events"

    def events(self) -> DataFrame:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._log)
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(path):
            return self.spark.createDataFrame([], EVENT_SCHEMA)
        return self.spark.read.schema(EVENT_SCHEMA).parquet(self._log)

    def models(self) -> DataFrame:
        return model_states(self.events())

    def _claim(self, kind: str, number: int) -> int:
        """The first free number from ``number`` on; the storage creates each claim's file once, so no two writers get the same."""
        jvm = self.spark._jvm
        while True:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/claims/{kind}/{number}")
            fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
            try:
                if fs.getScheme() == "file":  # Hadoop's local files are checked before they are created, which is two steps
                    place = fs.makeQualified(path).toUri().getPath()
                    os.makedirs(os.path.dirname(place), exist_ok=True)
                    os.close(os.open(place, os.O_CREAT | os.O_EXCL))
                else:
                    fs.create(path, False).close()
                return number
            except FileExistsError:
                number += 1
            except Py4JJavaError:
                if not fs.exists(path):
                    raise
                number += 1

    def _append(self, **row) -> None:
        names = [part.split()[0] for part in EVENT_SCHEMA.split(", ")]
        seq = self._claim("seq", self.events().agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).first()[0])
        values = tuple(seq if n == "seq" else row.get(n) for n in names)
        self.spark.createDataFrame([values], EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(self._log)

    def save(self, algorithm: str, tables: dict[str, DataFrame], metrics: dict | None = None,
             params: dict | None = None, is_implicit: bool = False, notes: str = "", tags: list | None = None,
             partitions: dict[str, str] | None = None) -> str:
        """Write the model's tables and log it under the next version of its algorithm.

        ``partitions`` names the column by which a table is laid out in folders. The log entry comes last: a model whose writing was
        broken off is never listed.
        """
        model_id = uuid.uuid4().hex[:12]
        top = self.models().filter(F.col("algorithm") == algorithm).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        path = f"{self.folder}/models/{model_id}"
        for name, df in tables.items():
            column = (partitions or {}).get(name)
            if column:
                df.repartition(F.col(column)).write.partitionBy(column).parquet(f"{path}/{name}")
            else:
                df.write.parquet(f"{path}/{name}")
        version = self._claim(f"version-{hashlib.md5(algorithm.encode()).hexdigest()}", top + 1)
        self._append(
            event="saved", model_id=model_id, algorithm=algorithm, version=version,
            metrics={k: float(v) for k, v in (metrics or {}).items() if v is not None},
            params={k: str(v) for k, v in (params or {}).items()}, is_implicit=is_implicit,
            created_at=time.time(), path=path, notes=notes, tags=tags or [],
        )
        return model_id

    def get(self, model_id: str):
        row = self.models().filter(F.col("model_id") == model_id).first()
        if row is None:
            raise KeyError(f"Model ID '{model_id}' not found in registry.")
        return row

    def table_names(self, model_id: str) -> list[str]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.get(model_id)["path"])
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return sorted(s.getPath().getName() for s in fs.listStatus(path))

    def load(self, model_id: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.get(model_id)['path']}/{table}")

    def promote(self, model_id: str) -> None:
        self._append(event="promoted", model_id=model_id, algorithm=self.get(model_id)["algorithm"])

    def delete(self, model_id: str) -> None:
        self._append(event="deleted", model_id=model_id, algorithm=self.get(model_id)["algorithm"])

    def promoted(self, algorithm: str):
        return newest_first(self.models(), algorithm, True).first()

    def best_promoted(self, last_best: str | None = None, algorithm: str | None = None):
        """The last best model if still promoted, else its algorithm's promoted one, else the newest."""
        models = self.models().filter("promoted")
        preferred = F.when(F.col("model_id") == F.lit(last_best), 0).when(F.col("algorithm") == F.lit(algorithm), 1).otherwise(2)
        return models.orderBy(preferred, F.col("created_at").desc()).first()
