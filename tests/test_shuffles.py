"""Shuffle files of finished steps do not pile up."""

import os
import subprocess
import sys

RUN = r"""
import sys, glob, gc
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.local.dir", sys.argv[2]).config("spark.checkpoint.dir", sys.argv[2] + "/shared").getOrCreate())
from rekindle.operators import implicit
from rekindle.session import materialise
held = []
for step in range(3):
    held.append(materialise(spark.range(1000).withColumn("step", F.lit(step)).groupBy(F.col("id") % 7).agg(F.max("step"))))
assert [h.count() for h in held] == [7] * 3
left = len(glob.glob(sys.argv[2] + "/blockmgr-*/*/shuffle_*.data"))
df = spark.range(400).selectExpr("cast(id % 20 as string) userID", "cast(id % 23 as string) itemID", "1.0D + id % 5 as rating")
few, many = [], []
for rounds, out in ((2, few), (12, many)):
    spark.sparkContext._jvm.System.gc()
    before = len(glob.glob(sys.argv[2] + "/blockmgr-*/*/shuffle_*.data"))
    implicit.als(df, 3, rounds)
    out.append(len(glob.glob(sys.argv[2] + "/blockmgr-*/*/shuffle_*.data")) - before)
print("LEFT", left, few[0], many[0])
"""


def test_shuffles_do_not_pile_up(tmp_path):
    """Written tables leave no shuffle behind, and the rounds of ALS no more than a few whatever their number."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", RUN, root, str(tmp_path)], capture_output=True, text=True, timeout=300)
    line = [x for x in out.stdout.splitlines() if x.startswith("LEFT")]
    assert line, out.stderr[-2000:]
    left, few, many = map(int, line[0].split()[1:])
    assert left <= 3  # the counts at the end alone
    assert many <= few + 40


def test_one_file_is_not_one_task(spark):
    """A table written as one file is still computed by as many tasks as it has partitions."""
    import pandas as pd
    from pyspark import TaskContext

    from rekindle.session import materialise

    def work(batches):
        for pdf in batches:
            yield pd.DataFrame({"task": [TaskContext.get().taskAttemptId()] * len(pdf)})

    made = materialise(spark.range(4000).repartition(8).mapInPandas(work, "task bigint"), 1)
    assert made.select("task").distinct().count() == 8
    assert len(made.inputFiles()) == 1


def test_written_steps_get_bounded_arrow_batches(spark):
    """Long texts reach Python a few megabytes at a time, and the session's own setting comes back."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from rekindle.session import ARROW_BYTES, materialise

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "n"])

    before = spark.conf.get(ARROW_BYTES)
    texts = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("x"), 2500).alias("text"))
    got = materialise(texts.mapInArrow(sizes, "bytes long, n long")).agg(F.max("bytes"), F.sum("n")).first()
    assert got[0] <= 5_000_000 and got[1] == 8000, got
    assert spark.conf.get(ARROW_BYTES) == before
