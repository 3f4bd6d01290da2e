"""Shuffle files of finished steps."""

import os
import time

from pyspark.sql import SparkSession, functions as F

from themeloom.session import store


def test_a_large_stored_table_leaves_no_shuffle_files(spark: SparkSession):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    size = lambda: sum(os.path.getsize(f"{d}/{f}") for top in folders for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data"))
    before = size()
    found = store(spark.range(400_000).select(F.sha2(F.col("id").cast("string"), 256).alias("x")).repartition(4, "x"), large=True)
    left = [size()]
    while left[-1] - before > 1_000_000 and len(left) < 40:
        time.sleep(0.25)
        left.append(size())
    assert left[-1] - before <= 1_000_000 and found.count() == 400_000
