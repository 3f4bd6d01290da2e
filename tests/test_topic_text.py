"""Topic text beside Python, and its speed."""

import re
import time

from pyspark.sql import functions as F

from themeloom.functions import text
from themeloom.session import store


def test_topic_text_keeps_ascii_words_only(spark):
    given = ["Añb c\td\ne_f-G 1²3", "Kelvin K ı İ \U0001d400x", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    got = {r["i"]: r["out"] for r in rows.select("i", text.topic_text(F.col("t")).alias("out")).collect()}
    assert got == {i: None if t is None else re.sub("[^A-Za-z0-9 ]+", "", re.sub("[\n\t]", " ", t)) for i, t in enumerate(given)}


def test_topic_text_is_faster_than_written_ranges(spark):
    rows = store(spark.range(160).select(F.repeat(F.lit("Some plain words, and né à-b_c 12 "), 4_000).alias("t")))

    def seconds(column):
        start = time.perf_counter()
        rows.agg(F.sum(F.length(column))).collect()
        return time.perf_counter() - start

    slow = F.regexp_replace(F.col("t"), r"[^A-Za-z0-9 ]+", "")
    seconds(F.col("t")), seconds(text.topic_text(F.col("t")))
    assert seconds(text.topic_text(F.col("t"))) * 2 < seconds(slow)
