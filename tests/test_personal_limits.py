"""Personal data past any length, and below every kind of column."""

import random
import re

from pyspark.sql import functions as F

from themeloom.operators import pii

PLAIN = re.compile(pii.ENTITIES["EMAIL_ADDRESS"][0], re.ASCII)


def test_emails_equal_the_plain_pattern():
    rng = random.Random(5)
    for _ in range(40_000):
        text = "".join(rng.choice("aB1@@@...-+% _é") for _ in range(rng.randint(0, 24)))
        assert list(pii._emails(text)) == [m.span() for m in PLAIN.finditer(text)], text
    parts = ["a@b.com", "-x@d.org", "+", "me", "@", ".co", "c.de", " ", "..", "_z", "é"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        assert list(pii._emails(text)) == [m.span() for m in PLAIN.finditer(text)], text


def test_counts_in_the_jvm_equal_the_plain_pattern(spark):
    rng = random.Random(6)
    parts = ["a@b.com", "-x@d.org", "+", "me", "@", ".co", "c.de", " ", "..", "_z"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(3_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in df.select("text", pii.count_by_pattern(F.col("text"), "EMAIL_ADDRESS").alias("n")).collect():
        assert row["n"] == len(PLAIN.findall(row["text"])), row["text"]


def test_long_emails_are_found_in_linear_time(spark):
    long = "x" * 70 + "@" + "sub." * 80 + "example." + "y" * 30
    dotted = "1." * 500_000  # no address; a plain search would try every dot
    df = spark.createDataFrame([(1, f"write to {long} now"), (2, dotted), (3, "a+" * 200_000 + "b@c.de")], "id int, text string")
    out = df.select("id", pii.spans(F.col("text"), ["EMAIL_ADDRESS"]).alias("s"), pii.count_by_pattern(F.col("text"), "EMAIL_ADDRESS").alias("n")).collect()
    got = {r["id"]: ([(s["start"], s["end"]) for s in r["s"]], r["n"]) for r in out}
    assert got == {1: ([(9, 9 + len(long))], 1), 2: ([], 0), 3: ([(0, 400_006)], 1)}


def test_records_below_maps(spark):
    df = spark.createDataFrame(
        [(1, {"k": [{"mail": "a@b.com"}, {"mail": None}], "skip": [{"mail": "c@d.org"}]}, {"o": {"i": "e@f.net"}}, None)],
        "doc_id int, m map<string,array<struct<mail:string>>>, n map<string,map<string,string>>, z map<string,struct<q:string>>",
    )
    found = pii.scan_record(df, "doc_id", ["m.skip"], ["EMAIL_ADDRESS"]).collect()
    assert {(r["path"], len(r["spans"])) for r in found} == {("m.k[0].mail", 1), ("n.o.i", 1)}
    deep = "f" * 12_000
    wide = spark.createDataFrame([(1, [{deep: "a@b.com"}])], "doc_id int, m array<map<string,string>>")
    assert [len(r["path"]) for r in pii.scan_record(wide, "doc_id", (), ["EMAIL_ADDRESS"]).collect()] == [len("m[0].") + 12_000]
