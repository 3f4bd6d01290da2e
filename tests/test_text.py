"""Hand-written cases for cleaning, filters, de-duplication and sentences."""

import pytest
from pyspark.sql import functions as F

from themeloom.functions import arrays, text
from themeloom.operators import dedup, pii, rows, sentences


def apply(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


CLEANING = [
    ("  Hello\r\nworld  ", "Hello world"),
    ("a\n\n\nb", "a b"),
    ("one\rtwo", "onetwo"),
    ("see https://a.example.com/x?q=1 now", "see now"),
    ("go www.example.org/page ok", "go /page ok"),
    ("<p>Hi</p>&amp;bye", " Hi bye"),
    ("A&AMP;B", "AandAMP;B"),
    ("cut <a href=x.. end", "cut end"),
    ("café ‘quoted’", "caf quoted "),
    ("mail joe@x.org today", "mail today"),
    ("10,000 and 3.5 and 12345 and 1234", " and and and 1234"),
    ("call 020 7946 now", "call now"),
    ("at SW1A 1AA today", "at today"),
    ("lives in SW1A", "lives in "),
    ("lives in sw1a", "lives in sw1a"),
    ("wait!!! what?!", "wait! what?"),
    ('He said "no".', 'He said "no"'),
    ("R&D", "RandD"),
    ("", ""),
    (None, None),
    ("x y", "x y"),
]


def test_cleaning_cases(spark):
    assert apply(spark, text.clean, [a for a, _ in CLEANING]) == [b for _, b in CLEANING]


def test_cleaning_long_junk_is_fast_enough(spark):
    long_url = "http://" + "a" * 200_000
    assert apply(spark, text.clean, [long_url, "x" * 200_000]) == [" ", "x" * 200_000]


def test_custom_patterns_and_marks(spark):
    assert apply(spark, lambda c: text.remove_patterns(c, ["b+", "c"]), [" abbbcd  e "]) == ["a d e"]
    # classes cover all of Unicode, in the patterns and in the white space that is collapsed
    assert apply(spark, lambda c: text.remove_patterns(c, [r"\w+"]), ["été, x"]) == [" , "]
    assert apply(spark, lambda c: text.remove_patterns(c, ["q"]), ["a\u00a0\u00a0b"]) == ["a b"]
    assert apply(spark, text.plain_marks, ["‘a’ “b” – — … •"]) == ["'a' \"b\" - - ... *"]
    assert apply(spark, text.nfkc, ["ﬁ…", None]) == ["fi...", None]
    assert apply(spark, text.split_hyphens, ["well-known state-of-the-art"]) == ["well known  state of the art "]


def test_tokens_and_labels(spark):
    assert apply(spark, lambda c: text.tokens_without_punctuation(text.white_space_tokens(c)), ["it's -- ok!"]) == [["its", "ok"]]
    assert apply(spark, lambda c: text.alphabetic_lower_tokens(text.white_space_tokens(c)), ["Ab c1 Éa x-y"]) == [["ab", "éa"]]
    assert apply(spark, lambda c: text.long_tokens(text.white_space_tokens(c)), ["abc abcd"]) == [["abcd"]]
    words = " ".join(f"w{i}" for i in range(45))
    wrapped = apply(spark, text.wrap_words, [words, "", None])
    assert wrapped[0].count("<br>") == 3 and wrapped[0].endswith("w44<br>") and wrapped[1:] == ["", None]
    assert apply(spark, text.wrap_words, [" ".join(["a"] * 301)])[0].count("a") == 300
    assert apply(spark, text.short_label, ["x" * 29, "x" * 30]) == ["x" * 29, "x" * 27 + "..."]
    assert apply(spark, text.clean_generated_label, ['Topic: "Eat-ing", don\'t!', None]) == ["Topic Eat-ing don't", ""]
    assert apply(spark, text.first_line, ["a\nb", "a"]) == ["a", "a"]
    assert apply(spark, lambda c: text.ngrams(F.split(c, " ")), ["a b c", "a"]) == [["a", "b", "c", "a b", "b c"], ["a"]]
    assert apply(spark, text.tokens, ["It's a Ünï x1 y"]) == [["it", "ünï", "x1"]]


def test_length_filters(spark):
    df = spark.createDataFrame([(49, "x" * 49), (50, "x" * 50), (51, " " + "x" * 50), (0, None)], "i int, v string")
    assert sorted(r["i"] for r in rows.at_least_length(df, "v").collect()) == [50, 51]
    df = spark.createDataFrame([("abcde",), ("abcdef",), ("  abc  ",)], "v string")
    assert sorted(r["v"] for r in rows.longer_than(df, "v").collect()) == ["abc", "abcdef"]


def test_copies(spark):
    df = spark.createDataFrame(list(enumerate("abacba", 1)), "i int, v string")
    ids = lambda d: sorted(r["i"] for r in d.collect())
    assert ids(dedup.keep_first(df, "v", "i")) == [1, 2, 4]
    assert ids(dedup.later_copies(df, "v", "i")) == [3, 5, 6]
    assert ids(dedup.keep_unrepeated(df, "v", "i")) == [4]
    assert ids(dedup.repeated_ids(df, "v", "i")) == [1, 2, 3, 5, 6]


def test_hot_copy_group_stays_one_row(spark):
    df = spark.range(30_000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("v"))
    assert dedup.keep_first(df, "v", "i").count() == 20_001
    assert dedup.later_copies(df, "v", "i").count() == 9_999


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    found = {r["k"]: r["n"] for r in rows.number_rows(df, ["k"], "n").collect()}
    assert [found[k] for k in sorted(found)] == list(range(1000))
    with pytest.raises(ValueError):
        rows.add_row_id(df)


def test_sentences(spark):
    value = 'Dr. Smith came. He said "No!" Then he left at 3.30 p.m. today. ok? Yes.'
    df = spark.createDataFrame([(1, value), (2, ""), (3, None)], "document_index long, v string")
    got = [r["v"] for r in sentences.split_sentences(df, "v").orderBy("sentence_pos").collect()]
    assert got == ["Dr. Smith came.", 'He said "No!"', "Then he left at 3.30 p.m. today. ok?", "Yes."]
    more = [r["v"] for r in sentences.split_sentences(df, "v", delimiters=["ok?", "came."]).collect()]
    assert len(more) == 4


def spans_of(spark, value, entities=None):
    df = spark.createDataFrame([(value,)], "v string").select(pii.resolve(pii.spans(F.col("v"), entities)).alias("s"))
    return [(s["entity"], value[s["start"]:s["end"]]) for s in df.first()["s"]]


def test_spans_and_check_digits(spark):
    value = "Mr X: joe@x.org, 10.0.0.1, 4111 1111 1111 1111, 4111 1111 1111 1112, 943-476-5919, (743) 555-3824 on 2020-01-02"
    found = spans_of(spark, value)
    assert ("TITLE", "Mr") in found and ("EMAIL_ADDRESS", "joe@x.org") in found and ("IP_ADDRESS", "10.0.0.1") in found
    assert ("CREDIT_CARD", "4111 1111 1111 1111") in found and ("CREDIT_CARD", "4111 1111 1111 1112") not in found
    assert ("UK_NHS", "943-476-5919") in found and ("PHONE_NUMBER", "(743) 555-3824") in found
    assert ("DATE_TIME", "2020-01-02") in found


def brute_resolve(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[1] - s[2], -s[3], s[1], s[0])):
        if all(s[2] <= k[1] or k[2] <= s[1] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[1])


def test_overlaps_resolve_as_by_hand(spark):
    import random

    rng = random.Random(4)
    cases = []
    for _ in range(60):
        case = []
        for _ in range(rng.randint(0, 8)):
            start = rng.randint(0, 30)
            case.append((rng.choice("ABC"), start, start + rng.randint(1, 10), rng.choice([0.4, 0.6, 1.0])))
        cases.append(case)
    df = spark.createDataFrame(list(enumerate(cases)), f"i int, s {pii.SPANS}").select("i", pii.resolve(F.col("s")).alias("s"))
    for r in df.collect():
        assert [tuple(s) for s in r["s"]] == brute_resolve(cases[r["i"]])


def test_strategies(spark):
    df = spark.createDataFrame([(1, "Mr Smith met Mrs Jones"), (2, None), (3, "nothing here")], "i int, v string")
    out = lambda strategy, **k: [r["v"] for r in pii.anonymise(df, ["v"], strategy, entities=["TITLE"], **k).orderBy("i").collect()]
    assert out("redact") == [" Smith met  Jones", None, "nothing here"]
    assert out("replace")[0] == "<TITLE> Smith met <TITLE> Jones"
    assert out("mask")[0] == "** Smith met *** Jones"
    assert len(out("hash")[0]) == len(" Smith met  Jones") + 128
    assert out("encrypt", key=bytes(16))[0] == "<TITLE> Smith met <TITLE> Jones"
    with pytest.raises(ValueError):
        out("encrypt", key=b"short")


def test_long_mask_keeps_the_start(spark):
    long_mail = "a" * 60 + "@" + "b" * 60 + ".org"
    df = spark.createDataFrame([(long_mail,)], "v string")
    got = pii.anonymise(df, ["v"], "mask", entities=["EMAIL_ADDRESS"]).first()["v"]
    assert got == long_mail[: len(long_mail) - 100] + "*" * 100


def test_scan_record_paths(spark):
    df = spark.sql("SELECT 1L AS doc_id, struct('a@b.org' AS x, 10 AS y) AS s, array('1.2.3.4', null) AS a, map('k', 'q@r.com', 'z', 'v@w.com') AS m,"
                   " array(struct('n@m.org' AS mail)) AS deep, 5 AS plain")
    found = {r["path"]: [s["entity"] for s in r["spans"]] for r in pii.scan_record(df, skip=["m.z"]).collect()}
    assert found == {"s.x": ["EMAIL_ADDRESS"], "s.y": [], "a[0]": ["IP_ADDRESS"], "m.k": ["EMAIL_ADDRESS"],
                     "deep[0].mail": ["EMAIL_ADDRESS"], "plain": []}


def test_vector_compression(spark):
    df = spark.createDataFrame([([0.12345],)], "v array<double>")
    small = df.select(arrays.compress(F.col("v")).alias("v"), F.lit(100.0).alias("s"))
    assert abs(small.first()["v"][0] - 12.3) < 1e-9
    assert abs(small.select(arrays.rescale(F.col("v"), F.col("s")).alias("v")).first()["v"][0] - 0.123) < 1e-9
