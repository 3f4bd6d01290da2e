"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from themeloom.llm import collocations, license_scan, ngram_join, packing, periodic_runs, pseudo_lm, secret_scan, square_packing, topk, toxicity, vector_dedup, wfst, wordpiece
from themeloom.llm.batches import documents, table
from themeloom.session import spread


def secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, folder))
    kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", *[F.size(kind(k)).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.shown(base), 256).alias("base_sha256"), secret_scan.shown(F.col("spans")).alias("spans"),
    )


def toxic(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    labels = table(spark, folder, "labels").select("doc_id", "toxic").filter(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, folder, "embeddings"))


def best_products(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_inner_products(table(spark, folder, "embeddings"))


def licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan(documents(spark, folder))
    covered = F.aggregate("detections", F.lit(0), lambda a, d: a + d["end"] - d["start"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base, own = F.transform("base", lambda b: b["label"]), F.transform("detections", lambda d: d["label"])
    return found.select(
        "doc_id", "n_words", F.aggregate("base", F.lit(0).cast("bigint"), lambda a, b: a + b["count"]).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(0.0).alias("score"),
    )


def likelihood(spark: SparkSession, folder: str) -> DataFrame:
    scored = pseudo_lm.pseudo_likelihood(documents(spark, folder))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return scored.select("*", mean.alias("mean_log_likelihood"))


def jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, folder), 4, Fraction(85, 100))


def packed(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = wfst.encode(documents(spark, folder), path, keep=("doc_id", "text"))
    decoded = wfst.decode(encoded.withColumn("n_ids", F.size("ids").cast("bigint")).withColumn("ids_hash", F.xxhash64("ids")), path, keep=("doc_id", "text", "n_ids", "ids_hash"))
    return decoded.select("doc_id", "n_ids", "ids_hash", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return wordpiece.count_tokens(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


def phrases(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "lang", "text"), "doc_id")
    return collocations.collocations(docs)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, of every tenth with a repeated end; a null id changes nothing."""
    h, n = 0 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def periodic(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find_runs(documents(spark, folder), change=planted)
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", none, lambda a, r: F.when(a.isNull() | more(r, a), r).otherwise(a))
    shown = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[F.col("best")[k].alias(k) for k in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(shown, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def square_packed(spark: SparkSession, folder: str) -> DataFrame:
    pieces = square_packing.pack(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": secrets,
    "op2_toxicity": toxic,
    "op3_vector_near_duplicates": near_vectors,
    "op4_exact_top_k": best_products,
    "op5_license_scans": licenses,
    "op6_pseudo_likelihood": likelihood,
    "op7_ngram_jaccard_join": jaccard,
    "op8_packing": packed,
    "op9_pieces": pieces,
    "op10_token_counts": token_counts,
    "op11_collocations": phrases,
    "op12_periodic_runs": periodic,
    "op13_square_packing": square_packed,
    "pipeline": pipeline,
}

_PHRASES = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS size),
places AS (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM split, sizes WHERE len(w) >= size),
f AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 30),
cuts AS (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.k], ' ')
              JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_sizes AS (SELECT lang, a, w, size, unnest(generate_series(2, size - 1)) AS m FROM candidates),
inner_places AS (SELECT lang, a, w, m, unnest(generate_series(1, size - m + 1)) AS i FROM inner_sizes),
longer AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS whole FROM inner_places GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS "rank", b.phrase, a, l, r, n, score
FROM best b JOIN n USING (lang) LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
WHERE g.whole IS NULL OR 100 * g.whole < 80 * a
QUALIFY "rank" <= 2000
"""

ORACLES: dict[str, str] = {"op11_collocations": _PHRASES}
