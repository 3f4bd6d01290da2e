"""Registration of queries and the shared input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from themeloom.operators.vectors import english_stop_words
from themeloom.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str | Callable[[], str]] = {}


def query(key: str, sql: str | Callable[[], str] | None = None):
    def add(run):
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text) of every text column in the given tables."""
    read = lambda name: table(spark, folder, name)
    key = lambda mark, *c: F.concat(F.lit(mark), F.concat_ws("-", *[F.col(x).cast("string") for x in c])).alias("id")
    every = (
        read("documents").select(key("d", "doc_id"), "text")
        .unionAll(read("pages").select(key("p", "page_id"), F.col("html").alias("text")))
        .unionAll(read("conversations").select(key("c", "conv_id", "turn"), "text"))
        .unionAll(read("benchmark").select(key("b", "item_id"), "text"))
    )
    return spread(every, "id")


TEXTS = """texts AS (
  SELECT 'd' || doc_id AS id, text FROM documents
  UNION ALL SELECT 'p' || page_id, html FROM pages
  UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations
  UNION ALL SELECT 'b' || item_id, text FROM benchmark)"""


def class_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a topic taken from ``source``: src0 is the outlier class."""
    topic = (F.expr("substring(source, 4)").cast("int") - 1).cast("int")
    return documents(spark, folder).select("doc_id", "text", topic.alias("topic"))


CLASS_DOCUMENTS = "docs AS (SELECT doc_id, text, CAST(substr(source, 4) AS INT) - 1 AS topic FROM documents)"


def labelled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with a topic taken from ``label``: 9 is the outlier class."""
    topic = F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label"))
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), topic.cast("int").alias("topic")
    )


LABELLED = """emb AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS vector,
  CAST(CASE WHEN label = 9 THEN -1 ELSE label END AS INT) AS topic FROM embeddings)"""

CENTRES = """centres AS (SELECT topic, list(m ORDER BY pos) AS centre FROM (
  SELECT topic, pos, avg(x) AS m FROM (
    SELECT topic, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM emb WHERE topic <> -1)
  GROUP BY topic, pos) GROUP BY topic)"""


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def stop_list() -> str:
    return ", ".join(quoted(w) for w in english_stop_words())


def topic_tokens_sql(source: str = "docs", keys: str = "doc_id, topic") -> str:
    return f"""tok AS (SELECT {keys}, list_filter(regexp_extract_all(lower(
    regexp_replace(regexp_replace(text, '[\\n\\t]', ' ', 'g'), '[^A-Za-z0-9 ]+', '', 'g')), '\\b\\w\\w+\\b'),
    lambda w: w NOT IN ({stop_list()})) AS a FROM {source}),
  grams AS (SELECT {keys}, unnest(list_concat(a, list_transform(range(1, greatest(len(a), 1)),
    lambda i: a[i] || ' ' || a[i + 1]))) AS term FROM tok)"""


CLASS_COUNTS = lambda: f"""{CLASS_DOCUMENTS}, {topic_tokens_sql()},
  counts AS (SELECT topic, term, count(*) AS n FROM grams GROUP BY topic, term)"""

FACTORS = """totals AS (SELECT topic, sum(n) AS total FROM counts GROUP BY topic),
  mean AS (SELECT floor(avg(total)) AS a FROM totals),
  factors AS (SELECT term, ln(1 + (SELECT a FROM mean) / sum(n)) AS factor FROM counts GROUP BY term)"""

WEIGHTS = """weights AS (SELECT c.topic, c.term, c.n / t.total * f.factor AS weight
  FROM counts c JOIN totals t USING (topic) JOIN factors f USING (term))"""

WORDS = """ranked AS (SELECT topic, term AS word, round(weight, 6) AS score,
    row_number() OVER (PARTITION BY topic ORDER BY round(weight, 6) DESC, term) AS rank FROM weights),
  words AS (SELECT topic, CAST(rank AS INT) AS rank, word, score FROM ranked WHERE rank <= 10)"""
