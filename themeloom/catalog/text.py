"""Rows, cleaning, de-duplication and sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom.catalog.registry import (
    CLASS_DOCUMENTS, LABELLED, TEXTS, class_documents, documents, labelled_vectors, query, quoted, table, texts,
)
from themeloom.functions import text
from themeloom.operators import dedup, rows, sentences

TRIM = r"'^[\s\x0b\x85\p{Z}]+|[\s\x0b\x85\p{Z}]+$'"
WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
BREAK = r"[\s\x0b\x85\p{Z}]+"


def trimmed(value: str) -> str:
    return f"regexp_replace({value}, {TRIM}, '', 'g')"


# The cleaning patterns in RE2 form: (name, pattern, replacement).
RE2_STEPS = (
    ("C2", r"(\r\n|\n)+", "  "),
    ("C3", r"\r", ""),
    ("C4", r"https?://[a-z!$-_]+|www\.[a-zA-Z0-9._-]+\.[a-zA-Z]{2,}", " "),
    ("C5", r"<[^>\n]*>|&([a-z0-9]+|#[0-9]{1,6}|#x[0-9a-f]{1,6});|\x{00A0}|&nbsp;", " "),
    ("C6", r"<[^\n]*?\.\.", " "),
    ("C7", r"[^\x00-\x7F]+", " "),
    ("C8", r"\S*@\S*\s?", " "),
    ("C9", r"\b\d+[.|,]\d+\b|\b[0-9]{5,}\b|\b[0-9]+\s[0-9]+\b", " "),
    ("C10", r"\b[A-Z][A-HJ-Y]?[0-9][0-9A-Z]? ?[0-9][A-Z]{2}|GIR ?0A{2}\b\z"
            r"|[A-Z][A-HJ-Y]?[0-9][0-9A-Z]? ?[0-9]\z|\b[A-Z][A-HJ-Y]?[0-9][0-9A-Z]?\b\z", " "),
    ("C11", r"\s{2,}", " "),
    ("C12", r"(\p{P})\p{P}+", r"\1"),
    ("C13", "&", "and"),
)


def cleaned(value: str) -> str:
    out = trimmed(value)
    for _, pattern, put in RE2_STEPS:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(put)}, 'g')"
    return out


def _text_step(key: str, expression, sql: str) -> None:
    """A query that applies one expression to every text of the given tables."""

    @query(key, f"WITH {TEXTS} SELECT id, {sql} AS out FROM texts")
    def run(spark, folder):
        return texts(spark, folder).select("id", expression(F.col("text")).alias("out"))


@query("P1_row_id", "SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS original_index FROM documents")
def _(spark, folder):
    return rows.add_row_id(documents(spark, folder).select("doc_id", "n_chars"), ["doc_id"])


@query("P2_renumber_after_filter", """SELECT doc_id AS original_index, text,
  row_number() OVER (ORDER BY doc_id) - 1 AS document_index FROM documents WHERE lang <> 'en'""")
def _(spark, folder):
    kept = documents(spark, folder).filter("lang <> 'en'").select(F.col("doc_id").alias("original_index"), "text")
    return rows.renumber(kept)


@query("P3_replace_columns", "SELECT doc_id, lower(text) AS text, upper(lang) AS lang, source, n_chars FROM documents")
def _(spark, folder):
    return rows.with_columns(documents(spark, folder), {"text": F.lower("text"), "lang": F.upper("lang")})


@query("P5_minimum_length", f"WITH {TEXTS}, s AS (SELECT id, {trimmed('text')} AS text FROM texts) SELECT id, text FROM s WHERE length(text) >= 50")
def _(spark, folder):
    return rows.at_least_length(texts(spark, folder), "text")


@query("P6_longer_than", f"WITH {TEXTS} SELECT id, {trimmed('text')} AS text FROM texts WHERE length(text) > 5")
def _(spark, folder):
    return rows.longer_than(texts(spark, folder), "text")


@query("P7_drop_null", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def _(spark, folder):
    joined = documents(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    return rows.drop_null(joined.select("doc_id", "quality"), "quality")


@query("P8_drop_blank", f"WITH {TEXTS}, s AS (SELECT id, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM texts) SELECT id, digits FROM s WHERE digits <> ''")
def _(spark, folder):
    digits = texts(spark, folder).select("id", F.regexp_replace("text", "[^0-9]", "").alias("digits"))
    return rows.drop_blank(digits, "digits")


@query("P9_label_text", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, folder):
    joined = documents(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    return joined.select("doc_id", rows.as_label_text(F.col("quality")).alias("label"))


@query("P10_existing_columns", "SELECT doc_id, source FROM documents")
def _(spark, folder):
    return rows.keep_existing(documents(spark, folder), ["doc_id", "probability", "source", "name"])


@query("P11_topic_list", f"WITH {LABELLED} SELECT doc_id, topic FROM emb WHERE topic IN (1, 3, 5)")
def _(spark, folder):
    return rows.in_topics(labelled_vectors(spark, folder).select("doc_id", "topic"), [1, 3, 5])


@query("P11_topic_table", f"""WITH {CLASS_DOCUMENTS}, big AS (SELECT topic FROM docs GROUP BY topic
  HAVING sum(length(text)) > 100000) SELECT doc_id, topic FROM docs WHERE topic IN (SELECT topic FROM big)""")
def _(spark, folder):
    docs = class_documents(spark, folder)
    big = docs.groupBy("topic").agg(F.sum(F.length("text")).alias("chars")).filter("chars > 100000")
    return rows.in_topics(docs.select("doc_id", "topic"), big)


@query("P12_without_outliers", f"WITH {LABELLED} SELECT doc_id, topic FROM emb WHERE topic <> -1")
def _(spark, folder):
    return rows.without_outliers(labelled_vectors(spark, folder).select("doc_id", "topic"))


@query("P13_with_coordinates", f"""WITH {LABELLED}, p AS (SELECT doc_id, CASE WHEN topic <> -1 THEN vector[1] END AS x,
  CASE WHEN vector[2] > 0 THEN vector[2] END AS y FROM emb) SELECT doc_id, round(x, 6) AS x, round(y, 6) AS y FROM p WHERE x IS NOT NULL AND y IS NOT NULL""")
def _(spark, folder):
    v = labelled_vectors(spark, folder)
    x = F.when(F.col("topic") != -1, F.col("vector")[0].cast("double"))
    y = F.when(F.col("vector")[1] > 0, F.col("vector")[1].cast("double"))
    points = v.select("doc_id", x.alias("x"), y.alias("y"))
    return rows.with_coordinates(points).select("doc_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("P14_columns_by_name", f"WITH {LABELLED} SELECT topic, topic % 3 AS level_1, topic % 2 AS level_2 FROM emb")
def _(spark, folder):
    v = labelled_vectors(spark, folder)
    return rows.columns_like(v.select("doc_id", "topic", (F.col("topic") % 3).alias("level_1"), (F.col("topic") % 2).alias("level_2")))


_STEP_NAMES = {
    "C2": "newlines_to_spaces", "C3": "carriage_returns", "C4": "urls", "C5": "html", "C6": "cut_off_tags",
    "C7": "non_ascii", "C8": "emails", "C9": "numbers", "C10": "postcodes", "C11": "spaces",
    "C12": "punctuation_runs", "C13": "ampersands",
}
_text_step("C1_strip", text.strip, trimmed("text"))
for (_op, _pattern, _put), _function in zip(RE2_STEPS, text.CLEANING_STEPS[1:]):
    _text_step(f"{_op}_{_STEP_NAMES[_op]}", _function, f"regexp_replace(text, {quoted(_pattern)}, {quoted(_put)}, 'g')")
_text_step("C14_all_cleaning_steps", text.clean, cleaned("text"))

_PATTERNS = (r"[0-9]+", r"[#$%&*]{2,}", "the ")
_sql = trimmed("text")
for _pattern in _PATTERNS:
    _sql = f"regexp_replace({_sql}, {quoted(_pattern)}, ' ', 'g')"
_text_step("C15_custom_patterns", lambda c: text.remove_patterns(c, _PATTERNS), f"regexp_replace({_sql}, '\\s{{2,}}', ' ', 'g')")

_sql = "text"
for _mark, _plain in text.SMART_MARKS.items():
    _sql = f"replace({_sql}, {quoted(_mark)}, {quoted(_plain)})"
_text_step("C16_plain_marks", text.plain_marks, _sql)


@query("C16_nfkc")
def _(spark, folder):
    return texts(spark, folder).select("id", text.nfkc(F.col("text")).alias("out"))


_text_step("C17_split_hyphens", text.split_hyphens,
           f"regexp_replace(text, '({WORD}+)-({WORD}+)-?({WORD})?', '\\1 \\2 \\3', 'g')")

SPLIT = f"list_filter(string_split_regex(text, '{BREAK}'), lambda w: w <> '')"
_ASCII_MARKS = quoted(r"""[!-/:-@\[-`{-~]""")
_text_step("C18_tokens_without_punctuation",
           lambda c: F.array_join(text.tokens_without_punctuation(text.white_space_tokens(c)), " "),
           f"array_to_string(list_filter(list_transform({SPLIT}, lambda w: regexp_replace(w, {_ASCII_MARKS}, '', 'g')), lambda w: w <> ''), ' ')")
_text_step("C19_alphabetic_lower_tokens",
           lambda c: F.array_join(text.alphabetic_lower_tokens(text.white_space_tokens(c)), " "),
           f"array_to_string(list_transform(list_filter({SPLIT}, lambda w: regexp_matches(w, '^\\p{{L}}+\\z')), lambda w: lower(w)), ' ')")
_text_step("C20_long_tokens", lambda c: F.array_join(text.long_tokens(text.white_space_tokens(c)), " "),
           f"array_to_string(list_filter({SPLIT}, lambda w: length(w) > 3), ' ')")
_text_step("C21_lower", F.lower, "lower(text)")
_text_step("C22_wrap_words", text.wrap_words,
           f"""array_to_string(list_transform(range(0, CAST(ceil(len({SPLIT}[1:300]) / 20.0) AS BIGINT)),
           lambda i: array_to_string({SPLIT}[1:300][i * 20 + 1 : i * 20 + 20], ' ') || '<br>'), '')""")
_text_step("C23_cut_label", text.cut_label, "substring(text, 1, 60)")
_text_step("C24_short_label", text.short_label,
           "CASE WHEN length(text) < 30 THEN text ELSE substring(text, 1, 27) || '...' END")
_text_step("C25_cut_words", lambda c: F.array_join(text.cut_words(text.white_space_tokens(c)), " "),
           f"array_to_string(list_transform({SPLIT}, lambda w: substring(w, 1, 20)), ' ')")
_text_step("C26_generated_label", text.clean_generated_label,
           "coalesce(" + trimmed(r"regexp_replace(regexp_replace(text, '[^a-zA-Z0-9\s\x0b\x85\p{Z}''-]', '', 'g'), '[\s\x0b\x85\p{Z}]+', ' ', 'g')") + ", '')")
_text_step("C27_first_line", text.first_line, "split_part(text, chr(10), 1)")


@query("D1_keep_first_copy", """SELECT doc_id, text, lang, source, n_chars FROM (SELECT *,
  row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def _(spark, folder):
    return dedup.keep_first(documents(spark, folder), "text", "doc_id")


@query("D2_prepare", f"""WITH s AS (SELECT doc_id, {trimmed('text')} AS text FROM documents)
  SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM s
  WHERE length(text) >= 50) WHERE rn = 1 AND text IS NOT NULL""")
def _(spark, folder):
    return dedup.prepare(documents(spark, folder).select("doc_id", "text"), "text", "doc_id")


@query("D3_later_copies", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn > 1")
def _(spark, folder):
    return dedup.later_copies(documents(spark, folder), "text", "doc_id")


@query("D4_keep_unrepeated", "SELECT doc_id, text FROM (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n = 1 AND text <> ''")
def _(spark, folder):
    return dedup.keep_unrepeated(documents(spark, folder).select("doc_id", "text"), "text", "doc_id")


@query("D4_repeated_ids", "SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1")
def _(spark, folder):
    return dedup.repeated_ids(documents(spark, folder), "text", "doc_id")


@query("D5_one_row_per_topic", f"WITH {LABELLED} SELECT DISTINCT topic, 'topic ' || topic AS name FROM emb")
def _(spark, folder):
    v = labelled_vectors(spark, folder)
    return dedup.one_per_topic(v.select("topic", F.concat(F.lit("topic "), F.col("topic").cast("string")).alias("name")))


_SHORT = "|".join(sentences.ABBREVIATIONS)


def sentences_sql(source: str = "documents", key: str = "doc_id", delimiters: str = "") -> str:
    """Sentences by marking the boundaries with private-use characters."""
    held = f"regexp_replace(text, '\\b({_SHORT})\\.', '\\1\ue001', 'g')"
    rule = r"""([.!?]["'')\]]{0,4})\s+(["''(\[]{0,4}\p{Lu})"""
    marked = f"regexp_replace({held}, '{rule}', '\\1\ue000\\2', 'g')"
    if delimiters:
        marked = f"regexp_replace({marked}, '([{delimiters}])\\s+', '\\1\ue000', 'g')"
    parts = f"string_split({marked}, '\ue000')"
    return f"""split AS (SELECT {key}, CAST(generate_subscripts(p, 1) - 1 AS INT) AS sentence_pos,
      replace(unnest(p), '\ue001', '.') AS text FROM (SELECT {key}, {parts} AS p FROM {source})),
    sent AS (SELECT {key}, sentence_pos, text FROM split WHERE text <> '')"""


def _numbered(spark, folder):
    return documents(spark, folder).select(F.col("doc_id").alias("document_index"), "text")


@query("U1_split_sentences", f"WITH {sentences_sql()} SELECT doc_id AS original_index, doc_id AS document_index, sentence_pos, text FROM sent")
def _(spark, folder):
    return sentences.split_sentences(_numbered(spark, folder).withColumn("original_index", F.col("document_index")), "text")


@query("U2_custom_delimiters", f"WITH {sentences_sql(delimiters=';,')} SELECT doc_id AS document_index, sentence_pos, text FROM sent")
def _(spark, folder):
    return sentences.split_sentences(_numbered(spark, folder), "text", delimiters=[";", ","])


@query("U3_sentence_table", f"""WITH {sentences_sql()} SELECT doc_id AS document_index, sentence_pos, {trimmed('text')} AS text,
  row_number() OVER (ORDER BY doc_id, sentence_pos) - 1 AS sentence_index FROM sent WHERE length(text) > 5""")
def _(spark, folder):
    return sentences.sentence_table(_numbered(spark, folder), "text")
