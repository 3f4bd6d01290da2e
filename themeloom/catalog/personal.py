"""Personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom.catalog.registry import documents, query, quoted, table
from themeloom.operators import pii
from themeloom.session import scratch_path, store
from themeloom.sources import readers, writers

_WORD = r"[\p{L}\p{N}_]"

_LUHN = """list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 0 THEN CAST(d[i] AS INT)
  ELSE (CAST(d[i] AS INT) * 2) % 10 + (CAST(d[i] AS INT) * 2) // 10 END)) % 10 = 0"""
_NHS = """(11 - list_sum(list_transform(range(1, 10), lambda i: CAST(d[i] AS INT) * (11 - i))) % 11) <> 10
  AND (11 - list_sum(list_transform(range(1, 10), lambda i: CAST(d[i] AS INT) * (11 - i))) % 11) % 11 = CAST(d[10] AS INT)"""


def spans_sql(source: str, entities=None, key: str = "doc_id") -> str:
    """Spans from the lengths of the parts between matches."""
    names = list(pii.ENTITIES) if entities is None else entities
    hits = " UNION ALL ".join(
        f"SELECT {key}, {quoted(n)} AS entity, CAST({pii.ENTITIES[n][1]} AS DOUBLE) AS score, "
        f"regexp_extract_all(text, {quoted(pii.ENTITIES[n][0])}) AS m, string_split_regex(text, {quoted(pii.ENTITIES[n][0])}) AS p FROM {source}"
        for n in names
    )
    return f"""hits AS ({hits}),
  each AS (SELECT {key}, entity, score, m, p, unnest(range(1, len(m) + 1)) AS i FROM hits),
  placed AS (SELECT {key}, entity, score, m[i] AS span, CAST(list_sum(list_transform(p[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INT) AS s,
    regexp_extract_all(regexp_replace(m[i], '[^0-9]', '', 'g'), '[0-9]') AS d FROM each),
  spans AS (SELECT {key}, entity, s, CAST(s + length(span) AS INT) AS e, score, span FROM placed
    WHERE CASE WHEN entity = 'CREDIT_CARD' THEN {_LUHN} WHEN entity = 'UK_NHS' THEN {_NHS} ELSE true END)"""


def _spans(spark, folder, entities=None):
    return documents(spark, folder).select("doc_id", "text", pii.spans(F.col("text"), entities).alias("spans"))


def _rows(df):
    return df.select("doc_id", F.explode("spans").alias("s")).select(
        "doc_id", "s.entity", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), "s.score"
    )


@query("A1_find_spans", f"WITH {spans_sql('documents')} SELECT doc_id, entity, s AS span_start, e AS span_end, score FROM spans")
def _(spark, folder):
    return _rows(_spans(spark, folder))


_COUNTS = ", ".join(f"CAST(len(regexp_extract_all(text, {quoted(p)})) AS INT) AS {n.lower()}" for n, (p, _) in pii.ENTITIES.items())


@query("A1_count_by_pattern", f"SELECT doc_id, {_COUNTS} FROM documents")
def _(spark, folder):
    return documents(spark, folder).select("doc_id", *[pii.count_by_pattern(F.col("text"), n).alias(n.lower()) for n in pii.ENTITIES])


@query("A2_titles", f"""WITH texts AS (SELECT doc_id, 'Dear Mr. ' || lang || ', ' || text || ' Mrs ' || source AS text FROM documents),
  {spans_sql('texts', ['TITLE'])} SELECT doc_id, s AS span_start, span FROM spans""")
def _(spark, folder):
    greeted = documents(spark, folder).select(
        "doc_id", F.concat(F.lit("Dear Mr. "), "lang", F.lit(", "), "text", F.lit(" Mrs "), "source").alias("text")
    )
    found = greeted.select("doc_id", "text", F.explode(pii.spans(F.col("text"), ["TITLE"])).alias("s"))
    return found.select("doc_id", F.col("s.start").alias("span_start"), F.expr("substring(text, s.start + 1, s.end - s.start)").alias("span"))


def _names(spark, folder):
    """A name list taken from the capitalised words of ``benchmark``."""
    words = table(spark, folder, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0))).alias("name"))
    upper = (F.substring("name", 1, 1) == F.upper(F.substring("name", 1, 1))) & (F.substring("name", 1, 1) != F.lower(F.substring("name", 1, 1)))
    return words.filter(upper).distinct().withColumn("entity", F.lit("PERSON"))


_NAMES = f"""words AS (SELECT unnest(regexp_extract_all(text, '{_WORD}+')) AS name FROM benchmark),
  names AS (SELECT DISTINCT name FROM words WHERE name[1] = upper(name[1]) AND name[1] <> lower(name[1]))"""
_HITS = f"""parts AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}+') AS m, string_split_regex(text, '{_WORD}+') AS p FROM documents),
  each AS (SELECT doc_id, m, p, unnest(m) AS word, generate_subscripts(m, 1) AS i FROM parts),
  gap AS (SELECT doc_id, i, word, length(p[i]) AS g FROM each),
  placed AS (SELECT doc_id, word, CAST(sum(g + length(word)) OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS e FROM gap),
  found AS (SELECT doc_id, word, CAST(e - length(word) AS INT) AS s, e FROM placed WHERE word IN (SELECT name FROM names))"""


@query("A3_name_list", f"WITH {_NAMES}, {_HITS} SELECT doc_id, 'PERSON' AS entity, s AS span_start, e AS span_end, CAST(0.85 AS DOUBLE) AS score FROM found")
def _(spark, folder):
    return _rows(pii.name_spans(documents(spark, folder), "text", _names(spark, folder)))


_PICKED = ["EMAIL_ADDRESS", "IP_ADDRESS"]
_EITHER = "|".join(f"(?:{pii.ENTITIES[n][0]})" for n in _PICKED)


@query("A4_scan_record", f"""WITH parts AS (
    SELECT doc_id, 'text' AS path, text AS t FROM documents
    UNION ALL SELECT doc_id, 'meta.source', source FROM documents
    UNION ALL SELECT doc_id, 'meta.n_chars', CAST(n_chars AS VARCHAR) FROM documents
    UNION ALL SELECT doc_id, 'tags.lang', lang FROM documents
    UNION ALL SELECT doc_id, 'lines[' || (i - 1) || ']', l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
      generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
  SELECT doc_id, path, CAST(len(regexp_extract_all(t, {quoted(_EITHER)})) AS INT) AS found FROM parts WHERE t <> ''""")
def _(spark, folder):
    record = documents(spark, folder).select(
        "doc_id", "text", F.struct("source", "n_chars").alias("meta"),
        F.create_map(F.lit("lang"), "lang", F.lit("hidden"), "source").alias("tags"), F.split("text", "\n", -1).alias("lines"),
        F.col("source").alias("skipped"),
    )
    found = pii.scan_record(record, skip=["skipped", "tags.hidden"], entities=_PICKED)
    return found.select("doc_id", "path", F.size("spans").alias("found"))


@query("A5_resolve_overlaps")
def _(spark, folder):
    return _rows(_spans(spark, folder).withColumn("spans", pii.resolve(F.col("spans"))))


def _rewritten(put) -> str:
    """Interleave the parts between matches with ``put(m)``."""
    return f"""WITH parts AS (SELECT doc_id, regexp_extract_all(text, {quoted(_EITHER)}) AS m,
      string_split_regex(text, {quoted(_EITHER)}) AS p FROM documents)
    SELECT doc_id, array_to_string(list_transform(range(1, len(m) + 1), lambda i: p[i] || {put('m[i]')}), '') || p[len(p)] AS text FROM parts"""


def _strategy(key: str, strategy: str, sql, entities=None):
    @query(key, sql)
    def run(spark, folder):
        return pii.anonymise(documents(spark, folder).select("doc_id", "text"), ["text"], strategy, entities=entities)


_ORDER = [n for n in pii.ENTITIES if n not in ("CREDIT_CARD", "UK_NHS")]
_HOLE = "\ue000"  # stands for a removed span until all patterns have run
_typed = _cut = "text"
for _name in _ORDER:
    _typed = f"regexp_replace({_typed}, {quoted(pii.ENTITIES[_name][0])}, '<{_name}>', 'g')"
    _cut = f"regexp_replace({_cut}, {quoted(pii.ENTITIES[_name][0])}, '{_HOLE}', 'g')"
_strategy("A6_redact", "redact", f"SELECT doc_id, replace({_cut}, '{_HOLE}', '') AS text FROM documents", _ORDER)
_strategy("A7_replace", "replace", f"SELECT doc_id, {_typed} AS text FROM documents", _ORDER)
_strategy("A6_redact_all_entities", "redact", None)
_strategy("A8_hash", "hash", _rewritten(lambda m: f"sha256({m})"), _PICKED)
_strategy("A9_mask", "mask", _rewritten(
    lambda m: f"substring({m}, 1, greatest(length({m}) - 100, 0)) || repeat('*', least(length({m}), 100))"), _PICKED)


@query("A10_encrypt", f"WITH {_NAMES}, {_HITS} SELECT doc_id, s AS span_start, word AS name FROM found")
def _(spark, folder):
    key = bytes(range(16))
    docs = documents(spark, folder)
    found = docs.join(pii.name_spans(docs, "text", _names(spark, folder)), "doc_id").select("doc_id", "text", F.explode("spans").alias("s"))
    word = F.expr("substring(text, s.start + 1, s.end - s.start)")
    secret = found.select("doc_id", F.col("s.start").alias("span_start"), pii.replacement("encrypt", F.col("s.entity"), word, key).alias("c"))
    opened = F.aes_decrypt(F.unbase64("c"), F.lit(bytearray(key)), F.lit("CBC")).cast("string")
    return secret.select("doc_id", "span_start", opened.alias("name"))


@query("A11_fake_first_name")
def _(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    found = docs.join(pii.name_spans(docs, "text", _names(spark, folder)), "doc_id")
    return found.select("doc_id", pii.rewrite(F.col("text"), F.col("spans"), "fake_first_name").alias("text"))


_WITH_FAKES = f"""fakes AS (SELECT name, 'N' || substring(md5(name), 1, 6) AS fake FROM names),
  lookup AS (SELECT map(list(name), list(fake)) AS f FROM fakes)"""


@query("A12_consistent_pseudonyms", f"""WITH {_NAMES}, {_WITH_FAKES}
  SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '{_WORD}+|[^\\p{{L}}\\p{{N}}_]+'),
    lambda w: coalesce(lookup.f[w], w)), '') AS text FROM documents, lookup""")
def _(spark, folder):
    mapping = _names(spark, folder).select("name", F.concat(F.lit("N"), F.substring(F.md5("name"), 1, 6)).alias("fake"))
    return pii.replace_names(documents(spark, folder).select("doc_id", "text"), "text", mapping)


@query("A12_name_mapping", f"WITH {_NAMES}, {_HITS} SELECT DISTINCT word AS name FROM found")
def _(spark, folder):
    docs = documents(spark, folder)
    mapping = pii.pseudonyms(pii.name_spans(docs, "text", _names(spark, folder)), docs, "text")
    return mapping.filter(F.col("fake").isin(list(pii.FAKE_NAMES))).select("name")


@query("A13_anonymise_files", f"SELECT doc_id, {_typed} AS text, lang, source, n_chars FROM documents")
def _(spark, folder):
    docs = documents(spark, folder)
    paths = [writers.write_table(part, scratch_path(spark, "csv"), "csv") for part in (docs.filter("lang = 'en'"), docs.filter("lang <> 'en'"))]
    merged = readers.read_union(spark, paths, docs.schema)
    out = writers.write_table(pii.anonymise(merged, ["text"], "replace", entities=_ORDER), scratch_path(spark, "anon"), "csv")
    return readers.read_csv(spark, out, docs.schema)
