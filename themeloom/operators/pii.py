"""Finding and rewriting personal data.

Pattern entities are found with offsets by one Arrow function; overlaps are
resolved and the text is rewritten with built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from themeloom.functions.arrays import let

SPAN = "struct<entity:string,start:int,end:int,score:double>"
SPANS = f"array<{SPAN}>"
_CHARS = 1_000_000  # characters of text whose words a task holds at once

# Titles that are always personal data.
TITLES = ("Mr", "Mrs", "Miss", "Ms", "mr", "mrs", "miss", "ms")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)"

# Entity: (pattern, score).  The patterns avoid look-around and Unicode classes,
# so Java, Python and RE2 read them alike.
ENTITIES = {
    "EMAIL_ADDRESS": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 1.0),
    "URL": (r"\b(?:https?://|www\.)[^\s<>\"]+", 0.6),
    "IBAN_CODE": (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 0.5),
    "IP_ADDRESS": (rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", 0.6),
    "CREDIT_CARD": (r"\b(?:[0-9]{4}[ -]?){3}[0-9]{4}\b", 1.0),
    "DATE_TIME": (
        r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b"
        rf"|\b[0-9]{{1,2}} {_MONTH} [0-9]{{4}}\b|\b{_MONTH} [0-9]{{1,2}}, [0-9]{{4}}\b",
        0.6,
    ),
    "US_SSN": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.5),
    "UK_NHS": (r"\b[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}\b", 1.0),
    "PHONE_NUMBER": (
        r"(?:\+[0-9]{1,3}[ -]?)?(?:\([0-9]{2,5}\)|\b[0-9]{2,5})[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}\b",
        0.4,
    ),
    "TITLE": (r"\b(?:" + "|".join(TITLES) + r")\b", 1.0),
}


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _nhs(digits: str) -> bool:
    check = 11 - sum(int(d) * w for d, w in zip(digits, range(10, 1, -1))) % 11
    return check != 10 and (0 if check == 11 else check) == int(digits[9])


_CHECKS = {"CREDIT_CARD": _luhn, "UK_NHS": _nhs}

_DOMAIN = re.compile(r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", re.ASCII)
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_WORD = re.compile(r"\w", re.ASCII)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Places of the e-mail pattern, of any length: from each ``@`` with a domain back to the start of what stands
    before it, so every character is read a bounded number of times."""
    end = past = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        left = text.rfind("@", past, at) + 1 or past
        left = at - _LOCAL.match(text[left:at][::-1]).end()
        past = at
        left = max(left, end)
        first = _WORD.search(text, left, at)
        if left < at and left == end > 0 and _WORD.match(text[left - 1]):
            yield left, m.end()  # straight after an address, so at a word's end
            end = m.end()
        elif first:
            yield first.start(), m.end()
            end = m.end()


# The same for the JVM: an address begins where the characters of one begin, or after the last address.
_EMAIL_JVM = r"(?:(?<![A-Za-z0-9._%+-])|\G)[.%+-]*?\b[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


def spans(column: Column, entities: Sequence[str] | None = None) -> Column:
    """All spans of the chosen entities, checked by their check digits; spans of
    different entities may overlap.  Null text gives null."""
    names = list(ENTITIES) if entities is None else list(entities)

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        rules = [(n, re.compile(ENTITIES[n][0], re.ASCII), ENTITIES[n][1], _CHECKS.get(n)) for n in names]

        def one(text: str | None):
            if text is None:
                return None
            found = []
            for name, rule, score, check in rules:
                places = _emails(text) if name == "EMAIL_ADDRESS" else (m.span() for m in rule.finditer(text))
                for start, end in places:
                    if check is None or check(re.sub("[^0-9]", "", text[start:end])):
                        found.append({"entity": name, "start": start, "end": end, "score": score})
            return found

        return texts.map(one)

    return find.asNondeterministic()(column)  # else filters on the result run it again


def count_by_pattern(column: Column, entity: str) -> Column:
    """Matches of one entity's pattern, without check digits; built-in only."""
    pattern = _EMAIL_JVM if entity == "EMAIL_ADDRESS" else ENTITIES[entity][0]
    return F.size(F.regexp_extract_all(column, F.lit(pattern), F.lit(0)))


def resolve(found: Column) -> Column:
    """Spans without overlaps: the longer wins, then the higher score, then the
    earlier, then the entity name; sorted by start."""
    ranked = F.array_sort(
        F.transform(
            found,
            lambda s: F.struct(
                (s["start"] - s["end"]).alias("shorter"), (-s["score"]).alias("lower"), s["start"].alias("start"),
                s["entity"].alias("entity"), s["end"].alias("end"), s["score"].alias("score"),
            ),
        )
    )
    plain = F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                   s["entity"].alias("entity"), s["score"].alias("score")))
    empty = F.array().cast("array<struct<start:int,end:int,entity:string,score:double>>")
    kept = F.aggregate(
        plain,
        empty,
        lambda acc, s: F.when(
            F.exists(acc, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), acc
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return F.transform(
        F.array_sort(kept),
        lambda s: F.struct(s["entity"].alias("entity"), s["start"].alias("start"), s["end"].alias("end"),
                           s["score"].alias("score")),
    )


def splice(text: Column, pieces: Column) -> Column:
    """``text`` with each (start, end, value) of the sorted, disjoint ``pieces``
    put in place."""
    put = lambda s, at: F.when(s.isNull(), F.substring(text, at + 1, F.length(text))).otherwise(
        F.concat(F.substring(text, at + 1, s["start"] - at), s["value"])
    )
    ends = lambda each: F.concat(F.array(F.lit(0)), F.transform(each, lambda s: s["end"]))
    return let(pieces, lambda each: F.array_join(F.zip_with(each, ends(each), put), ""))


# Stand-in first names.
FAKE_NAMES = (
    "Alice", "Amelia", "Arthur", "Beatrice", "Charles", "Clara", "Daniel", "Edith", "Edward", "Eleanor",
    "Florence", "Frank", "George", "Grace", "Hannah", "Harold", "Henry", "Isabel", "Jack", "James",
    "Lucy", "Mabel", "Martin", "Nora", "Oliver", "Oscar", "Peter", "Rose", "Samuel", "Thomas", "Violet", "Walter",
)


def fake_name(name: Column, seed: int = 0) -> Column:
    """The same stand-in for the same name and seed."""
    at = F.pmod(F.xxhash64(name, F.lit(seed)), F.lit(len(FAKE_NAMES))).cast("int")
    return F.get(F.array(*[F.lit(n) for n in FAKE_NAMES]), at)


def replacement(strategy: str, entity: Column, span: Column, key: bytes | None = None, seed: int = 0) -> Column:
    """What a span becomes.  ``encrypt`` and ``fake_first_name`` act on PERSON
    spans; other entities are then replaced by their type."""
    typed = F.concat(F.lit("<"), entity, F.lit(">"))
    if strategy == "replace":
        return typed
    if strategy == "redact":
        return F.lit("")
    if strategy == "hash":
        return F.sha2(span, 256)
    if strategy == "mask":
        open_part = F.greatest(F.length(span) - 100, F.lit(0))
        return F.concat(F.substring(span, F.lit(1), open_part), F.repeat(F.lit("*"), F.least(F.length(span), F.lit(100))))
    if strategy == "encrypt":
        if key is None or len(key) not in (16, 24, 32):
            raise ValueError("encryption needs a key of 16, 24 or 32 bytes")
        secret = F.base64(F.aes_encrypt(span, F.lit(bytearray(key)), F.lit("CBC")))
        return F.when(entity == "PERSON", secret).otherwise(typed)
    if strategy == "fake_first_name":
        return F.when(entity == "PERSON", fake_name(span, seed)).otherwise(typed)
    raise ValueError(f"unknown strategy: {strategy}")


def rewrite(text: Column, found: Column, strategy: str, key: bytes | None = None, seed: int = 0) -> Column:
    """``text`` with its resolved spans rewritten."""
    pieces = F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"),
            replacement(strategy, s["entity"], F.substring(text, s["start"] + 1, s["end"] - s["start"]), key, seed)
            .alias("value"),
        ),
    )
    return splice(text, pieces)


def anonymise(df: DataFrame, columns: Sequence[str], strategy: str = "redact", key: bytes | None = None,
              entities: Sequence[str] | None = None, seed: int = 0, names: DataFrame | None = None,
              doc: str = "doc_id") -> DataFrame:
    """The chosen columns with pattern entities rewritten; column order stays.

    With ``names`` (name, entity) capitalised words on that list are rewritten too; ``doc`` then is a unique id.
    """
    for name in columns:
        found = spans(F.col(name), entities)
        if names is not None:
            listed = name_spans(df, name, names, doc).select(F.col(doc).alias("_doc"), F.col("spans").alias("_listed"))
            df_listed = df.join(listed, F.col(doc) == F.col("_doc"), "left")
            found = F.concat(found, F.coalesce("_listed", F.array().cast(SPANS)))
        marked = (df if names is None else df_listed).withColumn("_spans", resolve(found))
        df = marked.withColumn(name, rewrite(F.col(name), F.col("_spans"), strategy, key, seed)).select(*df.columns)
    return df


def capital_batches(batches: Iterator[pa.RecordBatch], names: list[str], chars: int = _CHARS) -> Iterator[pa.RecordBatch]:
    """(key, word, start, end) of the words that start with a capital letter in batches of (key, text).

    The words of about ``chars`` characters of text are held at once, whatever the batch.
    """
    rule = re.compile(r"\w+")
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        at, words, starts, ends, held = [], [], [], [], 0
        for i in range(batch.num_rows):
            t = texts[i].as_py()
            for m in rule.finditer(t or ""):
                if m.group()[0].isupper():
                    at.append(i), words.append(m.group()), starts.append(m.start()), ends.append(m.end())
            held += len(t or "")
            if at and (held >= chars or i == batch.num_rows - 1):
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(at, pa.int64())), pa.array(words, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=names)
                at, words, starts, ends, held = [], [], [], [], 0


def _capital_words(df: DataFrame, column: str, doc: str) -> DataFrame:
    """(doc, word, start, end) of words that start with a capital letter."""
    names = [doc, "word", "start", "end"]
    kind = df.schema[doc].dataType.simpleString()
    return df.select(doc, column).mapInArrow(lambda batches: capital_batches(batches, names), f"`{doc}` {kind}, word string, start int, end int")


def name_spans(df: DataFrame, column: str, names: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, spans) of capitalised words found in ``names`` (name, entity).

    Only capitalised words take part in the join, and only hits are grouped.
    """
    words = _capital_words(df, column, doc)
    hits = words.join(names.select(F.col("name").alias("word"), "entity"), "word")
    span = F.struct("entity", F.col("start"), F.col("end"), F.lit(0.85).alias("score"))
    return hits.groupBy(doc).agg(F.sort_array(F.collect_list(span)).alias("spans"))


def pseudonyms(found: DataFrame, df: DataFrame, column: str, doc: str = "doc_id", seed: int = 0) -> DataFrame:
    """(name, fake): one stand-in for each distinct PERSON span."""
    texts = df.select(doc, column).join(found.select(doc, "spans"), doc)
    span = texts.select(column, F.explode(F.filter("spans", lambda s: s["entity"] == "PERSON")).alias("s"))
    names = span.select(F.expr(f"substring({column}, s.start + 1, s.end - s.start)").alias("name")).distinct()
    return names.withColumn("fake", fake_name(F.col("name"), seed))


def replace_names(df: DataFrame, column: str, mapping: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Whole-word replacement of every mapped (name, fake), wherever it occurs."""
    words = _capital_words(df, column, doc)
    hits = words.join(mapping.select(F.col("name").alias("word"), F.col("fake").alias("value")), "word")
    pieces = hits.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("start", "end", "value"))).alias("_pieces"))
    joined = df.join(pieces, doc, "left")
    changed = F.when(F.col("_pieces").isNull(), F.col(column)).otherwise(splice(F.col(column), F.col("_pieces")))
    return joined.withColumn(column, changed).select(*df.columns)


def _leaves(name: str, column: Column, kind, skip: set[str]) -> list[Column]:
    """Arrays of (path, text) for each text-like leaf below a column."""
    if name in skip:
        return []
    if isinstance(kind, StructType):
        return [leaf for f in kind.fields for leaf in _leaves(f"{name}.{f.name}", column[f.name], f.dataType, skip)]
    pair = lambda path, value: F.struct(path.alias("path"), value.cast("string").alias("text"))
    none = F.array().cast("array<struct<path:string,text:string>>")
    nested = (StructType, ArrayType, MapType)
    rest = lambda p: p["path"].substr(F.lit(len(name) + 1), F.length(p["path"]))
    below = lambda path, value, kind: F.concat(none, *[
        F.transform(leaf, lambda p: pair(F.concat(path, rest(p)), p["text"])) for leaf in _leaves(name, value, kind, skip)
    ])
    if isinstance(kind, ArrayType):
        path = lambda i: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))
        if isinstance(kind.elementType, nested):
            return [F.coalesce(F.flatten(F.transform(column, lambda x, i: below(path(i), x, kind.elementType))), none)]
        return [F.coalesce(F.transform(column, lambda x, i: pair(path(i), x)), none)]
    if isinstance(kind, MapType):
        entries = F.filter(F.map_entries(column), lambda e: ~F.concat(F.lit(f"{name}."), e["key"]).isin(list(skip) or [""]))
        path = lambda e: F.concat(F.lit(f"{name}."), e["key"].cast("string"))
        if isinstance(kind.valueType, nested):
            return [F.coalesce(F.flatten(F.transform(entries, lambda e: below(path(e), e["value"], kind.valueType))), none)]
        return [F.coalesce(F.transform(entries, lambda e: pair(path(e), e["value"])), none)]
    return [F.array(pair(F.lit(name), column))]


def scan_record(df: DataFrame, doc: str = "doc_id", skip: Iterable[str] = (), entities: Sequence[str] | None = None) -> DataFrame:
    """(doc, path, spans) for every scalar, struct field, array element and map
    value; skipped keys (``a`` or ``a.b``) and nulls give no row."""
    skip = set(skip) | {doc}
    leaves = [leaf for f in df.schema.fields for leaf in _leaves(f.name, F.col(f.name), f.dataType, skip)]
    none = F.array().cast("array<struct<path:string,text:string>>")
    parts = df.select(doc, F.explode(F.concat(none, *leaves)).alias("p")).select(doc, "p.path", "p.text")
    return parts.filter(F.col("text").isNotNull() & (F.col("text") != "")).select(
        doc, "path", spans(F.col("text"), entities).alias("spans")
    )
