"""Text cleaning as native column expressions.

Java classes such as ``\\s`` are ASCII unless ``(?U)`` is given and ``$`` also
matches before a last newline, so ``\\z`` is used for the end of the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from themeloom import params
from themeloom.functions.arrays import let

# The patterns of the cleaning steps and their replacements.
NEWLINES = r"(\r\n|\n)+"
CARRIAGE_RETURN = r"\r"
URLS = r"https?://[a-z!$-_]+|www\.[a-zA-Z0-9._-]+\.[a-zA-Z]{2,}"
HTML = r"<[^>\n]*>|&([a-z0-9]+|#[0-9]{1,6}|#x[0-9a-f]{1,6});|\xa0|&nbsp;"
CUT_OFF_TAG = r"(?d)<.*?\.\."
NON_ASCII = r"[^\x00-\x7F]+"
EMAILS = r"(?<!\S)\S*@\S*\s?"
NUMBERS = r"\b\d+[.|,]\d+\b|\b[0-9]{5,}\b|\b[0-9]+\s[0-9]+\b"
POSTCODES = (
    r"\b[A-Z][A-HJ-Y]?[0-9][0-9A-Z]? ?[0-9][A-Z]{2}"
    r"|GIR ?0A{2}\b\z"
    r"|[A-Z][A-HJ-Y]?[0-9][0-9A-Z]? ?[0-9]\z"
    r"|\b[A-Z][A-HJ-Y]?[0-9][0-9A-Z]?\b\z"
)
SPACES = r"\s{2,}"
PUNCTUATION_RUN = r"(\p{P})\p{P}+"
AMPERSAND = "&"

# Typographic marks and their plain forms.
SMART_MARKS = {
    "‘": "'", "’": "'", "“": '"', "”": '"',
    "–": "-", "—": "-", "…": "...", "•": "*",
}

# Fixed value: ASCII punctuation as a character class.
ASCII_PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def strip(c: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def newlines_to_spaces(c: Column) -> Column:
    return F.regexp_replace(c, NEWLINES, "  ")


def drop_carriage_returns(c: Column) -> Column:
    return F.regexp_replace(c, CARRIAGE_RETURN, "")


def blank_urls(c: Column) -> Column:
    return F.regexp_replace(c, URLS, " ")


def blank_html(c: Column) -> Column:
    return F.regexp_replace(c, HTML, " ")


def blank_cut_off_tags(c: Column) -> Column:
    return F.regexp_replace(c, CUT_OFF_TAG, " ")


def blank_non_ascii(c: Column) -> Column:
    return F.regexp_replace(c, NON_ASCII, " ")


def blank_emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAILS, " ")


def blank_numbers(c: Column) -> Column:
    return F.regexp_replace(c, NUMBERS, " ")


def blank_postcodes(c: Column) -> Column:
    return F.regexp_replace(c, POSTCODES, " ")


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, SPACES, " ")


def collapse_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, PUNCTUATION_RUN, "$1")


def spell_ampersand(c: Column) -> Column:
    return F.replace(c, F.lit(AMPERSAND), F.lit("and"))


CLEANING_STEPS = (
    strip,
    newlines_to_spaces,
    drop_carriage_returns,
    blank_urls,
    blank_html,
    blank_cut_off_tags,
    blank_non_ascii,
    blank_emails,
    blank_numbers,
    blank_postcodes,
    collapse_spaces,
    collapse_punctuation,
    spell_ampersand,
)


def clean(c: Column) -> Column:
    """All cleaning steps in their fixed order; the result is not stripped."""
    for step in CLEANING_STEPS:
        c = step(c)
    return c


def remove_patterns(c: Column, patterns: Sequence[str]) -> Column:
    """Strip, blank each caller pattern in list order, collapse white space.

    Classes such as ``\\w`` and ``\\s`` cover all of Unicode.
    """
    c = strip(c)
    for pattern in patterns:
        c = F.regexp_replace(c, F.lit("(?U)" + pattern), F.lit(" "))
    return F.regexp_replace(c, r"(?U)\s{2,}", " ")


def plain_marks(c: Column) -> Column:
    """Typographic quotes, dashes, dots and bullets to their ASCII forms."""
    for mark, plain in SMART_MARKS.items():
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode NFKC form; Spark has no built-in for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def split_hyphens(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(\w++)-(\w++)-?(\w)?", "$1 $2 $3")


def white_space_tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def tokens_without_punctuation(a: Column) -> Column:
    stripped = F.transform(a, lambda t: F.regexp_replace(t, ASCII_PUNCTUATION, ""))
    return F.filter(stripped, lambda t: t != "")


def alphabetic_lower_tokens(a: Column) -> Column:
    return F.transform(F.filter(a, lambda t: t.rlike(r"\A\p{L}+\z")), F.lower)


def long_tokens(a: Column, longer_than: int = 3) -> Column:
    return F.filter(a, lambda t: F.length(t) > longer_than)


def wrap_words(c: Column, words: int = params.HOVER_WORDS, line: int = params.HOVER_LINE) -> Column:
    """First ``words`` words, with ``<br>`` after every ``line`` of them."""
    def lines(kept: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(kept) - 1) / line).cast("int")),
            lambda i: F.concat(F.array_join(F.slice(kept, i * line + 1, F.lit(line)), " "), F.lit("<br>")),
        )
        return F.when(F.size(kept) > 0, F.array_join(each, "")).when(kept.isNotNull(), F.lit(""))

    return let(F.slice(white_space_tokens(c), 1, words), lines)


def cut_label(c: Column, chars: int = params.LABEL_CHARS) -> Column:
    return F.substring(c, 1, chars)


def short_label(c: Column, chars: int = params.SHORT_LABEL_CHARS) -> Column:
    """Labels of ``chars`` or more characters end in three dots."""
    return F.when(F.length(c) < chars, c).otherwise(F.concat(F.substring(c, 1, chars - 3), F.lit("...")))


def cut_words(a: Column, chars: int = 20) -> Column:
    return F.transform(a, lambda w: F.substring(w, 1, chars))


def clean_generated_label(c: Column) -> Column:
    """Keep letters, digits, spaces, dashes and apostrophes; null becomes empty."""
    kept = F.regexp_replace(c, r"(?U)[^a-zA-Z0-9\s\-']", "")
    return F.coalesce(strip(F.regexp_replace(kept, r"(?U)\s+", " ")), F.lit(""))


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def tokens(c: Column) -> Column:
    """Lower-case words of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def topic_text(c: Column) -> Column:
    """The form of a text that topic words are counted on: ASCII words only.

    Java matches the named ASCII class many times faster than the ranges written out.
    """
    return F.regexp_replace(F.regexp_replace(c, r"[\n\t]", " "), r"[^\p{Alnum} ]+", "")


def ngrams(a: Column, lengths: tuple[int, int] = params.NGRAMS) -> Column:
    """All runs of ``lengths[0]`` to ``lengths[1]`` adjacent tokens, space-joined."""
    def runs(words: Column, n: int) -> Column:
        out = words
        for offset in range(1, n):
            tail = F.slice(words, F.lit(offset + 1), F.greatest(F.size(words) - offset, F.lit(0)))
            out = F.zip_with(F.slice(out, F.lit(1), F.size(tail)), tail, lambda x, y: F.concat_ws(" ", x, y))
        return out

    return let(a, lambda words: F.concat(*[runs(words, n) for n in range(lengths[0], lengths[1] + 1)]))


def counted(a: Column) -> Column:
    """(term, n) of the distinct elements of an array of texts."""
    def runs(words: Column) -> Column:
        listed = F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("at")))
        first = F.filter(listed, lambda s: (s["at"] == 0) | (F.get(words, s["at"] - 1) != s["term"]))
        return let(first, lambda starts: F.transform(starts, lambda s, k: F.struct(
            s["term"].alias("term"), (F.coalesce(F.get(starts, k + 1)["at"], F.size(words)) - s["at"]).cast("long").alias("n"))))

    return let(F.sort_array(a), runs)
