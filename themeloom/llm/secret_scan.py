"""Secret scans with an inverted index of trigrams.

From each rule's regular expression a Boolean query over trigrams is derived: every match must hold the trigrams of its
mandatory literals (AND), of one branch of an alternation (OR).  The index is split by document, as search engines do:
a task indexes its own batch of texts (postings of the trigrams that any rule asks for, as bit sets over the batch),
intersects and unites postings by the query, and runs the expression on the candidates only.  A rule without a mandatory
trigram is run on every text.  Nothing is shuffled, and no bound or sample is involved.

Null and empty texts have no spans.  A null id stays null, repeated rows are scanned each, an empty table gives no rows,
other columns are not read.  Spans are in code points with an exclusive end.
"""

from __future__ import annotations

import functools
import re
from re import _constants as sre, _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from themeloom.llm.batches import leave_only, map_texts

FLAGS = re.ASCII
# A key's block: header, attributes ("Proc-Type: ..."), base64 lines, END line; without an END line, to the last base64
# line.  Line ends may be escaped, lines quoted, indented or joined by blanks.  No part is given back, so time is linear.
_KIND = "(?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY(?: BLOCK)?-----"
_BESIDE = r"""(?:[\x20\t\r"'`,;>#*|/+]|\\(?![nr]))*+"""  # quotes, comment marks and the like beside a line
_BREAK = rf"{_BESIDE}(?:\n|\\[nr]){_BESIDE}"
_GAP = rf"""(?:[\s"'`,;>#*|/+]|\\[nr]?)*+"""
_CODE = r"(?:[A-Za-z0-9+/=]|\\/)"
_LINE = rf"(?>{_BREAK}(?:{_BREAK})*+{_CODE}++(?={_BESIDE}(?:\n|\\[nr]|-----|\Z)))"
_LONG = rf"(?>{_GAP}{_CODE}{{20,}}+)"
_ATTRIBUTES = rf"(?>{_BREAK}[A-Z][A-Za-z0-9-]*+:[^\n\\]*+)*+"
_PRIVATE_KEY = (
    rf"-----BEGIN {_KIND}(?:{_ATTRIBUTES}(?:{_LINE}|{_LONG})*+(?:{_GAP}{_CODE}{{1,19}}+){{0,2}}{_GAP}-----END {_KIND}"
    rf"|{_ATTRIBUTES}{_LONG}(?:{_LONG})*+(?:{_LINE}){{0,2}}+)?"
)
#: kind: (expression, group whose length counts, least length).  Matches are taken from left to right without overlap,
#: and short ones dropped afterwards.  The first three are fixed values.
RULES: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "private_key": (_PRIVATE_KEY, 0, 1),
    "forge_token": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    "forge_fine_token": (r"github_pat_[A-Za-z0-9_]+", 0, 60),
    "chat_token": (r"xox[abeprs]-[A-Za-z0-9-]+", 0, 20),
    "chat_hook": (r"https://hooks\.slack\.com/services/[A-Za-z0-9/]+", 0, 60),
    "cloud_key": (r"AIza[A-Za-z0-9_-]+", 0, 39),
    "temporary_access": (r"ASIA[A-Z0-9]+", 0, 20),
    "payment_key": (r"(?:sk|rk|pk)_live_[A-Za-z0-9]+", 0, 24),
    "web_token": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    "mail_key": (r"SG\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 60),
    "bearer": (r"(?i:authorization:\x20*bearer)\x20+([A-Za-z0-9._~+/=-]+)", 1, 16),
    # From the start of a run of scheme characters, so that a long run is read once.
    "login_in_url": (r"(?<![a-z0-9+.-])[0-9+.-]*+[a-z][a-z0-9+.-]++://[^\s/:@]++:([^\s/:@]++)@", 1, 4),
}
SPAN = "array<struct<start: int, end: int, kind: string>>"


#: Most alternatives that a run of literals and character sets is spelled out to.
MAX_RUNS = 16

# --- queries: ("all",) needs nothing, ("gram", t), ("and", [...]), ("or", [...])
ANY = ("all",)


def _both(parts: list) -> tuple:
    parts = [p for p in parts if p != ANY]
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _either(parts: list) -> tuple:
    return ANY if not parts or ANY in parts else parts[0] if len(parts) == 1 else ("or", parts)


def _grams(literal: bytes) -> tuple:
    return _both([("gram", literal[i] << 16 | literal[i + 1] << 8 | literal[i + 2]) for i in range(len(literal) - 2)])


def _flat(items: list) -> list:
    """Sequence of literal characters and other items, groups that are plain sequences opened."""
    out = []
    for op, value in items:
        if op is sre.SUBPATTERN:
            out += _flat(list(value[3]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] == value[1] and value[0] <= 16:
            out += _flat(list(value[2])) * value[0]
        else:
            out.append((op, value))
    return out


def _sequence(items: list) -> tuple:
    """Query of a sequence: trigrams of its runs of literals, folded to lower case, and of its parts."""
    parts, runs = [], [b""]  # runs: what the literals and small character sets in a row can be

    def end_run():
        parts.append(_either([_grams(r) for r in runs]))
        runs[:] = [b""]

    for op, value in _flat(items):
        letters = [value] if op is sre.LITERAL else [v for _, v in value] if op is sre.IN and all(k is sre.LITERAL for k, _ in value) else []
        letters = sorted({chr(v).encode().lower() for v in letters})
        if letters and len(runs) * len(letters) <= MAX_RUNS:
            runs[:] = [r + x for r in runs for x in letters]
            continue
        end_run()
        if op is sre.BRANCH:
            parts.append(_either([_sequence(list(branch)) for branch in value[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            parts.append(_sequence(list(value[2])))
    end_run()
    return _both(parts)


def query_of(expression: str) -> tuple:
    """Boolean trigram query that every text with a match satisfies (texts lower-cased, A-Z only)."""
    return _sequence(list(sre_parser.parse(expression, FLAGS)))


def grams_of(query: tuple) -> set[int]:
    return {query[1]} if query[0] == "gram" else set().union(*map(grams_of, query[1])) if len(query) > 1 else set()


class TrigramIndex:
    """Postings of chosen trigrams over one batch of texts, as bit sets."""

    _LOWER = np.arange(256, dtype=np.uint8)
    _LOWER[65:91] += 32

    def __init__(self, texts: list[bytes], pairs: np.ndarray, grams: list[int]):
        """``grams`` are sorted; ``pairs`` marks the two bytes that any of them begins with."""
        self.sorted = np.array(grams, np.int64)
        self.grams = {g: i for i, g in enumerate(grams)}
        self.rows = len(texts)
        self.postings = np.zeros((len(grams), self.rows), bool)
        for first in range(0, self.rows, 512):
            self._add(first, texts[first: first + 512], pairs)

    def _add(self, first: int, texts: list[bytes], pairs: np.ndarray) -> None:
        joined = self._LOWER[np.frombuffer(b"\0\0".join(texts), np.uint8)]  # no trigram spans two texts
        if len(joined) < 3 or not len(self.sorted):
            return
        pair = joined[:-2].astype(np.uint16) << 8 | joined[1:-1]
        at = np.flatnonzero(pairs[pair])
        gram = pair[at].astype(np.int64) << 8 | joined[at + 2]
        number = np.searchsorted(self.sorted, gram)
        known = self.sorted[np.minimum(number, len(self.sorted) - 1)] == gram
        at, number = at[known], number[known]
        starts = np.cumsum([0, *(len(t) + 2 for t in texts)])
        self.postings[number, first + np.searchsorted(starts, at, "right") - 1] = True

    def rows_of(self, query: tuple) -> np.ndarray:
        if query == ANY:
            return np.ones(self.rows, bool)
        if query[0] == "gram":
            return self.postings[self.grams[query[1]]]
        return functools.reduce(np.logical_and if query[0] == "and" else np.logical_or, map(self.rows_of, query[1]))


class Scanner:
    def __init__(self, rules: dict[str, tuple[str, int, int]]):
        self.rules = [(kind, re.compile(x, FLAGS), query_of(x), group, least) for kind, (x, group, least) in rules.items()]
        self.grams = sorted(set().union(*(grams_of(q) for _, _, q, _, _ in self.rules)))
        self.pairs = np.zeros(1 << 16, bool)  # the first two bytes of any trigram
        self.pairs[[g >> 8 for g in self.grams]] = True

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, str]]]:
        """Spans of each text by start, then in the order of the rules."""
        index = TrigramIndex(texts, self.pairs, self.grams)
        found: list[list] = [[] for _ in texts]
        decoded: dict[int, str] = {}
        for order, (kind, expression, query, group, least) in enumerate(self.rules):
            for row in np.flatnonzero(index.rows_of(query)).tolist():
                raw = texts[row]
                if query == ANY and raw.isascii():
                    text = raw.decode("ascii")
                else:
                    text = decoded.get(row)
                    if text is None:
                        text = decoded[row] = raw.decode()
                for m in expression.finditer(text):
                    if m.end(group) - m.start(group) >= least:
                        found[row].append((m.start(), order, m.end(), kind))
        return [[(start, end, kind) for start, _, end, kind in sorted(spans)] for spans in found]


_SCANNERS: dict[tuple, Scanner] = {}


def scan(docs: DataFrame, rules: dict[str, tuple[str, int, int]] | None = None, doc_id: str = "doc_id", text: str = "text",
         keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep`` and the ``spans`` (start, end, kind) of every row."""
    rules = RULES if rules is None else rules
    key = tuple(rules.items())

    def run(texts: list[bytes]) -> list:
        leave_only()
        if key not in _SCANNERS:
            _SCANNERS[key] = Scanner(dict(key))
        return [[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in _SCANNERS[key].scan(texts)]

    return map_texts(docs, run, f"spans {SPAN}", doc_id, text, keep)


def shown(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined in their order."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def masked(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        gap = F.when(
            s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        ).otherwise(acc["out"])
        return F.struct(gap.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, state, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)
