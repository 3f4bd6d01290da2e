"""License scans by ordered signature rules, in DataFrame expressions only.

A text is lower-cased and reduced to its words, which ASCII characters other than letters and digits separate.  Base
phrases are found as words in a row.  Signature rules are regular expressions on the reduced text; a rule runs only on
texts that hold its keyword, and no rule runs on a text without any keyword.  Their detections are resolved by priority:
a detection stays unless it overlaps one that stays and comes from an earlier rule, or from the same rule further left.
One sweep from left to right finds the groups of overlapping detections, and each group is resolved by itself.

Null and empty texts have no words: counts 0, no labels, score 0, no places.  A null id stays null, repeated rows are
scanned each, an empty table gives no rows, other columns are not read.  There is no shuffle and no bound on texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: phrase: label.  Fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_LICENSE = "licen[cs]e"
_UNDER = "(?:licen[cs]ed|released|distributed|available|published|shared) under (?:the )?(?:terms of )?(?:the )?"
_PARTS = {
    "by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(?:ative)?s?(?: works)?",
    "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?",
}
_GNU = {"agpl": "(?:gnu )?affero general public", "lgpl": "(?:gnu )?(?:lesser|library) general public", "gpl": "(?:gnu )?general public"}
_VERSIONS = {"cc": ("4 0", "3 0", "2 5", "2 0", "1 0"), "agpl": ("3", "1"), "lgpl": ("3", "2 1", "2"), "gpl": ("3", "2", "1")}


def _cc_rules():
    for kind, words in sorted(_PARTS.items(), key=lambda p: -len(p[0])):
        short = kind.replace("-", " ")
        for version in _VERSIONS["cc"]:
            label = f"cc-{kind}-{version.replace(' ', '.')}"
            yield label, "cc", f"cc {short} {version}"
            yield label, "creative commons", f"creative commons {words} (?:{version}|version {version})(?: international| unported| generic)?(?: public)?(?: {_LICENSE})?"
            yield label, "creativecommons", f"creativecommons org licenses {short} {version}"
        yield f"cc-{kind}-any", "creativecommons", f"creativecommons org licenses {short}"
        yield f"cc-{kind}-any", "cc", f"cc {short}"
        yield f"cc-{kind}-any", "creative commons", f"creative commons {words}(?: public)?(?: {_LICENSE})?"


def _gnu_rules():
    for kind, words in _GNU.items():
        for version in _VERSIONS[kind]:
            label = f"{kind}-{version.replace(' ', '.')}"
            yield f"{label}-or-later", "general public", f"{words} {_LICENSE} (?:as published by the free software foundation )?(?:either )?(?:version |v){version}(?: 0)? (?:of the {_LICENSE} )?or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"
            yield label, "general public", f"{words} {_LICENSE} (?:as published by the free software foundation )?(?:version |v){version}(?: 0)?"
            yield f"{label}-or-later", kind, f"(?:gnu )?{kind} ?v?(?:ersion )?{version}(?: 0)? or (?:any )?(?:later|newer)(?: version)?"
            yield label, "gnu org", f"gnu org (?:licenses|licences|copyleft)(?: old licenses)? {kind} {version}(?: 0)?"
            yield label, kind, f"(?:gnu )?{kind} ?v?(?:ersion )?{version}(?: 0)?(?: only)?"
        yield f"{kind}-any", "general public", f"{words} {_LICENSE}"


#: (label, keyword, expression), the higher priority first.
RULES: list[tuple[str, str, str]] = [
    ("spdx-tag", "spdx", "spdx license identifier (?:[a-z0-9]+ ){0,5}[a-z0-9]+"),
    *_cc_rules(),
    *_gnu_rules(),
    ("apache-2.0", "apache", f"apache {_LICENSE} (?:version )?2(?: 0)?"),
    ("apache-2.0", "apache", f"apache software {_LICENSE} (?:version )?2(?: 0)?"),
    ("apache-1.1", "apache", f"apache (?:software )?{_LICENSE} (?:version )?1 1"),
    ("apache-any", "apache", f"apache (?:software )?{_LICENSE}"),
    ("mit-0", "mit", f"(?:{_UNDER})?mit no attribution(?: {_LICENSE})?"),
    ("mit-0", "mit", f"(?:{_UNDER})?mit 0(?: {_LICENSE})?"),
    ("mit", "permission is", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "mit", f"mit {_LICENSE}"),
    ("mit", "mit", f"{_UNDER}mit"),
    ("x11", "x11", f"x11 {_LICENSE}"),
    ("isc", "isc", f"isc {_LICENSE}"),
    ("isc", "permission to", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("bsd-3-clause", "endorse", "neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of (?:its|the) contributors may be used to endorse"),
    ("bsd-2-clause", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "bsd", f"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: {_LICENSE})?"),
    ("bsd-2-clause", "bsd", f"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: {_LICENSE})?"),
    ("bsd-4-clause", "bsd", f"(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: {_LICENSE})?"),
    ("0bsd", "bsd", f"(?:0bsd|zero clause bsd|bsd zero clause)(?: {_LICENSE})?"),
    ("bsd-any", "bsd", f"bsd {_LICENSE}"),
    ("mpl-2.0", "mozilla", f"mozilla public {_LICENSE} (?:version |v)?2(?: 0)?"),
    ("mpl-1.1", "mozilla", f"mozilla public {_LICENSE} (?:version |v)?1 1"),
    ("mpl-any", "mozilla", f"mozilla public {_LICENSE}"),
    ("epl-2.0", "eclipse", f"eclipse public {_LICENSE} (?:version |v)?2(?: 0)?"),
    ("epl-1.0", "eclipse", f"eclipse public {_LICENSE} (?:version |v)?1(?: 0)?"),
    ("epl-any", "eclipse", f"eclipse public {_LICENSE}"),
    ("cddl-1.1", "common development", f"common development and distribution {_LICENSE} (?:version )?1 1"),
    ("cddl-1.0", "common development", f"common development and distribution {_LICENSE} (?:version )?1 0"),
    ("cddl-any", "common development", f"common development and distribution {_LICENSE}"),
    ("cpl-1.0", "common public", f"common public {_LICENSE}"),
    ("eupl-1.2", "european union", f"european union public {_LICENSE} (?:version |v ?)?1 2"),
    ("eupl-1.1", "european union", f"european union public {_LICENSE} (?:version |v ?)?1 1"),
    ("eupl-any", "european union", f"european union public {_LICENSE}"),
    ("artistic-2.0", "artistic", f"artistic {_LICENSE} (?:version )?2(?: 0)?"),
    ("artistic-1.0", "artistic", f"artistic {_LICENSE} (?:version )?1(?: 0)?"),
    ("artistic-any", "artistic", f"artistic {_LICENSE}"),
    ("bsl-1.0", "boost", f"boost software {_LICENSE}"),
    ("zlib", "zlib", f"zlib(?: libpng)? {_LICENSE}"),
    ("zlib", "altered source", "altered source versions must be plainly marked as such"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("psf", "python", f"python software foundation {_LICENSE}"),
    ("php", "php", f"php {_LICENSE}"),
    ("ruby", "ruby", f"ruby {_LICENSE}"),
    ("openssl", "openssl", f"openssl {_LICENSE}"),
    ("ofl-1.1", "sil open", f"sil open font {_LICENSE}(?: version)?(?: 1 1)?"),
    ("odbl", "open database", f"open database {_LICENSE}"),
    ("pddl", "public domain dedication", f"(?:open data commons )?public domain dedication and {_LICENSE}"),
    ("odc-by", "open data commons", f"open data commons attribution {_LICENSE}"),
    ("gfdl-1.3", "free documentation", f"(?:gnu )?free documentation {_LICENSE} version 1 3(?: or any later version)?"),
    ("gfdl-1.2", "free documentation", f"(?:gnu )?free documentation {_LICENSE} version 1 2(?: or any later version)?"),
    ("gfdl-any", "free documentation", f"(?:gnu )?free documentation {_LICENSE}"),
    ("cc0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("public-domain-mark", "creativecommons", "creativecommons org publicdomain mark 1 0"),
    ("public-domain-mark", "public domain mark", "(?:creative commons )?public domain mark(?: 1 0)?"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "creative commons", "creative commons zero(?: 1 0)?(?: universal)?"),
    ("cc-any", "creative commons", f"creative commons {_LICENSE}"),
    ("ogl", "open government", f"open government {_LICENSE}(?: v?(?:ersion )?[1-3](?: 0)?)?"),
    ("sspl", "server side", f"server side public {_LICENSE}"),
    ("busl-1.1", "business source", f"business source {_LICENSE}(?: 1 1)?"),
    ("elastic-2.0", "elastic", f"elastic {_LICENSE}(?: 2 0)?"),
    ("commons-clause", "commons clause", f"commons clause {_LICENSE} condition"),
    ("openrail", "rail", f"(?:big ?science )?(?:open)?rail(?: m)? {_LICENSE}"),
    ("apache-2.0", "apache org", "apache org licenses license 2 0"),
    ("mpl-2.0", "mozilla org", "mozilla org (?:en us )?mpl 2 0"),
    ("epl-2.0", "eclipse org", "eclipse org legal epl 2 0"),
    ("mit", "opensource org", "opensource org licenses? mit"),
    ("isc", "opensource org", "opensource org licenses? isc"),
    ("bsd-2-clause", "opensource org", "opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "opensource org", "opensource org licenses? bsd 3 clause"),
    ("apache-2.0", "opensource org", "opensource org licenses? apache 2 0"),
    ("unlicense", "unlicense org", "unlicense org"),
    ("bsl-1.0", "boost org", "boost org license 1 0"),
    ("odbl", "opendatacommons", "opendatacommons org licenses odbl"),
    ("odc-by", "opendatacommons", "opendatacommons org licenses by"),
    ("afl-3.0", "academic free", f"academic free {_LICENSE} (?:version |v ?)?3(?: 0)?"),
    ("afl-2.1", "academic free", f"academic free {_LICENSE} (?:version |v ?)?2 1"),
    ("afl-any", "academic free", f"academic free {_LICENSE}"),
    ("osl-3.0", "open software", f"open software {_LICENSE} (?:version |v ?)?3(?: 0)?"),
    ("osl-any", "open software", f"open software {_LICENSE}"),
    ("ecl-2.0", "educational community", f"educational community {_LICENSE} (?:version |v ?)?2(?: 0)?"),
    ("ecl-any", "educational community", f"educational community {_LICENSE}"),
    ("ms-pl", "microsoft public", f"microsoft public {_LICENSE}"),
    ("ms-rl", "microsoft reciprocal", f"microsoft reciprocal {_LICENSE}"),
    ("ncsa", "illinois", f"university of illinois (?:ncsa )?open source {_LICENSE}"),
    ("postgresql", "postgresql", f"postgresql {_LICENSE}"),
    ("blueoak-1.0.0", "blue oak", f"blue oak model {_LICENSE}(?: 1 0 0)?"),
    ("w3c", "w3c", f"w3c software (?:notice and |and document notice and )?{_LICENSE}"),
    ("unicode", "unicode", f"unicode (?:data files and software )?{_LICENSE}"),
    ("json", "good not evil", "the software shall be used for good not evil"),
    ("beerware", "beer", f"beer ?ware(?: {_LICENSE})?"),
    ("beerware", "buy me a beer", "you can buy me a beer in return"),
    ("cecill-2.1", "cecill", f"cecill (?:free software {_LICENSE} agreement )?(?:version |v ?)?2 1"),
    ("cecill-any", "cecill", f"cecill(?: {_LICENSE})?"),
    ("lppl-1.3c", "latex project", f"latex project public {_LICENSE} (?:version |v ?)?1 3c?"),
    ("lppl-any", "latex project", f"latex project public {_LICENSE}"),
    ("mulan-2.0", "mulan", f"mulan (?:psl|permissive software {_LICENSE}) ?(?:version |v ?)?2"),
    ("ipl-1.0", "ibm public", f"ibm public {_LICENSE}(?: (?:version )?1 0)?"),
    ("sleepycat", "sleepycat", f"sleepycat {_LICENSE}"),
    ("zpl-2.1", "zope", f"zope public {_LICENSE} (?:version |v ?)?2 1"),
    ("zpl-any", "zope", f"zope public {_LICENSE}"),
    ("apsl-2.0", "apple public", f"apple public source {_LICENSE} (?:version |v ?)?2(?: 0)?"),
    ("apsl-any", "apple public", f"apple public source {_LICENSE}"),
    ("upl-1.0", "universal permissive", f"universal permissive {_LICENSE}(?: (?:version |v ?)?1 0)?"),
    ("rpl-1.5", "reciprocal public", f"reciprocal public {_LICENSE}(?: 1 5)?"),
    ("qpl-1.0", "q public", f"q public {_LICENSE}(?: (?:version )?1 0)?"),
    ("ftl", "freetype", f"freetype (?:project )?{_LICENSE}"),
    ("ijg", "independent jpeg", "independent jpeg group"),
    ("libpng", "libpng", f"libpng {_LICENSE}"),
    ("curl", "curl", f"curl {_LICENSE}"),
    ("vim", "vim", f"vim {_LICENSE}"),
    ("hpnd", "historical permission", "historical permission notice and disclaimer"),
    ("fair", "fair", f"fair {_LICENSE}"),
    ("bigscience", "bigscience", f"bigscience (?:bloom )?rail (?:{_LICENSE} )?v?1 0"),
    ("llama-2", "llama 2", f"llama 2 community {_LICENSE}(?: agreement)?"),
    ("llama-3", "llama 3", f"llama 3(?: [1-3])? community {_LICENSE}(?: agreement)?"),
    ("gpl-classpath-exception", "classpath", "classpath exception"),
    ("polyform-nc-1.0.0", "polyform", f"polyform noncommercial {_LICENSE}(?: 1 0 0)?"),
    ("etalab-2.0", "etalab", f"(?:etalab )?open {_LICENSE} etalab(?: 2 0)?"),
    ("cdla-permissive-2.0", "community data", f"community data {_LICENSE} agreement permissive(?: version)? 2 0"),
    ("cdla-any", "community data", f"community data {_LICENSE} agreement"),
    ("public-domain", "public domain", "(?:released|dedicated|placed) (?:in|to|into) the public domain"),
    ("public-domain", "public domain", "(?:is|are) in the public domain"),
    ("no-warranty", "warranty", "without warranty of any kind(?: express or implied)?"),
    ("no-warranty", "warranties", "without warranties or conditions of any kind"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "permission of", "without (?:the )?(?:prior |express )*(?:written )?permission of"),
    ("reserved-some", "rights reserved", "some rights reserved"),
    ("reserved-none", "rights reserved", "no rights reserved"),
    ("reserved-all", "rights reserved", "all rights reserved"),
    ("copyright-notice", "copyright", "copyright (?:c )?(?:[12][0-9]{3} )+(?:by )?[^ ]+"),
    ("license-named", "licen", f"{_UNDER}[^ ]+(?: [^ ]+)? {_LICENSE}"),
    ("license-mention", "licen", f"{_LICENSE} agreement"),
]


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def reduced(text: Column) -> Column:
    """Words of a text, each between two single spaces (so two stand between neighbours); empty without words."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "  ")
    inner = F.trim(words)
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _found(words: Column, hit: Column) -> Column:
    """(start, end, order, label) of a rule's matches, in word numbers."""
    rule = hit["rule"]
    kind = "array<struct<start: int, end: int, order: int, label: string>>"
    state = F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("at"))

    def step(acc, pair):
        start = acc["at"] + _spaces(pair["gap"])
        length = _spaces(pair["match"]) + 1
        one = F.struct((start - 1).alias("start"), (start - 1 + length).alias("end"), rule["order"].alias("order"), rule["label"].alias("label"))
        more = F.struct(F.concat(acc["out"], F.array(one)).alias("out"), (start + length - 1).alias("at"))
        return F.when(pair["match"].isNull(), acc).otherwise(more)  # what follows the last match

    pairs = F.zip_with(F.split(words, rule["expression"]), hit["matches"], lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.aggregate(pairs, state, step, lambda acc: acc["out"])


def _hits(words: Column, rules: Column) -> Column:
    """(rule, matches) of the rules that match; a rule without a match costs one pass over the text."""
    tried = F.transform(rules, lambda r: F.struct(r.alias("rule"), F.regexp_extract_all(words, r["expression"], F.lit(0)).alias("matches")))
    return F.filter(tried, lambda h: F.size(h["matches"]) > 0)


def _resolved(found: Column) -> Column:
    """The detections that stay, from left to right."""
    by_place = F.array_sort(F.transform(found, lambda d: F.struct(d["start"], (-d["end"]).alias("back"), d["order"], d["label"])))
    kind = "array<struct<start: int, back: int, order: int, label: string>>"

    def by_priority(group):
        ranked = F.array_sort(F.transform(group, lambda d: F.struct(d["order"].alias("rank"), d["start"].alias("at"), d.alias("d"))))

        def step(kept, r):
            d = r["d"]
            meets = F.exists(kept, lambda k: (d["start"] < -k["back"]) & (k["start"] < -d["back"]))
            return F.when(meets, kept).otherwise(F.concat(kept, F.array(d)))

        return F.when(F.size(group) < 2, group).otherwise(F.array_sort(F.aggregate(ranked, F.array().cast(kind), step)))

    def sweep(acc, d):
        apart = d["start"] >= acc["end"]
        return F.struct(
            F.when(apart, F.concat(acc["out"], F.array(acc["group"]))).otherwise(acc["out"]).alias("out"),
            F.when(apart, F.array(d)).otherwise(F.concat(acc["group"], F.array(d))).alias("group"),
            F.greatest(acc["end"], -d["back"]).alias("end"),
        )

    state = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.array().cast(kind).alias("group"), F.lit(0).alias("end"))
    groups = F.aggregate(by_place, state, sweep, lambda acc: F.concat(acc["out"], F.array(acc["group"])))
    kept = F.flatten(F.transform(groups, by_priority))
    return F.transform(kept, lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["label"].alias("label")))


def scan(docs: DataFrame, rules: list[tuple[str, str, str]] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words``, for each base phrase its ``count, first`` and ``last`` place (``base``), and the resolved
    ``detections`` (start, end, label) of the rules, in word numbers, of every row."""
    rules = RULES if rules is None else rules
    # A generated column is worked out once, whatever uses it.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(reduced(F.col(text)))).alias("_words"))
    rows = rows.withColumn("n_words", (_spaces(F.col("_words")) / 2).cast("bigint"))

    base = []
    for phrase, label in BASE.items():
        spaced = F.lit(" " + phrase.replace(" ", "  ") + " ")
        size = len(phrase.split())
        count = ((F.length("_words") - F.length(F.replace(F.col("_words"), spaced, F.lit("")))) / F.length(spaced)).cast("bigint")
        before = F.substring_index("_words", " " + phrase.replace(" ", "  ") + " ", 1)
        after = F.substring_index("_words", " " + phrase.replace(" ", "  ") + " ", -1)
        base.append(F.struct(
            F.lit(label).alias("label"), count.alias("count"), (_spaces(before) / 2).cast("bigint").alias("first"),
            (F.col("n_words") - size - (_spaces(after) / 2).cast("bigint")).alias("last"),
        ))
    any_base = F.lit(False)
    for phrase in BASE:
        any_base = any_base | F.contains("_words", F.lit(" " + phrase.replace(" ", "  ") + " "))
    none = "array<struct<label: string, count: bigint, first: bigint, last: bigint>>"
    base = F.when(any_base, F.filter(F.array(*base), lambda b: b["count"] > 0)).otherwise(F.array().cast(none))

    by_key: dict[str, list[Column]] = {}
    for i, (label, key, x) in enumerate(rules):
        expression = F.lit(f"(?<= )(?:{x})(?= )")
        by_key.setdefault(key, []).append(F.struct(F.lit(label).alias("label"), expression.alias("expression"), F.lit(i).alias("order")))
    table = F.array(*[F.struct(F.lit(key).alias("keyword"), F.array(*those).alias("rules")) for key, those in by_key.items()])
    keys = sorted({key for _, key, _ in rules}, key=len)
    gates = [k for i, k in enumerate(keys) if not any(k.find(s) >= 0 for s in keys[:i])]  # a keyword within another stands for both
    gate = F.lit(False)
    for k in gates:
        gate = gate | F.contains("_words", F.lit(k.replace(" ", "  ")))
    single = F.replace(F.col("_words"), F.lit("  "), F.lit(" "))

    def detected(w):
        keyed = F.filter(table, lambda k: F.contains(w, k["keyword"]))
        return F.flatten(F.transform(_hits(w, F.flatten(F.transform(keyed, lambda k: k["rules"]))), lambda h: _found(w, h)))

    found = F.transform(F.array(single), detected)
    detections = F.when(gate, _resolved(found[0])).otherwise(F.array().cast("array<struct<start: int, end: int, label: string>>"))
    return rows.select("doc_id", "n_words", base.alias("base"), detections.alias("detections"))
