"""License detection by ordered signature rules, with DataFrame functions only.

A text is normalised to its words with single spaces between them. Each rule is a regex over whole
words with a keyword; texts without any rule's stem are not normalised at all, and a rule's regex
only runs where its keyword occurs. Detections are word intervals. Where two overlap, the one of
the stronger rule stays (a named version over a bare name over a generic notice); between equally
strong ones the containing interval stays, and the smaller label where the intervals are equal.

The base phrases are found apart from that, at all their places, and keep their labels whatever the
rules do. Everything is computed inside the row: no shuffle, no broadcast.

Defined results: a null or empty text has no words and no labels; score is the strength of the
strongest detection kept (0 without any); rows repeat as in the input; a table may be empty; input
columns called like an output column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lapsewise.llm.text import lower_ascii, without

BASE = {
    "gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit",
}
STRENGTH = {1: 1.0, 2: 0.8, 3: 0.5}
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Words before lower-casing, to count them without normalising.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OUTPUT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    regex: str
    priority: int


# (label, short name, full name, keyword of the full name, versions); normalised, a version 2.0 reads "2 0".
FAMILIES = (
    ("gpl", "(?:gnu )?gpl", "(?:gnu )?general public", "general public", ("1", "2", "3")),
    ("lgpl", "(?:gnu )?lgpl", "(?:gnu )?(?:lesser|library) general public", "general public", ("2", "2 1", "3")),
    ("agpl", "(?:gnu )?agpl", "(?:gnu )?affero general public", "affero", ("1", "3")),
    ("apache", "apache", "apache(?: software)?", "apache", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", "mozilla public", "mozilla", ("1 0", "1 1", "2 0")),
    ("epl", "epl", "eclipse public", "eclipse", ("1 0", "2 0")),
    ("cddl", "cddl", "common development and distribution", "common development", ("1 0", "1 1")),
    ("eupl", "eupl", "european union public", "european union", ("1 0", "1 1", "1 2")),
    ("afl", "afl", "academic free", "academic free", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("osl", "osl", "open software", "open software", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("artistic", "artistic", "(?:the )?(?:perl )?artistic", "artistic", ("1 0", "2 0")),
    ("ecl", "ecl", "educational community", "educational community", ("1 0", "2 0")),
    ("cpl", "cpl", "common public", "common public", ("1 0",)),
    ("ofl", "(?:sil )?ofl", "(?:sil )?open font", "open font", ("1 0", "1 1")),
    ("lppl", "lppl", "latex project public", "latex", ("1 0", "1 1", "1 2", "1 3c")),
    ("bsl", "bsl", "boost software", "boost", ("1 0",)),
    ("odbl", "odbl", "open (?:data commons open )?database", "database", ("1 0",)),
    ("sspl", "sspl", "server side public", "server side", ("1",)),
    ("busl", "busl", "business source", "business source", ("1 1",)),
    ("psf", "psf", "python(?: software foundation)?", "python", ("2 0",)),
)
ATTRIBUTION = {
    "by": "", "by sa": " share ?alike", "by nc": " non ?commercial", "by nd": " no ?deriv(?:ative)?s?",
    "by nc sa": " non ?commercial share ?alike", "by nc nd": " non ?commercial no ?deriv(?:ative)?s?",
}
# (label, keyword, regex, priority)
SINGLE = (
    ("mit", "mit", "(?:the )?mit licen[sc]e", 2), ("mit", "mit", "licen[sc]ed under (?:the )?mit", 2), ("mit", "expat", "expat licen[sc]e", 2),
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy", 1),
    ("isc", "isc", "(?:the )?isc licen[sc]e", 2),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 1),
    ("zlib", "zlib", "(?:the )?zlib(?: libpng)? licen[sc]e", 2), ("unlicense", "unlicense", "(?:the )?unlicense", 2),
    ("wtfpl", "wtfpl", "wtfpl", 2), ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[sc]e", 2),
    ("postgresql", "postgresql", "postgresql licen[sc]e", 2), ("beerware", "beer", "beer ?ware licen[sc]e", 2),
    ("openssl", "openssl", "openssl licen[sc]e", 2), ("vim", "vim", "vim licen[sc]e", 2), ("php", "php", "php licen[sc]e", 2),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e", 2), ("ms-rl", "microsoft", "microsoft reciprocal licen[sc]e", 2),
    ("bsd", "bsd", "(?:the )?bsd licen[sc]e", 2), ("bsd-3-clause", "bsd", "(?:new|modified|revised) bsd(?: licen[sc]e)?", 1),
    ("bsd-2-clause", "bsd", "(?:simplified|free) ?bsd(?: licen[sc]e)?", 1), ("bsd-4-clause", "bsd", "(?:original|old) bsd(?: licen[sc]e)?", 1),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 2),
    ("cc0-1.0", "cc0", "cc0 1 0(?: universal)?", 1), ("cc0", "cc0", "cc0", 2), ("cc0", "creative", "creative commons zero", 2),
    ("cc", "creative", "creative commons(?: licen[sc]e)?", 3), ("public-domain", "domain", "(?:in|into|to) the public domain", 2),
    ("pddl", "pddl", "pddl(?: 1 0)?", 2), ("proprietary", "reserved", "all rights reserved", 3),
    ("notice", "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}", 3), ("notice", "spdx", "spdx licen[sc]e identifier", 3),
    ("notice", "licen", "licen[sc]ed under (?:the )?(?:terms of (?:the )?)?[a-z0-9]+", 3),
    ("notice", "licen", "(?:released|distributed|available) under (?:the )?(?:terms of (?:the )?)?[a-z0-9]+(?: [a-z0-9]+)? licen[sc]e", 3),
    ("notice", "warranty", "without warranty of any kind", 3),
)


# Short names that are words of their own in no language, so that they count without "license" behind them.
DISTINCT = ("gpl", "lgpl", "agpl", "mpl", "cddl", "eupl", "sspl", "odbl", "lppl", "apache", "artistic")


def _families() -> Iterable[Rule]:
    for label, short, full, keyword, versions in FAMILIES:
        named = "(?: licen[sc]e)?" if label in DISTINCT else " licen[sc]e"
        for version in versions:
            tag = f"{label}-{version.replace(' ', '.') if ' ' in version else version + '.0'}"
            number = version if " " in version else f"{version}(?: 0)?"
            for later, ending in (("", "(?: only)?"), ("-or-later", " or(?: any)? later(?: version)?")):
                yield Rule(tag + later, label, f"{short}{named}(?: version)? v?{number}{ending}", 1)
                yield Rule(tag + later, keyword, f"{full} licen[sc]e(?: version)? v?{number}{ending}", 1)
                if label in DISTINCT:
                    yield Rule(tag + later, label, f"{short}v{number}{ending}", 1)
        yield Rule(label, keyword, f"{full} licen[sc]e", 2)
        if label in DISTINCT[:-2]:
            yield Rule(label, label, f"{short}{named}", 2)


def _attribution() -> Iterable[Rule]:
    for short, long in ATTRIBUTION.items():
        label = "cc-" + short.replace(" ", "-")
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            tag = f"{label}-{version.replace(' ', '.')}"
            yield Rule(tag, "cc", f"cc {short}(?: licen[sc]e)? {version}", 1)
            yield Rule(tag, "creative", f"creative commons attribution{long}(?: licen[sc]e)? {version}", 1)
        yield Rule(label, "cc", f"cc {short}", 2)
        yield Rule(label, "creative", f"creative commons attribution{long}(?: licen[sc]e)?", 2)


def _bsd() -> Iterable[Rule]:
    for count, word in enumerate(("zero", "one", "two", "three", "four")):
        for form in ("bsd (?:{0}|{1}) clause", "(?:{0}|{1}) clause bsd", "0bsd" if not count else "bsd licen[sc]e (?:{0}|{1}) clause"):
            yield Rule(f"bsd-{count}-clause", "bsd", form.format(count, word), 1)


def rules() -> list[Rule]:
    return [*_families(), *_attribution(), *_bsd(), *(Rule(*r) for r in SINGLE)]


def stems(known: list[Rule]) -> list[str]:
    """Strings of which every text with a detection holds one; `cc` is left to a regex of its own."""
    # An optional "license" stands in a group of its own, a required one does not.
    words = {"licen" if re.search(r"(?<!\(\?: )licen", r.regex) else r.keyword.split(" ")[0] for r in known}
    words |= {"licen" if "license" in p else p.split(" ")[0] for p in BASE}
    words = sorted(words - {"cc", "cc0"}, key=lambda w: (len(w), w))
    return [w for i, w in enumerate(words) if not any(o in w for o in words[:i])]


def normalised(text: Column) -> Column:
    """The words with a space before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text), BREAK, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def places(text: Column, regex: Column) -> Column:
    """Where a regex over whole words matches: array of (first, last word, matched words)."""
    found = F.regexp_extract_all(text, regex, F.lit(0))
    between = F.split(text, regex, -1)
    empty = F.array().cast("array<struct<first:int,last:int,words:string>>")

    def step(state: Column, pair: Column) -> Column:
        first = state["at"] + _spaces(pair["before"])
        last = first + _spaces(pair["words"])
        one = F.struct(first.alias("first"), last.alias("last"), pair["words"].alias("words"))
        return F.struct(last.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, w: F.struct(b.alias("before"), w.alias("words")))
    begin = F.struct(F.lit(-1).alias("at"), empty.alias("found"))
    return F.when(F.size(found) > 0, F.aggregate(pairs, begin, step)["found"]).otherwise(empty)


def _whole(body: str) -> str:
    return f"(?<= )(?:{body})(?= )"


def _detections(text: Column, known: list[Rule]) -> Column:
    table = F.array(*[
        F.struct(F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(_whole(r.regex)).alias("regex"), F.lit(r.priority).alias("priority"))
        for r in known
    ])
    active = F.filter(table, lambda r: F.contains(text, r["keyword"]))
    return F.array_distinct(F.flatten(F.transform(active, lambda r: F.transform(
        places(text, r["regex"]),
        lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), r["priority"].alias("priority"), r["label"].alias("label")),
    ))))


def _unbeaten(found: Column) -> Column:
    def beats(e: Column, d: Column) -> Column:
        overlap = (e["first"] <= d["last"]) & (d["first"] <= e["last"])
        contains = (e["first"] <= d["first"]) & (e["last"] >= d["last"])
        wider = (e["last"] - e["first"]) > (d["last"] - d["first"])
        return overlap & ((e["priority"] < d["priority"]) | (
            (e["priority"] == d["priority"]) & contains & (wider | (e["label"] < d["label"]))
        ))

    return F.filter(found, lambda d: ~F.exists(found, lambda e: beats(e, d)))


def scan(docs: DataFrame, known: list[Rule] | None = None) -> DataFrame:
    """The documents with their license findings; `detections` holds the kept (first, last, priority, label)."""
    known = rules() if known is None else known
    docs = without(docs, OUTPUT)
    low = F.lower("text")
    gate = low.rlike(f"cc{BREAK}by|cc0")
    for stem in stems(known):
        gate = gate | F.contains(low, F.lit(stem))
    phrases = _whole("|".join(BASE))
    base = F.transform("_license_base", lambda p: p["first"])
    names = F.array_sort(F.array_distinct(F.transform("_license_base", lambda p: F.element_at(
        F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair]), p["words"]
    ))))
    added = F.transform("detections", lambda d: d["label"])
    strength = F.create_map(*[F.lit(x) for pair in STRENGTH.items() for x in pair])
    best = F.array_max(F.transform("detections", lambda d: F.element_at(strength, d["priority"])))
    none = F.array().cast("array<struct<first:int,last:int,words:string>>")
    blank = F.array().cast("array<struct<first:int,last:int,priority:int,label:string>>")
    return (
        docs.withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(ANY_WORD)), F.lit(0)).cast("bigint"))
        .withColumn("_license_words", F.when(gate, normalised(F.col("text"))))
        .withColumn("_license_base", F.coalesce(F.when(F.col("_license_words").isNotNull(), places(F.col("_license_words"), F.lit(phrases))), none))
        .withColumn("_license_all", F.coalesce(F.when(F.col("_license_words").isNotNull(), _detections(F.col("_license_words"), known)), blank))
        .withColumn("detections", _unbeaten(F.col("_license_all")))
        .select(
            *docs.columns, "n_words", F.size("_license_base").cast("bigint").alias("n_base"),
            F.array_min(base).cast("bigint").alias("first_word"), F.array_max(base).cast("bigint").alias("last_word"),
            F.concat_ws(",", names).alias("base_labels"),
            F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(names, added)))).alias("labels"),
            F.coalesce(F.greatest(best, F.when(F.size("_license_base") > 0, F.lit(STRENGTH[2]))), F.lit(0.0)).alias("score"),
            "detections",
        )
    )
