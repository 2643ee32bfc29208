"""License scan, native: ordered signature rules behind a keyword gate, with priority and containment suppression.

Texts are scanned once for any gate stem; only those that hold one are normalised (A-Z lower-cased, words joined by one
space) and met by the rules whose keyword they contain. A detection inside another of the same or a better
priority is dropped. Everything is DataFrame expressions; no shuffle, no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words after lower-casing A-Z, and in the text as it stands.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: A text without any of these, case aside, has no detection: every spelling of every rule and base phrase holds one, or cc before by,
#: or one of VERBS before under, by or with.
GATE = ["licen", "copyright", "warrant", "public", "gpl", "apache", "creative", "permission", "redistrib", "rights", "cc0", "wtfpl", "attribution", "clause", "mpl", "epl", "cddl", "boost", "eclipse", "foundation", "documentation", "contributors"]
#: Verbs of FORMS that hold no stem: before under, by or with they pass the gate too.
VERBS = ["released", "distributed", "available", "published", "provided", "covered", "shared"]

_VERSION = r"(?: v| version| ver)?"
#: Licenses: label, pattern of its name in normalised text, keywords of which every such name has one, and whether the
#: bare name is enough.
LICENSES = [
    ("mit", r"(?:mit|expat|x11)", " mit | expat | x11 ", False), ("mit-0", r"mit no attribution", "mit no attribution", True), ("mit-modern", r"modern mit", "modern mit", False),
    ("apache-1.1", rf"apache(?: software)? license{_VERSION} 1 1", "apache", True), ("apache-2", rf"apache(?: software)?(?: license)?{_VERSION} 2(?: 0)?", "apache", True), ("apache", r"apache(?: software)?", "apache", False),
    ("gpl-1", rf"(?:gnu )?(?:general public license|gpl){_VERSION} 1(?: 0)?", "general public license|gpl", True), ("gpl-2", rf"(?:gnu )?(?:general public license|gpl){_VERSION} 2(?: 0)?", "general public license|gpl", True), ("gpl-3", rf"(?:gnu )?(?:general public license|gpl){_VERSION} 3(?: 0)?", "general public license|gpl", True), ("gpl", r"gnu (?:general public license|gpl)", "gnu g", True), ("gplv2", r"gplv2", "gplv2", True), ("gplv3", r"gplv3", "gplv3", True),
    ("lgpl-2", rf"(?:gnu )?(?:library general public license|lgpl){_VERSION} 2 0", "library general public|lesser general public|lgpl", True), ("lgpl-2.1", rf"(?:gnu )?(?:lesser general public license|lgpl){_VERSION} 2 1", "library general public|lesser general public|lgpl", True), ("lgpl-3", rf"(?:gnu )?(?:lesser general public license|lgpl){_VERSION} 3(?: 0)?", "library general public|lesser general public|lgpl", True), ("lgpl", r"gnu (?:lesser general public license|library general public license|lgpl)", "gnu l", True),
    ("agpl-3", rf"(?:gnu )?(?:affero general public license|agpl){_VERSION} 3(?: 0)?", "affero general public|agpl", True), ("agpl", r"gnu (?:affero general public license|affero gpl|agpl)", "gnu a", True), ("gfdl", rf"gnu free documentation license(?:{_VERSION} 1 \d)?", "gnu free documentation", True),
    ("bsd-0", r"(?:0|zero) clause bsd", "clause bsd", True), ("bsd-2", r"(?:(?:2|two) clause bsd|bsd 2 clause|simplified bsd|freebsd)", "bsd", False), ("bsd-3", r"(?:(?:3|three) clause bsd|bsd 3 clause|(?:new|modified|revised) bsd)", "bsd", False), ("bsd-4", r"(?:(?:4|four) clause bsd|bsd 4 clause|original bsd)", "bsd", False), ("bsd", r"bsd(?: style)?", "bsd", False),
    ("mpl-1.1", rf"(?:mozilla public license|mpl){_VERSION} 1 1", "mozilla public| mpl ", True), ("mpl-2", rf"(?:mozilla public license|mpl){_VERSION} 2(?: 0)?", "mozilla public| mpl ", True), ("mpl", r"mozilla public", "mozilla public", False),
    ("epl-1", rf"(?:eclipse public license|epl){_VERSION} 1(?: 0)?", "eclipse public| epl ", True), ("epl-2", rf"(?:eclipse public license|epl){_VERSION} 2(?: 0)?", "eclipse public| epl ", True), ("epl", r"eclipse public", "eclipse public", False), ("edl", rf"eclipse distribution license(?:{_VERSION} 1(?: 0)?)?", "eclipse distribution", True),
    ("cddl-1", rf"(?:common development and distribution license|cddl){_VERSION} 1(?: 0)?", "common development|cddl", True), ("cpl", rf"common public license(?:{_VERSION} 1(?: 0)?)?", "common public", True), ("eupl", rf"european union public licen[cs]e(?:{_VERSION} 1 \d)?", "european union public", True),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?deriv\w*)", " cc by | cc attribution|creative commons", True), ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike)", " cc by | cc attribution|creative commons", True), ("cc-by-nc", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial)", " cc by | cc attribution|creative commons", True), ("cc-by-sa", r"(?:cc|creative commons) (?:by|attribution) (?:sa|share ?alike)", " cc by | cc attribution|creative commons", True), ("cc-by-nd", r"(?:cc|creative commons) (?:by|attribution) (?:nd|no ?deriv\w*)", " cc by | cc attribution|creative commons", True), ("cc-by", r"(?:cc|creative commons) (?:by|attribution)", " cc by | cc attribution|creative commons", True), ("cc0", r"(?:cc0|creative commons zero)", " cc0 |creative commons zero", True), ("cc", r"creative commons", "creative commons", False),
    ("artistic-1", rf"artistic license{_VERSION} 1(?: 0)?", "artistic license", True), ("artistic-2", rf"artistic license{_VERSION} 2(?: 0)?", "artistic license", True), ("boost", rf"boost software(?: license)?(?:{_VERSION} 1(?: 0)?)?", "boost software", True), ("isc", r"isc", "isc", False), ("zlib", r"(?:zlib|zlib libpng)", "zlib", False), ("libpng", r"libpng", "libpng", False),
    ("unlicense", r"unlicense", "unlicense", True), ("wtfpl", r"(?:wtfpl|do what the fuck you want to public license)", "wtfpl|do what the fuck", True), ("python", r"python software foundation(?: license)?", "python software foundation", True), ("postgresql", r"postgresql", "postgresql", False), ("php", rf"php license{_VERSION} 3(?: 0\d?)?", "php license", True), ("ruby", r"ruby", "ruby", False),
    ("openssl", r"openssl", "openssl", False), ("odbl", rf"open (?:data commons open )?database license(?:{_VERSION} 1(?: 0)?)?", "database license", True), ("odc-by", r"open data commons attribution", "open data commons attribution", False), ("pddl", r"public domain dedication and license", "public domain dedication", True), ("ofl-1.1", rf"(?:sil )?open font license(?:{_VERSION} 1 1)?", "open font license", True), ("ms-pl", r"microsoft public", "microsoft public", False), ("ms-rl", r"microsoft reciprocal", "microsoft reciprocal", False), ("osl-3", rf"open software license{_VERSION} 3(?: 0)?", "open software license", True), ("afl-3", rf"academic free license{_VERSION} 3(?: 0)?", "academic free license", True), ("upl", r"universal permissive", "universal permissive", False), ("vim", r"vim", "vim", False), ("sleepycat", r"sleepycat", "sleepycat", False), ("bsl-1.1", rf"business source license(?:{_VERSION} 1 1)?", "business source license", True), ("sspl-1", rf"server side public license(?:{_VERSION} 1)?", "server side public", True), ("elastic-2", rf"elastic license(?:{_VERSION} 2(?: 0)?)?", "elastic license", True), ("rail", r"(?:open)?rail(?: m)?", "rail", False), ("llama", r"llama \d community", "llama", False),
]
#: How a name stands: pattern around it, keyword (empty where no text is in every match), priority (0 is best) and confidence.
FORMS = [
    (r"spdx license identifier {name}", "spdx license identifier", 0, 1.0),
    (r"(?:licen[cs]ed|released|distributed|available|published|provided|covered|dual licen[cs]ed|made available|shared)(?: to you)? (?:under|by|with)(?: the)?(?: terms of)?(?: the)? {name}(?: licen[cs]e)?", "", 1, 0.95),
    (r"{name} licen[cs]e", "licen", 2, 0.8),
]
#: Sentences that only one license's text has: label, pattern, keyword, confidence.
SENTENCES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted", 0.9), ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission to use", 0.9), ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", 0.85), ("bsd-3", r"neither the name of .{1,80}? nor the names of its contributors", "names of its contributors", 0.8), ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the license", "license", 0.9), ("gpl", r"this program is free software you can redistribute it and or modify", "redistribute", 0.85), ("lgpl", r"this library is free software you can redistribute it and or modify", "redistribute", 0.85), ("mpl-2", r"this source code form is subject to the terms of the mozilla public license", "mozilla public", 0.95),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors", "warranty", 0.8), ("unlicense", r"this is free and unencumbered software released into the public domain", "public domain", 0.95), ("boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy", "permission is hereby granted", 0.95), ("public-domain", r"(?:released into|placed in|dedicated to|in) the public domain", "public domain", 0.7), ("cc0", r"waived all copyright and related or neighboring rights", "copyright", 0.9), ("proprietary", r"all rights reserved", "rights reserved", 0.6), ("proprietary", r"(?:confidential and proprietary|proprietary and confidential) licen\w+", "licen", 0.7), ("copyright", r"copyright (?:c )?(?:19|20)\d\d", "copyright", 0.4), ("no-warranty", r"without warranty of any kind", "warranty", 0.3), ("license-mention", r"(?:this|the) (?:work|software|file|document|dataset|text) is licensed", "licensed", 0.3),
]


def rules() -> list[tuple[str, str, str, str, int, float]]:
    """(label, regex over normalised text, text that must be in it, keywords of which one must be, priority, confidence), in order; about 300."""
    out = [(label, form.format(name=name), need, keywords, priority, sure) for form, need, priority, sure in FORMS for label, name, keywords, _ in LICENSES]
    out += [(label, pattern, keyword, "", 2, sure) for label, pattern, keyword, sure in SENTENCES]
    out += [(label, name, "", keywords, 3, 0.6) for label, name, keywords, alone in LICENSES if alone]
    return [(label, rf"(?<= )(?:{pattern})(?= )", need, keywords, priority, float(sure)) for label, pattern, need, keywords, priority, sure in out]


def _gate(text: Column) -> Column:
    """Over a lower-cased text. Lower-casing can only add matches: it leaves no ASCII letter another one."""
    cc = F.contains(text, F.lit("cc")) & text.rlike(r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by")
    any_of = lambda stems: reduce(lambda a, b: a | b, [F.contains(text, F.lit(stem)) for stem in stems])
    verb = any_of(VERBS) & text.rlike(rf"(?:{'|'.join(VERBS)}){GAP}(?:to{GAP}you{GAP})?(?:under|by|with)")
    return any_of(GATE) | cc | verb


def _rule_array() -> Column:
    one = lambda label, pattern, need, keywords, priority, sure: F.struct(
        F.lit(label).alias("label"), F.lit(pattern).alias("pattern"), F.lit(need).alias("need"), F.array(*map(F.lit, keywords.split("|"))).alias("keywords"), F.lit(priority).alias("priority"), F.lit(sure).alias("sure")
    )
    return F.array(*[one(*r) for r in rules()])


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, detections and score to every row of ``docs`` (column text).

    Null and empty texts have no words and no labels (empty strings), null first_word and last_word, score 0. Rows that
    repeat stay as many rows; columns of ``docs`` named like the results are replaced. ``score`` is the largest confidence among
    the detections that stay (0.95 for a base phrase). Detections are structs of label, start and end character
    in the normalised text, priority and confidence; those of one text grow with its length only.
    """
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "detections", "score")
    kept = [c for c in docs.columns if c not in added]
    text = F.coalesce(F.col("text"), F.lit(""))
    low = docs.select(*kept, text.alias("__t"), F.lower(text).alias("__low"))
    low = low.select(*kept, "__t", "__low", F.split("__t", GAP_ANY_CASE, -1).alias("__w"))
    text, edge = F.col("__t"), lambda i: (F.element_at("__w", i) == "").cast("int")
    # Splitting is many times faster here than counting matches; a gap at either end leaves an empty part.
    n_words = F.size("__w") - edge(1) - F.when(F.size("__w") > 1, edge(-1)).otherwise(0)
    one = low.select(*kept, n_words.cast("long").alias("n_words"), F.when(_gate(F.col("__low")), F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, " ")), F.lit(" "))).alias("__s"))
    parts = [F.split("__s", rf"(?<= ){phrase}(?= )", -1).alias(f"__p{i}") for i, (phrase, _) in enumerate(BASE)]
    two = one.select(*kept, "n_words", "__s", *parts)
    counts = [F.coalesce(F.size(F.col(f"__p{i}")) - 1, F.lit(0)) for i in range(len(BASE))]
    counts = [F.greatest(c, F.lit(0)) for c in counts]
    firsts = [F.when(c > 0, _spaces(F.get(F.col(f"__p{i}"), F.lit(0))) - 1) for i, c in enumerate(counts)]
    lasts = [F.when(c > 0, F.col("n_words") - (_spaces(F.get(F.col(f"__p{i}"), c)) - 1) - len(phrase.split())) for i, (c, (phrase, _)) in enumerate(zip(counts, BASE, strict=True))]
    total = sum(counts[1:], counts[0]).cast("long")
    base = F.array_compact(F.array(*[F.when(c > 0, F.lit(label)) for c, (_, label) in zip(counts, BASE, strict=True)]))

    def found(r: Column) -> Column:
        """One rule's detections: gaps and matches take turns, so a match starts where all before it ends."""
        gaps, matches = F.split(F.col("__s"), r["pattern"], -1), F.regexp_extract_all(F.col("__s"), r["pattern"], F.lit(0))
        ends = F.aggregate(
            F.arrays_zip(gaps.alias("gap"), matches.alias("match")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out")),
            lambda a, x: F.struct(
                (a["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))).alias("at"),
                F.when(x["match"].isNotNull(), F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["gap"])).alias("s"), (a["at"] + F.length(x["gap"]) + F.length(x["match"])).alias("e"))))).otherwise(a["out"]).alias("out"),
            ),
        )["out"]
        return F.transform(ends, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("minus_e"), r["priority"].alias("priority"), r["label"].alias("label"), r["sure"].alias("sure")))

    detected = F.when(F.col("__s").isNotNull(), F.array_sort(F.flatten(F.transform(F.filter(_rule_array(), lambda r: F.contains(F.col("__s"), r["need"]) & F.exists(r["keywords"], lambda k: F.contains(F.col("__s"), k))), found))))
    three = two.select(*kept, "n_words", total.alias("n_base"), F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"), base.alias("__base"), detected.alias("__d"))
    kinds = "array<struct<label:string,start:int,end:int,priority:int,sure:double>>"
    reach = [f"m{p}" for p in range(4)]

    def keep(a: Column, x: Column) -> Column:
        """In order of start, longest first: x goes if an earlier one of the same or a better priority reaches its end."""
        end = -x["minus_e"]
        best = F.greatest(*[F.when(x["priority"] >= p, a[m]).otherwise(F.lit(-1)) for p, m in enumerate(reach)])
        now = F.array(F.struct(x["label"].alias("label"), x["s"].alias("start"), end.alias("end"), x["priority"].alias("priority"), x["sure"].alias("sure")))
        return F.struct(*[F.when(x["priority"] == p, F.greatest(a[m], end)).otherwise(a[m]).alias(m) for p, m in enumerate(reach)], F.when(best >= end, a["out"]).otherwise(F.concat(a["out"], now)).alias("out"))

    stay = F.coalesce(F.aggregate("__d", F.struct(*[F.lit(-1).alias(m) for m in reach], F.array().cast(kinds).alias("out")), keep)["out"], F.array().cast(kinds))
    four = three.select(*kept, "n_words", "n_base", "first_word", "last_word", "__base", stay.alias("detections"))
    labels = F.array_sort(F.array_distinct(F.concat("__base", F.transform("detections", lambda x: x["label"]))))
    sure = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda x: x["sure"])), F.lit(0.0)), F.when(F.col("n_base") > 0, 0.95).otherwise(0.0))
    return four.select(*kept, "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("__base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "detections", sure.alias("score"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLE: dict[str, str] = {}
