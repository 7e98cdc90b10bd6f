"""License scans: ordered signature rules, gated by keywords, resolved by priority and by which interval contains which.

Method. A text becomes its lower-case words with one blank between them. A rule has a level (0: text of a license, 1: tag, 2: notice
that names one, 3: bare name), a label, keywords and a regular expression over words. A rule runs only on texts that contain one of its
keywords, and no rule runs on texts without any gate word. All detections of a text are then ordered by start, longest first, better
level first, earlier rule first; one that lies within another of the same or a better level is suppressed. The labels of what stays
and of the base phrases are the text's labels; the score is the highest relevance among them (base phrases: 0.9), 0 without any.

Defined cases: a null text is empty; places are counted in words from 0; a phrase may begin where another ends; repeated rows are
judged alike; other columns are left out by the query and never looked at here. Only DataFrame functions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspan.llm.common import let, matches, no_nulls

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE_RELEVANCE = 0.9
GATES = ("licen", "copyright", "spdx", "warrant", "public domain", "creative commons", "cc by", "cc0", "permission", "redistribution")

# (label, keyword that a text must hold, expression for the name), most specific first within a family.
NAMES = [
    ("mit-0", "mit", r"mit (?:0|no attribution)"),
    ("mit-modern", "mit", r"modern mit"),
    ("mit", "mit", r"(?:mit|expat)(?: x11)?"),
    ("x11", "x11", r"x11"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version| v)? ?1 1"),
    ("apache-1.0", "apache", r"apache(?: software)?(?: license)?(?: version| v)? ?1 0"),
    ("agpl-3", "affero", r"(?:gnu )?affero(?: general public)?(?: license)?(?: version| v)? ?3(?: 0)?"),
    ("agpl-3", "agpl", r"a ?gpl(?: version)? ?v?3(?: 0)?"),
    ("agpl-1", "affero", r"affero(?: general public)?(?: license)?(?: version| v)? ?1(?: 0)?"),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser general public(?: license)?(?: version| v)? ?3(?: 0)?"),
    ("lgpl-3", "lgpl", r"lgpl(?: version)? ?v?3(?: 0)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public(?: license)?(?: version| v)? ?2 1"),
    ("lgpl-2.1", "lgpl", r"lgpl(?: version)? ?v?2 1"),
    ("lgpl-2", "library general", r"(?:gnu )?library general public(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("lgpl-2", "lgpl", r"lgpl(?: version)? ?v?2(?: 0)?"),
    ("gpl-3", "general public", r"(?:gnu )?general public(?: license)?(?: version| v)? ?3(?: 0)?"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl(?: version)? ?v?3(?: 0)?"),
    ("gpl-2", "general public", r"(?:gnu )?general public(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl(?: version)? ?v?2(?: 0)?"),
    ("gpl-1", "gpl", r"(?:gnu )?gpl(?: version)? ?v?1(?: 0)?"),
    ("gfdl-1.3", "free documentation", r"(?:gnu )?free documentation(?: license)?(?: version| v)? ?1 3"),
    ("gfdl-1.2", "free documentation", r"(?:gnu )?free documentation(?: license)?(?: version| v)? ?1 2"),
    ("bsd-0", "bsd", r"(?:bsd 0 clause|0bsd|zero clause bsd)"),
    ("bsd-1", "bsd", r"(?:bsd 1 clause|1 clause bsd)"),
    ("bsd-2", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clear", "bsd", r"(?:bsd 3 clause clear|clear bsd)"),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd)"),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)"),
    ("bsd", "bsd", r"bsd"),
    ("mpl-2", "mozilla", r"mozilla public(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("mpl-2", "mpl", r"mpl(?: version)? ?v?2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public(?: license)?(?: version| v)? ?1 1"),
    ("mpl-1.1", "mpl", r"mpl(?: version)? ?v?1 1"),
    ("epl-2", "eclipse", r"eclipse public(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("epl-2", "epl", r"epl(?: version)? ?v?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public(?: license)?(?: version| v)? ?1(?: 0)?"),
    ("epl-1", "epl", r"epl(?: version)? ?v?1(?: 0)?"),
    ("edl-1", "eclipse", r"eclipse distribution(?: license)?(?: version| v)? ?1(?: 0)?"),
    ("cddl-1.1", "cddl", r"cddl(?: version)? ?v?1 1"),
    ("cddl-1", "cddl", r"cddl(?: version)? ?v?1(?: 0)?"),
    ("cddl-1", "common development", r"common development and distribution(?: license)?"),
    ("cpl-1", "common public", r"common public(?: license)?(?: version| v)? ?1(?: 0)?"),
    ("ipl-1", "ibm public", r"ibm public(?: license)?"),
    ("osl-3", "open software", r"open software(?: license)?(?: version| v)? ?3(?: 0)?"),
    ("afl-3", "academic free", r"academic free(?: license)?(?: version| v)? ?3(?: 0)?"),
    ("artistic-2", "artistic", r"artistic(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("artistic-1", "artistic", r"artistic(?: license)?(?: version| v)? ?1(?: 0)?"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"(?:zlib(?: libpng)?|libpng zlib)"),
    ("libpng", "libpng", r"libpng"),
    ("bsl-1", "boost", r"boost software(?: license)?(?: version| v)?(?: ?1(?: 0)?)?"),
    ("bsl-1", "bsl", r"bsl 1 0"),
    ("busl-1.1", "business source", r"business source(?: license)?(?: version| v)?(?: ?1 1)?"),
    ("sspl-1", "server side", r"server side public(?: license)?(?: version| v)?(?: ?1)?"),
    ("elastic-2", "elastic", r"elastic(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("cc0-1", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc by nc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by nc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "noncommercial", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?"),
    ("cc-by-nc-sa", "noncommercial", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "noncommercial", r"creative commons attribution non ?commercial"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s?"),
    ("cc-by", "creative commons", r"creative commons attribution"),
    ("odbl", "open database", r"open database(?: license)?"),
    ("odc-by", "odc", r"odc by"),
    ("pddl", "pddl", r"pddl"),
    ("ofl-1.1", "open font", r"(?:sil )?open font(?: license)?(?: version| v)?(?: ?1 1)?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("python-2", "psf", r"(?:psf|python software foundation)"),
    ("ruby", "ruby", r"ruby"),
    ("php-3", "php", r"php(?: version| v)? ?3(?: 01)?"),
    ("postgresql", "postgresql", r"postgresql"),
    ("openssl", "openssl", r"openssl"),
    ("curl", "curl", r"curl"),
    ("vim", "vim", r"vim"),
    ("upl-1", "universal permissive", r"universal permissive(?: license)?"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "microsoft", r"microsoft reciprocal"),
    ("eupl-1.2", "eupl", r"eupl(?: version| v)? ?1 2"),
    ("eupl-1.2", "european union", r"european union public(?: licen[cs]e)?"),
    ("cecill-2.1", "cecill", r"cecill(?: version| v)? ?2(?: 1)?"),
    ("mulan-2", "mulan", r"mulan(?: psl| permissive software)"),
    ("blueoak-1", "blue oak", r"blue oak model"),
]

# (level, label, keyword, expression, relevance) of passages from license texts and of notices that name no family.
TEXTS = [
    (0, "mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 1.0),
    (0, "isc", "permission", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee", 1.0),
    (0, "apache-2", "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance", 1.0),
    (0, "bsd-4", "redistribution", r"redistribution and use in source and binary forms .{0,900}all advertising materials mentioning features", 1.0),
    (0, "bsd-3", "redistribution", r"redistribution and use in source and binary forms .{0,900}neither the name of", 1.0),
    (0, "bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    (0, "gpl", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    (0, "lgpl", "free software", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", 1.0),
    (0, "agpl-3", "affero", r"under the terms of the gnu affero general public license as published by the free software foundation", 1.0),
    (0, "mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    (0, "unlicense", "public domain", r"this is free and unencumbered software released into the public domain", 1.0),
    (0, "zlib", "warrant", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.95),
    (0, "bsl-1", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy", 1.0),
    (0, "wtfpl", "public license", r"do what the fuck you want to public license", 1.0),
    (0, "ofl-1.1", "font", r"this font software is licensed under the sil open font license", 1.0),
    (0, "cc0-1", "public domain", r"has waived all copyright and related or neighboring rights", 1.0),
    (2, "public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 0.8),
    (2, "proprietary", "rights reserved", r"all rights reserved", 0.4),
    (2, "proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 0.8),
    (2, "proprietary", "redistribut", r"(?:may|must|can) not be (?:copied|reproduced|redistributed) without(?: the)?(?: prior)?(?: express)? (?:written )?permission", 0.8),
    (2, "free-unknown", "open source", r"(?:released|available|distributed) under an? open source licen[cs]e", 0.5),
    (2, "see-license", "licen", r"see(?: the)?(?: accompanying)? licen[cs]e(?: file)?(?: txt| md)? for (?:details|more information|license information)", 0.3),
]


def rules() -> list[dict]:
    """The passages, then for every name a tag, two notices, a titled name and, where versions make it clear, the bare name."""
    made = [dict(zip(("level", "label", "keyword", "pattern", "relevance"), t)) for t in TEXTS]
    for label, keyword, name in NAMES:
        forms = [
            (1, f"spdx license identifier {name}", 1.0),
            (2, f"(?:licen[cs]ed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?{name}", 0.95),
            (2, f"(?:subject to|governed by|terms and conditions of|under) (?:the )?(?:terms of )?(?:the )?{name} licen[cs]e", 0.9),
            (3, f"{name} licen[cs]e", 0.7),
        ]
        if any(ch.isdigit() for ch in name) or name.startswith(("creative", "cc ")):
            forms.append((3, name, 0.5))
        made += [dict(level=lv, label=label, keyword=keyword, pattern=p, relevance=r) for lv, p, r in forms]
    for order, rule in enumerate(made):
        rule["rule"] = order
        rule["pattern"] = rf"(?<= )(?:{rule['pattern']})(?= )"
    return made


def worded(text: Column) -> Column:
    """The text's lower-case words, each between single blanks; a single blank if there are none."""
    # Beyond A-Z, lower() touches no character that separates words, and none that rules are made of.
    spaced = F.btrim(F.regexp_replace(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(spaced == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), spaced, F.lit(" ")))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _base(words: Column) -> Column:
    """Array of struct(label, n, first, last), one for each base phrase that stands somewhere."""
    n_words = _blanks(words) - 1

    def places(phrase: str, label: str) -> Column:
        def counted(parts: Column) -> Column:
            rest = _blanks(F.element_at(parts, -1)) - 1
            return F.struct(
                F.lit(label).alias("label"),
                (F.size(parts) - 1).cast("long").alias("n"),
                (_blanks(parts[0]) - 1).cast("long").alias("first"),
                (n_words - rest - len(phrase.split())).cast("long").alias("last"),
            )

        return F.when(F.contains(words, F.lit(f" {phrase} ")), let(F.split(words, f"(?<= ){phrase}(?= )", -1), counted))

    return F.filter(F.array(*(places(p, label) for p, label in BASE.items())), lambda b: b.isNotNull())


def _detections(words: Column) -> Column:
    """Array of struct(start, end, level, rule, label, relevance) after suppression; places in the worded text."""
    kind = "array<struct<level:int,label:string,keyword:string,pattern:string,relevance:double,rule:int>>"
    all_rules = F.from_json(F.lit(json.dumps(rules())), kind)
    gated = F.filter(all_rules, lambda r: F.contains(words, r["keyword"]))

    def found(r: Column) -> Column:
        return F.transform(
            matches(words, r["pattern"]),
            lambda m: F.struct(
                m["start"].alias("start"),
                (-m["end"]).alias("before"),
                r["level"].alias("level"),
                r["rule"].alias("rule"),
                r["label"].alias("label"),
                r["relevance"].alias("relevance"),
            ),
        )

    ordered = F.sort_array(F.flatten(F.transform(gated, found)))
    levels = sorted({r["level"] for r in rules()})
    empty = F.array().cast("array<struct<start:int,before:int,level:int,rule:int,label:string,relevance:double>>")
    first = F.struct(*(F.lit(-1).alias(f"to{lv}") for lv in levels), empty.alias("out"))

    def step(state: Column, d: Column) -> Column:
        end = -d["before"]
        reach = F.greatest(*(F.when(d["level"] >= lv, state[f"to{lv}"]).otherwise(F.lit(-1)) for lv in levels), F.lit(-1))
        ends = [
            F.when(d["level"] == lv, F.greatest(state[f"to{lv}"], end)).otherwise(state[f"to{lv}"]).alias(f"to{lv}") for lv in levels
        ]
        out = F.when(reach >= end, state["out"]).otherwise(F.concat(state["out"], F.array(d)))
        return F.struct(*ends, out.alias("out"))

    kept = F.aggregate(ordered, first, step, lambda s: s["out"])
    return F.when(F.greatest(*(F.contains(words, F.lit(g)).cast("int") for g in GATES)) == 1, kept).otherwise(empty)


def scan(text: Column) -> Column:
    """Struct: n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""

    def summed(found: Column) -> Column:
        base, more = found["base"], found["more"]
        base_labels = F.array_sort(F.transform(base, lambda b: b["label"]))
        labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform(more, lambda d: d["label"]))))
        best = F.array_max(F.transform(more, lambda d: d["relevance"]))
        return F.struct(
            (found["blanks"] - 1).cast("long").alias("n_words"),
            F.aggregate(base, F.lit(0).cast("long"), lambda n, b: n + b["n"]).alias("n_base"),
            F.array_min(F.transform(base, lambda b: b["first"])).alias("first_word"),
            F.array_max(F.transform(base, lambda b: b["last"])).alias("last_word"),
            F.array_join(base_labels, ",").alias("base_labels"),
            F.array_join(labels, ",").alias("labels"),
            F.greatest(
                F.coalesce(best, F.lit(0.0)), F.when(F.size(base) > 0, F.lit(BASE_RELEVANCE)).otherwise(F.lit(0.0))
            ).alias("score"),
            F.size(more).cast("long").alias("n_detections"),
        )

    def looked(words: Column) -> Column:
        return let(
            F.struct(_blanks(words).alias("blanks"), _base(words).alias("base"), _detections(words).alias("more")), summed
        )

    return let(worded(no_nulls(text)), looked)
