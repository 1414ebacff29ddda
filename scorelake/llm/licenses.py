"""License scans with ordered signature rules.

A text is reduced to its words (ASCII letters and digits, lower-cased, and everything beyond ASCII)
joined by single spaces. A keyword prefilter, one Aho-Corasick pass over the reduced text, decides which
rules run at all; each rule is a regex over whole words. Detections of all rules are then resolved:
by rising priority number, longer before shorter, earlier before later; a detection that lies inside
the interval of a better one is suppressed. The base phrases of ``BASE`` are counted at every place,
whatever is suppressed, and their labels always stay.

Null and empty texts have no words, no detection and score 0. Rows are independent of each other, so
ties, repeated rows and null ids change nothing; other columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import frugal, pieces, rows

#: The phrases and labels that every scan must report.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Rule(NamedTuple):
    label: str
    priority: int  # smaller is stronger
    confidence: float
    keyword: str  # must occur for the rule to run
    pattern: str


# Licences by their names in running text. Each row: label, identifier, names in words; a name may
# use regex. The identifier is how a machine-readable tag spells it once reduced to words.
LICENSES = [
    ("mit", "mit", "mit license|expat license|mit x11 license"),
    ("mit-0", "mit 0", "mit no attribution|mit 0 license"),
    ("apache-2", "apache 2 0", "apache license(?: version)? 2(?: 0)?|apache software license(?: version)? 2(?: 0)?|asl 2 0"),
    ("apache-1.1", "apache 1 1", "apache software license(?: version)? 1 1|apache license(?: version)? 1 1"),
    ("gpl-3", "gpl 3 0(?: only| or later)?", "gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)3|gnu gpl ?(?:version |v) ?3|gplv3"),
    ("gpl-2", "gpl 2 0(?: only| or later)?", "gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)2|gnu gpl ?(?:version |v) ?2|gplv2"),
    ("gpl-1", "gpl 1 0(?: only| or later)?", "gnu general public license(?: either)? (?:version |v)1|gplv1"),
    ("gpl", "gpl", "gnu general public license|gnu gpl"),
    ("lgpl-3", "lgpl 3 0(?: only| or later)?", "gnu lesser general public license(?: either)? (?:version |v)3|lgplv3"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", "gnu lesser general public license(?: either)? (?:version |v)2 1|lgplv2 1|lgpl version 2 1"),
    ("lgpl-2", "lgpl 2 0(?: only| or later)?", "gnu library general public license(?: version 2)?|lgplv2"),
    ("lgpl", "lgpl", "gnu lesser general public license|gnu lgpl"),
    ("agpl-3", "agpl 3 0(?: only| or later)?", "gnu affero general public license(?: (?:version |v)3)?|agplv3"),
    ("bsd-2-clause", "bsd 2 clause", "bsd 2 clause(?: simplified)? license|simplified bsd license|freebsd license|two clause bsd license"),
    ("bsd-3-clause", "bsd 3 clause", "bsd 3 clause(?: new)? license|new bsd license|modified bsd license|revised bsd license|three clause bsd license"),
    ("bsd-4-clause", "bsd 4 clause", "bsd 4 clause license|original bsd license|four clause bsd license"),
    ("0bsd", "0bsd", "zero clause bsd license|bsd zero clause license"),
    ("bsd", "bsd", "bsd style license|bsd license"),
    ("isc", "isc", "isc license|internet systems consortium license"),
    ("mpl-2.0", "mpl 2 0", "mozilla public license(?: version| v)? ?2(?: 0)?|mplv2"),
    ("mpl-1.1", "mpl 1 1", "mozilla public license(?: version| v)? ?1 1"),
    ("mpl", "mpl", "mozilla public license"),
    ("epl-2.0", "epl 2 0", "eclipse public license(?: version| v)? ?2(?: 0)?"),
    ("epl-1.0", "epl 1 0", "eclipse public license(?: version| v)? ?1(?: 0)?"),
    ("eupl-1.2", "eupl 1 2", "european union public licen[cs]e(?: version| v)? ?1 2"),
    ("cddl-1.0", "cddl 1 0", "common development and distribution license(?: version 1 0)?"),
    ("cpl-1.0", "cpl 1 0", "common public license(?: version 1 0)?"),
    ("artistic-2.0", "artistic 2 0", "artistic license(?: version)? 2(?: 0)?"),
    ("artistic-1.0", "artistic 1 0", "artistic license(?: version 1 0)?|perl artistic license"),
    ("bsl-1.0", "bsl 1 0", "boost software license(?: version 1(?: 0)?)?"),
    ("busl-1.1", "busl 1 1", "business source license(?: version 1 1)?"),
    ("zlib", "zlib", "zlib license|zlib libpng license"),
    ("libpng", "libpng(?: 2 0)?", "libpng license|png reference library license"),
    ("unlicense", "unlicense", "the unlicense|unlicense org"),
    ("wtfpl", "wtfpl", "do what the fuck you want to public license|wtfpl"),
    ("cc0-1.0", "cc0 1 0", "cc0 1 0 universal|creative commons zero|creative commons cc0|cc0 public domain dedication"),
    ("cc-by-nc-nd", "cc by nc nd(?: [1234] 0)?", "cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?"),
    ("cc-by-nc-sa", "cc by nc sa(?: [1234] 0)?", "cc by nc sa|creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "cc by nc(?: [1234] 0)?", "creative commons attribution non ?commercial"),
    ("cc-by-nd", "cc by nd(?: [1234] 0)?", "cc by nd|creative commons attribution no ?deriv(?:ative)?s?"),
    ("cc-by-sa", "cc by sa(?: [1234] 0)?", "cc by sa|creative commons attribution share ?alike"),
    ("cc-by", "cc by(?: [1234] 0)?", "cc by [1234] 0|creative commons attribution(?: license)?"),
    ("gfdl-1.3", "gfdl 1 3(?: only| or later)?", "gnu free documentation license version 1 3"),
    ("gfdl", "gfdl(?: 1 [12])?", "gnu free documentation license"),
    ("ofl-1.1", "ofl 1 1", "sil open font license(?: version 1 1)?|open font license"),
    ("psf-2.0", "psf 2 0|python 2 0", "python software foundation license(?: version 2)?|psf license"),
    ("php-3.01", "php 3 01", "php license(?: version)? 3 01|the php license"),
    ("ruby", "ruby", "ruby license|same terms as ruby"),
    ("openssl", "openssl", "openssl license|openssl toolkit"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"),
    ("ncsa", "ncsa", "university of illinois ncsa open source license|ncsa open source license"),
    ("ms-pl", "ms pl", "microsoft public license"),
    ("ms-rl", "ms rl", "microsoft reciprocal license"),
    ("odbl-1.0", "odbl 1 0", "open database license|odc open database license"),
    ("odc-by-1.0", "odc by 1 0", "open data commons attribution license"),
    ("pddl-1.0", "pddl 1 0", "public domain dedication and license"),
    ("afl-3.0", "afl 3 0", "academic free license(?: version)? ?(?:3 0)?"),
    ("osl-3.0", "osl 3 0", "open software license(?: version)? ?(?:3 0)?"),
    ("upl-1.0", "upl 1 0", "universal permissive license(?: version 1 0)?"),
    ("sspl-1.0", "sspl 1 0", "server side public license(?: version 1)?"),
    ("ecl-2.0", "ecl 2 0", "educational community license(?: version 2 0)?"),
    ("x11", "x11", "x11 license|x consortium license"),
    ("blueoak-1.0", "blueoak 1 0 0", "blue oak model license"),
    ("mulan-psl-2", "mulanpsl 2 0", "mulan psl v2|mulan permissive software license"),
    ("vim", "vim", "vim license"),
    ("tcl", "tcl", "tcl tk license"),
    ("w3c", "w3c", "w3c software(?: notice and)? license|w3c document license"),
    ("unicode", "unicode dfs(?: 2016)?|unicode 3 0", "unicode license agreement|unicode terms of use"),
    ("public-domain", "public domain", "released into the public domain|dedicated to the public domain|placed in the public domain"),
]

# How a name is used. A grant is stronger evidence than a mention, a tag stronger than both.
FORMS = [
    (1, 0.99, "spdx license identifier {id}", "tag"),
    (2, 0.95, "(?:licensed|released|distributed|available|provided|published|made available|covered|governed|licence granted) (?:to you )?(?:under|by|with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{names})(?: license| licence)?", "name"),
    (2, 0.9, "(?:license|licence|licensing)(?: is| type| name)? (?:the )?(?:{id}|{names})", "either"),
    (3, 0.7, "under (?:the )?(?:terms of )?(?:the )?(?:{names})(?: license| licence)?", "name"),
    (4, 0.5, "(?:{names})", "name"),
]

# Licences recognised by sentences of their own text.
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name of .{1,80}? may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2", "you may not use this (?:file|work) except in compliance with the license"),
    ("apache-2", "www apache org licenses license 2 0"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3", "you should have received a copy of the gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1.0", "distributed under the boost software license"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies .{1,60}? do what the fuck"),
    ("cc-by", "creativecommons org licenses by [1234] 0"),
    ("cc-by-sa", "creativecommons org licenses by sa [1234] 0"),
    ("cc-by-nc", "creativecommons org licenses by nc [1234] 0"),
    ("cc-by-nd", "creativecommons org licenses by nd [1234] 0"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa [1234] 0"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd [1234] 0"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0"),
    ("gpl", "www gnu org licenses gpl"),
    ("lgpl", "www gnu org licenses lgpl"),
    ("agpl-3", "www gnu org licenses agpl"),
    ("ofl-1.1", "scripts sil org ofl"),
    ("proprietary", "proprietary and confidential"),
    ("proprietary", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)"),
    ("all-rights-reserved", "all rights reserved"),
    ("non-commercial", "non commercial (?:use|purposes) only"),
    ("non-commercial", "noncommercial (?:use|purposes) only"),
]


def _plain(expression: str) -> str:
    """The expression without its groups, classes and optional letters."""
    while (less := re.sub(r"\(\?:[^()]*\)\??", " ", expression)) != expression:
        expression = less
    return re.sub(r"[a-z0-9]\?|\[[^\]]*\]\S*", " ", expression)


def _keyword(expression: str) -> str:
    """The longest plain word, or start of a word, that every match must contain."""
    return max(re.findall(r"[a-z0-9]+", _plain(expression)), key=len)


def _alternatives(expression: str) -> list[str]:
    """The parts between the bars outside all groups."""
    parts, depth = [""], 0
    for c in expression:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def rules() -> list[Rule]:
    """Every rule in order: priority, then the order above. One rule for each name and form, so that
    each has one keyword."""
    out = []
    for label, tag, names in LICENSES:
        for priority, confidence, form, kind in FORMS:
            if kind != "name":
                out.append(Rule(label, priority, confidence, "spdx" if kind == "tag" else "licen", form.format(id=f"(?:{tag})", names="(?!)")))
            if kind != "tag":
                out += [Rule(label, priority, confidence, _keyword(name), form.format(id="(?!)", names=name)) for name in _alternatives(names)]
    out += [Rule(label, 2, 0.9, _keyword(sentence), sentence) for label, sentence in SENTENCES]
    out += [Rule(label, 3, 0.8, max(phrase.split(), key=len), phrase) for phrase, label in BASE.items()]
    return sorted(out, key=lambda r: r.priority)


_WORDS = bytes((c + 32 if 65 <= c < 91 else c) if 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def _bounded(expression: str) -> re.Pattern:
    return re.compile(rb"(?<![^ ])(?:" + expression.encode() + rb")(?![^ ])")


@cache
def _machine():
    """Keyword automaton, rules by keyword, base phrases."""
    by: dict[str, list[tuple[int, Rule, re.Pattern]]] = {}
    for order, rule in enumerate(rules()):
        by.setdefault(rule.keyword, []).append((order, rule, _bounded(rule.pattern)))
    automaton = ahocorasick.Automaton()
    for word in {*by, *(p.split()[-1] for p in BASE)}:
        automaton.add_word(f" {word}", word)  # at the start of a word
    automaton.make_automaton()
    return automaton, by, [(phrase, _bounded(phrase), label) for phrase, label in BASE.items()]


class Found(NamedTuple):
    start: int  # word positions, from 0
    end: int  # exclusive
    label: str
    priority: int
    confidence: float


def reduced(text: bytes) -> tuple[bytes, int]:
    words = text.translate(_WORDS).split()
    return b" ".join(words), len(words)


def resolve(found: list[tuple[Found, int]]) -> list[Found]:
    """Suppress what lies inside a better detection; equal intervals keep the better one. ``reach``
    is a Fenwick tree: the largest end of the kept detections that start at or before a place."""
    starts = sorted({f.start for f, _ in found})
    place = {s: i + 1 for i, s in enumerate(starts)}
    reach = [0] * (len(starts) + 1)
    kept: list[Found] = []
    for one, _ in sorted(found, key=lambda f: (f[0].priority, f[0].start - f[0].end, f[0].start, f[1])):
        i, end = place[one.start], 0
        while i:
            end, i = max(end, reach[i]), i & (i - 1)
        if end >= one.end:
            continue
        kept.append(one)
        i = place[one.start]
        while i < len(reach):
            reach[i] = max(reach[i], one.end)
            i += i & -i
    return sorted(kept)


REACH = 512  # bytes; no pattern matches more than this around its keyword


def _windows(line: bytes, places: list[int]) -> list[tuple[int, int]]:
    """Stretches of the line within reach of a keyword, cut at spaces."""
    out: list[tuple[int, int]] = []
    for place in places:
        lo, hi = line.rfind(b" ", 0, max(0, place - REACH)) + 1, line.find(b" ", place + REACH)
        hi = len(line) if hi < 0 else hi
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def scan(text: bytes) -> tuple[int, list[tuple[int, str]], list[Found]]:
    """Number of words, base places (word, label) and resolved detections of one text."""
    automaton, by, base = _machine()
    line, n = reduced(text)
    present: dict[str, list[int]] = {}
    for end, word in automaton.iter(" " + line.decode("latin-1")):
        present.setdefault(word, []).append(end)
    if not present:
        return n, [], []
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    at = lambda i: int(np.searchsorted(spaces, i))
    places = [(at(m.start()), label) for phrase, pattern, label in base if phrase.split()[-1] in present for m in pattern.finditer(line)]
    found: dict[Found, int] = {}
    for word in sorted(present):
        near = _windows(line, present[word])
        for order, rule, pattern in by.get(word, ()):
            for m in (m for lo, hi in near for m in pattern.finditer(line, lo, hi)):
                start = at(m.start())
                one = Found(start, start + m[0].count(b" ") + 1, rule.label, rule.priority, rule.confidence)
                found[one] = min(order, found.get(one, order))
    return n, sorted(places), resolve(list(found.items()))


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                     ("found", pa.list_(_SPAN))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            out = [scan(b"" if t is None else t.encode()) for t in batch.column(1).to_pylist()]
            yield rows(_SCHEMA, batch.column(0), [o[0] for o in out], [[{"word": w, "label": x} for w, x in o[1]] for o in out],
                       [[{"start": f.start, "end": f.end, "label": f.label, "confidence": f.confidence} for f in o[2]] for o in out])


def license_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places and the resolved detections (word spans) of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(frugal(_scan), "doc_id long, n_words long, base array<struct<word: long, label: string>>, "
                                   "found array<struct<start: long, end: long, label: string, confidence: double>>")
