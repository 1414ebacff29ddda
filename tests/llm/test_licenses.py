import random
import re
from re import _parser

from scorelake.llm import licenses
from scorelake.llm.queries import QUERIES
from tests.llm.edges import ROWS, edge_docs, no_docs

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))


def places(text):
    w = words(text)
    return sorted((i, label) for phrase, label in BASE.items() for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split())


def test_rules():
    rules = licenses.rules()
    assert len(rules) > 300 and [r.priority for r in rules] == sorted(r.priority for r in rules)
    for rule in rules:  # no text matches a rule without its keyword: cut the keyword out of a match
        assert rule.keyword and re.compile(rule.pattern)


def test_base_against_brute_force():
    rng = random.Random(3)
    parts = ["Under the MIT License", "apache-license, VERSION 2", "CC BY-NC", "under", "the", "mit", "cc", "by", "nc", "é", "日本", "x1", "license"]
    for _ in range(400):
        text = "".join(rng.choice(parts) + rng.choice([" ", ", ", "\n", ".", "-", "a"]) for _ in range(rng.randint(0, 30)))
        n, base, _ = licenses.scan(text.encode())
        assert (n, base) == (len(words(text)), places(text)), text


def found(text):
    return [(f.label, f.start, f.end) for f in licenses.scan(text.encode())[2]]


def test_detections():
    assert found("SPDX-License-Identifier: GPL-2.0-or-later")[0][0] == "gpl-2"
    assert [f[0] for f in found("licensed under the GNU Lesser General Public License, version 2.1")] == ["lgpl-2.1"]
    assert [f[0] for f in found("This is released under the BSD 3-Clause License. All rights reserved.")] == ["bsd-3-clause", "all-rights-reserved"]
    assert [f[0] for f in found("Creative Commons Attribution-NonCommercial-ShareAlike")] == ["cc-by-nc-sa"]
    assert [f[0] for f in found("Permission is hereby granted, free of charge, to any person obtaining a copy of this software")] == ["mit"]
    assert found("plain words about a permit and a license") == []


def test_suppression_against_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        some = [(licenses.Found(s := rng.randrange(30), s + rng.randint(1, 8), rng.choice("abc"), rng.randint(1, 3), 0.5), rng.randrange(50)) for _ in range(rng.randint(0, 25))]
        kept = []
        for one, _ in sorted(some, key=lambda f: (f[0].priority, f[0].start - f[0].end, f[0].start, f[1])):
            if not any(k.start <= one.start and one.end <= k.end for k in kept):
                kept.append(one)
        assert licenses.resolve(some) == sorted(kept)


def test_long_text_is_scanned_whole():
    text = "filler words " * 50_000 + "under the MIT License " * 3 + "tail " * 50_000 + "licensed under Apache License 2.0"
    n, base, all_ = licenses.scan(text.encode())
    assert [b[0] for b in base] == [100_000, 100_004, 100_008] and all_[-1].label == "apache-2" and all_[-1].end == n


def test_rows(spark, tmp_path):
    edge_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op6_signature_rules"](spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_base"]) for r in got) == sorted((str(r[0]), len(words(r[1])), 0) for r in ROWS)
    assert all(r["score"] == 0 and r["labels"] == "" and r["first_word"] is None for r in got)
    assert licenses.license_spans(no_docs(spark)).collect() == []


def test_no_pattern_outgrows_the_reach():
    _, by, _ = licenses._machine()
    widest = max(_parser.parse(pattern.pattern).getwidth()[1] for found in by.values() for _, _, pattern in found)
    assert widest <= licenses.REACH
