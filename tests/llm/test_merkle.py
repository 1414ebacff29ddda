import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from scorelake.llm import merkle, queries
from tests.llm.edges import edge_docs, no_docs


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def grow(nodes):
    """All levels, from the nodes to the single root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, place):
    out = []
    for nodes in levels[:-1]:
        low = place - place % 8
        out.append(("".join(nodes[low:place]), "".join(nodes[place + 1:low + 8])))
        place //= 8
    return out


def brute(rows):
    """Result rows of (doc_id, source, lang, n_chars, text)."""
    least = lambda v: (v is not None, v if v is not None else 0)
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((least(r[0]), leaf(*r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {s: grow([x[1] for x in sorted(trees[s], key=lambda x: x[:2])]) for s in names}
    top = grow([grown[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for place, (_, node, r) in enumerate(sorted(trees[s], key=lambda x: x[:2])):
            proof = path(grown[s], place) + path(top, i)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = None if r[4] is None else r[4].translate({c: c + 32 for c in range(65, 91)}) if tampered else r[4]
            fold = leaf(*r[:4], text)
            for before, after in proof:
                fold = h(before, fold, after)
            out.append((r[0], node, grown[s][-1][0], top[-1][0], h(*(b + a for b, a in proof)), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def found(docs, levels):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in queries.checked_manifest(docs, levels).select(*names).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 3])
def test_against_brute_force(spark, levels):
    sizes = {"aa": 700, "B": 1, None: 8, "é": 9, "cc": 65, "d": 64, "e": 2, "f": 1, "g": 1, "h": 3, "": 1}
    rows, n = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append(((n * 7919) % 1009, None if n % 5 == 0 else f"s{n % 3}", lang, n, None if n % 11 == 0 else f"Text {n % 90} É"))
    rows += rows[:30] + [(None, None, "aa", None, "Null id")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert found(docs, levels) == brute(rows)


def test_awkward_documents(spark):
    docs = edge_docs(spark).withColumn("leaf", F.lit(1)).withColumn("block", F.lit("x")).withColumn("root", F.lit(None).cast("string"))
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]
    assert found(docs, 1) == brute(rows)
    assert found(no_docs(spark), 3) == []
    assert found(docs.limit(1), 3) == brute(rows[:1])


def test_a_lone_block_speaks_to_many(spark, monkeypatch):
    monkeypatch.setattr(merkle, "STRETCH", 5)
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(64 * 8 + 1)] + [(i, "s", "fr", 1, "t") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(docs, 0) == brute(rows)
