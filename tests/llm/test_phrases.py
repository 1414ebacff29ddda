import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import phrases, queries
from tests.llm.edges import edge_docs, no_docs


def words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, width=10):
    wanted = {}
    for name, text in items:
        w = words(text)
        size = min(width, len(w))
        for i in range(len(w) - size + 1) if size else ():
            wanted.setdefault(tuple(w[i:i + size]), set()).add("" if name is None else str(name))
    sizes = {len(k) for k in wanted}
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, names = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                found = wanted.get(tuple(w[i:i + size]))
                if found:
                    hit.update(range(i, i + size))
                    names |= found
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def found(docs, items):
    return sorted((tuple(r) for r in queries.contaminated_documents(docs, items).collect()), key=str)


def made(spark, n, seed):
    """Documents over a few words, so that phrases overlap and repeat; items cut from some of them."""
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(["The", "of", "É", "x9", "and", "ζ", "w%d" % rng.randrange(30)]) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(k))
    docs = [(i, text(rng.randrange(0, 400))) for i in range(n)]
    cut = lambda t, a, k: " ".join(words(t)[a:a + k]).upper().replace("É", "É")
    items = [(i, cut(docs[(i * 7) % n][1], rng.randrange(0, 60), rng.choice([3, 9, 10, 11, 40]))) for i in range(40)]
    items += [(100, ""), (101, None), (102, "the"), (None, docs[3][1]), (5, docs[4][1]), (103, "absent word"), (5, "of")]
    docs += [(3, items[0][1]), (None, docs[5][1]), (1000, None), (1001, "the"), (1002, docs[5][1] * 30)]
    return docs, items


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(phrases, "SHARD_BYTES", size)  # also: long texts cut into slices
    monkeypatch.setattr(phrases, "BLOCK_WINDOWS", 50)
    docs, items = made(spark, 60, size)
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, row int, item string").repartition(3)
    b = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, length string")
    assert found(d, b) == brute(docs, items)


def test_awkward_documents(spark):
    docs = edge_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(1, "word number one and two, word number one and two, word number one"), (2, "12345"), (3, "phrase à part")]
    b = spark.createDataFrame(items, "item_id long, text string")
    assert found(docs, b) == brute(rows, items)
    assert found(no_docs(spark), b) == []
    assert found(docs, b.limit(0)) == brute(rows, [])


def test_proximity():
    """Against every ordered choice of places."""
    rng = random.Random(5)
    for trial in range(60):
        texts = [[rng.randrange(6) for _ in range(rng.randrange(0, 25))] for _ in range(3)]
        asked = [[rng.randrange(7) for _ in range(rng.randrange(1, 4))] for _ in range(6)]
        parts = [phrases.Text(i, i, 0, 0, np.array(t, np.uint64)) for i, t in enumerate(texts)]
        names, counts, places, firsts = phrases.Shard.postings(parts, 5)
        shard = phrases.Shard(names, counts, places, firsts, np.array([len(t) for t in texts]))
        table = np.zeros((len(asked), 4), np.int64)
        for k, a in enumerate(asked):
            table[k, :len(a)] = a
        block = phrases.Block([str(k) for k in range(len(asked))], np.array([len(a) for a in asked]), table)
        window, low, high = shard.near(block, 2)
        got = {(n, int(k)) for w, k in zip(window, np.searchsorted(firsts + shard.sizes, low, "right"), strict=True) for n in block.named([w])}
        exact, start = shard.phrases(block)
        got_exact = {(n, int(s)) for w, s in zip(exact, start, strict=True) for n in block.named([w])}

        def spans(text, want):
            ends = {(i, i) for i, t in enumerate(text) if t == want[0]}
            for t in want[1:]:
                ends = {(a, j) for a, i in ends for j in range(i + 1, len(text)) if text[j] == t}
            return {j - a + 1 for a, j in ends}

        assert got == {(str(k), i) for i, t in enumerate(texts) for k, a in enumerate(asked) if any(s <= len(a) + 2 for s in spans(t, a))}
        assert got_exact == {(str(k), int(firsts[i]) + p) for i, t in enumerate(texts) for k, a in enumerate(asked) for p in range(len(t)) if t[p:p + len(a)] == a}


def test_a_near_copy_is_found_within_the_slop(spark):
    docs = spark.createDataFrame([(1, "one two extra three four five"), (2, "one two three four five"), (3, "five four three two one")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three four five")], "item_id long, text string")
    names = lambda slop: {r["doc_id"]: r["items"] for r in phrases.contamination(docs, items, slop=slop).collect()}
    assert names(0) == {1: [], 2: ["7"], 3: []} and names(1) == {1: ["7"], 2: ["7"], 3: []}
    hits = phrases.contamination(docs, items, slop=1).where("doc_id = 1").select(phrases.covered(F.col("hits"))).first()[0]
    assert hits == 6
