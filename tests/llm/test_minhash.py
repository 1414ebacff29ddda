import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import minhash
from scorelake.llm.words import mix, shingles, word_hashes
from tests.llm.edges import ROWS, edge_docs, no_docs

SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACES:
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def set_of(text):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """doc_id -> smallest doc_id reachable."""
    sets, parent = [(d, set_of(t)) for d, t in rows], {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {d: root(d) for d in parent}


def families(seed):
    """Large groups of copies, near copies that chain, and texts that share a passage."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, passage = [], [word() for _ in range(60)]
    for size, edits in ((120, 2), (60, 6), (40, 0), (30, 12)):
        base = [word() for _ in range(rng.randint(60, 140))]
        for _ in range(size):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
            if edits == 12:
                base = copy
    rows += [" ".join([word() for _ in range(40)] + passage + [word() for _ in range(rng.randint(0, 40))]) for _ in range(150)]
    rows += ["", None, "one two", "One  two", "one two three four five", " \n "]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [1024, 16])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = families(block)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in got)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {d: len(set_of(t)) for d, t in rows}


def test_edges(spark):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(edge_docs(spark)).collect()), key=str)
    assert len(got) == len(ROWS)
    by = {g[0]: g for g in got}
    assert by[1][1:] == (0, 1, True) and by[2][1:] == (0, 2, True) and by[3][1:] == (0, 3, True)
    assert by[4][1:] == (1, 4, True) and by[5][1:] == (1, 4, False) and by[7][1:] == (by[6][1], 6, False)
    assert [g for g in got if g[0] == 8] == [(8, 4, 8, True)] * 2 and by[None][2:] == (None, True)
    assert minhash.near_duplicates(no_docs(spark)).collect() == []
    kept = minhash.one_of_each(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, 8, 9, None, 10], key=str)


TEXTS = [" ".join(f"{x}{i}" for i in range(60)) for x in "abcd"]


def near(text, *places):
    return " ".join("other" if i in places else w for i, w in enumerate(text.split()))


def test_repeated_rows_are_one_head(spark, monkeypatch):
    a, other = TEXTS[0], near(TEXTS[0], 59)
    docs = spark.createDataFrame([(1, a)] * 50 + [(2, other)] * 50, "doc_id long, text string")
    seen, between = {}, minhash._between

    def counted(members, labels, known):
        seen.update(members=members.count(), known=known.count())
        return between(members, labels, known)

    monkeypatch.setattr(minhash, "_between", counted)
    got = minhash.near_duplicates(docs).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1)} and len(got) == 100
    assert seen["known"] == 2 and seen["members"] <= 2 * minhash.BANDS


def test_null_and_repeated_ids(spark):
    a, b, c, d = TEXTS
    table = [(1, a), (1, b), (2, b), (None, c), (None, c), (None, near(c, 59)), (None, d), (3, near(d, 0)), (4, near(d, 59)), (None, near(d, 0, 59)),
             (None, ""), (5, ""), (5, ""), (5, None), (6, "")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in minhash.one_of_each(docs).collect()), key=str)
    rest = [k for k in kept if k[1] not in (c, near(c, 59))]
    assert rest == sorted([(1, a), (1, b), (3, near(d, 0)), (None, ""), (5, ""), (5, None), (6, "")], key=str)
    assert len(kept) == len(rest) + 1
    ids = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert ids == {(1, 1), (2, 1), (None, None), (None, 3), (3, 3), (4, 3), (5, 5), (6, 6)}


def test_null_id_bridges(spark):
    words = TEXTS[0].split()
    far = [" ".join(["x"] * k + words[k:]) for k in (0, 6, 12)]  # neighbours are linked, the ends are not
    sets = [set_of(t) for t in far]
    assert 100 * len(sets[0] & sets[2]) < 75 * len(sets[0] | sets[2])
    docs = spark.createDataFrame([(7, far[0]), (None, far[1]), (8, far[2])], "doc_id long, text string")
    assert [r["doc_id"] for r in minhash.one_of_each(docs).collect()] == [7]


def test_columns_with_clashing_names_stay(spark):
    rows = [(1, TEXTS[0], "d", 7, True, "r"), (2, TEXTS[0], "e", 8, False, "s"), (3, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __digest string, __id int, __kept boolean, row string").withColumns({"id": F.lit(1), "mark": F.lit("m"), "digest": F.lit("x")})
    got = minhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r)[:6] for r in got.collect()) == [rows[0], rows[2]]


def one_by_one(elements, slots):
    """SuperMinHash as published: element by element, with the early stop on the histogram of ranks."""
    none = 2**64 - 1
    ranks = [none] * slots
    for e in elements:
        order = list(range(slots))
        for step in range(slots):
            if all(r >> 56 < step for r in ranks):
                break
            one = np.array([e], np.uint64)
            pick = step + ((int(mix(one + minhash._SWAP[step])[0]) >> 32) * (slots - step) >> 32)
            order[step], order[pick] = order[pick], order[step]
            ranks[order[step]] = min(ranks[order[step]], step << 56 | int(mix(one ^ minhash._RANK[step])[0]) >> 8)
    return ranks


def test_signatures_follow_the_definition():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 2, 7, 60, 400, 3000)]
    got = minhash.superminhash(sets)
    for ranks, elements in zip(got, sets, strict=True):
        assert ranks.tolist() == one_by_one(elements.tolist(), minhash.SLOTS)


def test_signatures_estimate_similarity_with_less_variance():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(150):
        both, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (150, 25, 25))
        x, y = minhash.superminhash([np.unique(np.append(both, a)), np.unique(np.append(both, b))])
        errors.append((x == y).mean() - 0.75)
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < 0.9 * np.sqrt(0.75 * 0.25 / minhash.SLOTS)


def test_words_and_shingles():
    texts = [t for _, t, *_ in ROWS if t] + ["a", "x" * 100 + " y", "a b c d e f", "É é A a", "z" * 3_000_000 + " q " + "w " * 700_000]
    for text, hashes in zip(texts, word_hashes([t.encode().lower() for t in texts]), strict=True):
        words = words_of(text)
        assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words))
        assert len(shingles(hashes)) == len(set_of(text))
