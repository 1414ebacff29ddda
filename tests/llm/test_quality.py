import random
from collections import Counter

import numpy as np

from scorelake.llm import quality
from tests.llm.edges import ROWS, edge_docs, no_docs
from tests.llm.test_minhash import words_of

SPACES = " \t\n\x0b\x0c\r"


def plain(text):
    """The contract's figures, counted naively."""
    text, words = text or "", []
    for w in "".join(c if c not in SPACES else " " for c in text).split(" "):
        words += [w] if w else []
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {r for r, n in Counter(runs).items() if n > 1}
    covered = {i + k for i, r in enumerate(runs) if r in often for k in range(3)}
    lines = [x for x in text.split("\n") if any(c not in SPACES for c in x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_figures():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b ", "é ", "\n", " ", "#", "|x ", "A!", "\t", "日 "]) for _ in range(rng.randint(0, 120))) for _ in range(500)] + [r[1] or "" for r in ROWS]
    got = quality.measure([t.encode() for t in texts])
    assert [g[:5] for g in got] == [plain(t) for t in texts]
    assert all(g[0] == len(words_of(t)) for g, t in zip(got, texts, strict=True))


def test_fit_finds_reliable_rules():
    """Votes drawn with known accuracies: the posterior beats each single rule."""
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.7
    accuracy = np.linspace(0.7, 0.95, len(quality.RULES))
    votes = np.where(rng.random((len(truth), len(accuracy))) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = 2
    patterns = (votes * 3 ** np.arange(len(accuracy))).sum(axis=1)
    known = quality.fit(Counter(patterns.tolist()))
    good = np.array([known[p] for p in patterns.tolist()])
    assert ((good >= 0.5) == truth).mean() > 0.97
    assert quality.fit({}) == {} and abs(good.mean() - 0.7) < 0.02
    assert quality.votes(int(patterns[0])) == votes[0].tolist()


def test_rows(spark):
    got = quality.rated(edge_docs(spark)).collect()
    assert sorted((str(r["doc_id"]), *(r[c] for c in quality.FEATURES)) for r in got) == sorted((str(r[0]), *plain(r[1])) for r in ROWS)
    assert all(r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5) for r in got)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    assert quality.rated(no_docs(spark)).collect() == []
    assert quality.good(no_docs(spark)).collect() == []


def test_pipeline_keeps_what_is_rated_good(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"] for r in quality.rated(docs).where("kept").collect()}
    got = quality.good(docs)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == want


def test_clean_labels_are_kept(spark):
    folder = "/root/testdata/sf0.01"
    rated = quality.rated(spark.read.parquet(f"{folder}/documents.parquet"))
    both = rated.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in both if r["quality"] == 1]
    bad = [r["kept"] for r in both if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3
