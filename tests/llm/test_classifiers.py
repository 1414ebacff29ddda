import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import langid, neighbours
from scorelake.llm.sampling import bounded_sample, held_out
from tests.llm.edges import ROWS, edge_docs, no_docs

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_folds(docs):
    for r in docs.limit(50).select("doc_id", held_out().alias("h")).collect():
        assert r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_sample_is_bounded_and_the_least(spark):
    rows = [(i, "hot" if i % 3 else f"l{i % 9}") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, label string")
    got = bounded_sample(table, "label", 40).collect()
    place = {r["doc_id"]: r["p"] for r in table.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 11).alias("p")).collect()}
    for label in {x for _, x in rows}:
        want = sorted((i for i, x in rows if x == label), key=place.get)[:40]
        assert sorted(r["doc_id"] for r in got if r["label"] == label) == sorted(want)


def test_sample_takes_the_frequent_labels_and_null_ids(spark):
    rows = [(None, f"text {i}", f"l{i % 7}" if i % 2 else "hot") for i in range(900)] + [(None, "text", "rare")]
    table = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = bounded_sample(table, "label", 500, most_labels=3, most_rows=60).collect()
    assert {r["label"] for r in got} == {"hot", "l1", "l3"} and len(got) == 60
    assert len({r["text"] for r in got}) == 60


def test_languages_are_learned_without_ids(spark):
    texts = [("the cat and the dog are in the house with you", "en"), ("der Hund und die Katze sind nicht im Haus", "de")]
    docs = spark.createDataFrame([(None, f"{t} {i}", x) for i in range(2000) for t, x in texts], "doc_id long, text string, lang string")
    model = langid.train(docs, 100)
    assert model.languages == ["de", "en"] and [model.predict(t)[0] for t, _ in texts] == ["en", "de"]


def grams(text):
    """Runs of one to three characters, by plain loops."""
    kept = []
    for c in text.lower():
        c = c if c.isalpha() or ord(c) >= 0x3000 else " "
        if c != " " or not kept or kept[-1] != " ":
            kept.append(c)
    return Counter("".join(kept[i:i + n]) for n in (1, 2, 3) for i in range(len(kept) - n + 1))


def slot(gram):
    mask, keys = 2**64 - 1, [int(k) for k in langid._KEYS]
    x = sum(ord(c) * keys[k] for k, c in enumerate(gram)) + len(gram) & mask
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ x >> shift) * factor & mask
    return x >> 49


def test_ngrams_equal_plain_loops():
    for _, text, *_ in ROWS:
        want = Counter()
        for gram, n in grams(text or "").items():
            want[slot(gram)] += n
        slots, counts = langid.features(text)
        assert dict(zip(slots.tolist(), counts.tolist(), strict=True)) == want


def test_follow_the_leader_equals_its_formulas(monkeypatch):
    """FTRL-proximal one coordinate at a time, and the softmax in plain floats."""
    monkeypatch.setattr(langid, "SLOTS", 12)
    rng = np.random.default_rng(2)
    samples = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4).astype(np.float32), int(rng.integers(0, 3))) for _ in range(30)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 0.1
    z, n = [[0.0] * 3 for _ in range(12)], [[0.0] * 3 for _ in range(12)]

    def weight(i, k):
        if abs(z[i][k]) <= l1:
            return 0.0
        return -(z[i][k] - math.copysign(l1, z[i][k])) / ((beta + math.sqrt(n[i][k])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(3):
        for j in order.permutation(len(samples)):
            slots, x, label = samples[j]
            w = {(i, k): weight(i, k) for i in slots for k in range(3)}
            logits = [sum(float(v) * w[i, k] for i, v in zip(slots, x, strict=True)) for k in range(3)]
            total = sum(map(math.exp, logits))
            for i, v in zip(slots, x, strict=True):
                for k in range(3):
                    g = float(v) * (math.exp(logits[k]) / total - (k == label))
                    sigma = (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / alpha
                    z[i][k] += g - sigma * w[i, k]
                    n[i][k] += g * g
    got = langid.follow_the_leader(samples, 3, l1=l1)
    assert np.allclose(got, [[weight(i, k) for k in range(3)] for i in range(12)], atol=1e-6)
    assert (got == 0).any()


def test_a_repeated_labelled_id_gives_one_vector(spark):
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(3000)] + [(2, "another text")], "doc_id long, text string")
    model = neighbours.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert len(model.vectors) == 2


def test_language_on_held_out_rows(docs):
    model = langid.train(docs)
    got = langid.identified(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out()).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.98
    assert (np.abs(model.weights) == 0).mean() > 0.5  # the L1 penalty leaves most weights at zero
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, docs):
    model = langid.train(edge_docs(spark))
    got = langid.identified(edge_docs(spark), model).collect()
    assert len(got) == len(ROWS) and model.languages
    for r in got:
        if r["doc_id"] in (1, 2, 3, 10):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        else:
            assert r["lang_pred"] in model.languages
    none = langid.train(no_docs(spark))
    assert langid.identified(no_docs(spark), none).collect() == []
    assert {r["lang_pred"] for r in langid.identified(edge_docs(spark), none).collect()} == {"und"}
    kept = langid.confident(edge_docs(spark), model)
    assert kept.columns == edge_docs(spark).columns and not {1, 2, 3, 10} & {r["doc_id"] for r in kept.collect()}


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(1)
    truth = rng.integers(0, 3, 4000)
    logits = 6 * (np.eye(3)[truth] + rng.normal(0, 0.9, (4000, 3)))
    heat = langid.temperature(logits, truth)
    loss = lambda t: -np.log(langid.softmax(logits / t)[np.arange(4000), truth]).mean()
    assert heat > 1.5 and loss(heat) <= min(loss(heat * 1.1), loss(heat / 1.1), loss(1.0))


def test_grams_of_long_text_are_those_of_the_whole(monkeypatch):
    text = ("Ceci, n'est pas 123 un texte long. " * 40)
    whole = langid.features(text)
    monkeypatch.setattr(langid, "_STEP", 50)
    cut = langid.features(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_quality_on_held_out_rows(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = neighbours.train(docs, labels)
    got = neighbours.scored(docs, model).join(labels, "doc_id").where(held_out()).collect()
    score, good = np.array([r["score"] for r in got]), np.array([r["quality"] == 1 for r in got])
    assert (score[good] >= 0.7).mean() > 0.95 and (score[~good] >= 0.7).mean() < 0.2


def test_votes_against_brute_force(spark, docs):
    model = neighbours.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    texts = [r["text"] for r in docs.limit(40).collect()]
    for text, score in zip(texts, model.scores(texts), strict=True):
        v = model.latent([text])[0]
        near = sorted(((float(v @ x), float(y)) for x, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[:neighbours.NEIGHBOURS]
        weights = [max(s, 0) ** neighbours.SHARP for s, _ in near]
        assert abs(score - (sum(w * y for w, (_, y) in zip(weights, near, strict=True)) + 1e-3 * model.prior) / (sum(weights) + 1e-3)) < 1e-3


def test_quality_edges(spark):
    labels = spark.createDataFrame([(4, 1), (6, 0), (6, 1), (8, 1), (9, None), (None, 1)], "doc_id long, quality int")
    got = neighbours.scored(edge_docs(spark), neighbours.train(edge_docs(spark), labels)).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    none = neighbours.train(edge_docs(spark), labels.limit(0))
    assert {r["score"] for r in neighbours.scored(edge_docs(spark), none).collect()} == {0.5}
    assert neighbours.scored(no_docs(spark), none).collect() == []
