import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import mixing
from tests.llm.edges import ROWS, edge_docs, no_docs


@pytest.mark.parametrize("seed", range(8))
def test_every_block_is_in_its_window(seed):
    rng = random.Random(seed)
    shares = mixing.parts({f"s{i}": rng.random() ** 3 + 1e-3 for i in range(rng.randint(1, 25))})
    period, given = sum(shares.values()), Counter()
    assert period == mixing.PERIOD
    for source, block, slot in mixing.schedule(shares):
        n = shares[source]
        assert block == given[source] and block * period // n <= slot < -(-(block + 1) * period // n)
        given[source] += 1
        for s, n in shares.items():  # within one block of the target after each slot
            assert abs(n * (slot + 1) - given[s] * period) < period


def documents(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(i, "x" * rng.randint(0, 300), rng.choice("aaaaaaabbc"), "other") for i in range(2000)], "doc_id long, text string, source string, slot string")


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_ROWS", 150)
    weights, block = {"a": 0.5, "b": 0.3, "c": 0.2}, 1000
    docs = documents(spark)
    got = mixing.mixed(docs, weights, block).collect()
    shares, spans = mixing.parts(weights), defaultdict(set)
    period = sum(shares.values())
    slots = {(s, i): t for s, i, t in mixing.schedule(shares)}
    sizes = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    end = max(r["mix"]["slot"] for r in got) + 1
    seen = Counter((r["doc_id"], r["mix"]["epoch"]) for r in got)
    assert set(seen.values()) == {1} and len({d for d, _ in seen}) == 2000
    taken, number = Counter(), Counter()
    for slot in range(end):
        owner = next(s for s in shares if (s, number[s] % shares[s]) in slots and slots[s, number[s] % shares[s]] + number[s] // shares[s] * period == slot)
        number[owner] += 1
    for r in got:
        m = r["mix"]
        n = m["epoch"] * blocks[m["source"]] + m["block"]
        assert m["slot"] == slots[m["source"], n % shares[m["source"]]] + n // shares[m["source"]] * period and n < number[m["source"]]
        spans[m["source"], m["block"]].add(r["doc_id"])
        taken[m["source"]] += m["size"]
    assert all(number[s] >= blocks[s] for s in blocks) and any(number[s] == blocks[s] for s in blocks)
    text = {r["doc_id"]: len(r["text"]) for r in docs.collect()}
    for (s, b), ids in spans.items():  # a block holds what starts inside it
        assert sum(text[i] for i in ids) < block + 300
    total = sum(taken.values())
    for s, w in weights.items():
        assert abs(taken[s] - w * total) < 3 * block


def test_order_and_columns(spark):
    docs = documents(spark)
    made = mixing.mixed(docs, 0.5, 500)
    ordered = mixing.in_order(docs, made)
    assert ordered.columns == docs.columns and ordered.count() == made.count()
    at = {}
    for r in made.orderBy("mix.slot", "mix.place").collect():
        at.setdefault(r["doc_id"], r["mix"]["slot"])
    first = [r["doc_id"] for r in ordered.collect()]
    done, slots = set(), []
    for d in first:
        if d not in done:
            done.add(d)
            slots.append(at[d])
    assert slots == sorted(slots)


def test_edges(spark):
    got = mixing.mixed(edge_docs(spark), 1.0, 100).collect()
    assert Counter(r["doc_id"] for r in got if r["mix"]["epoch"] == 0) == Counter(r[0] for r in ROWS)
    assert {r["mix"]["source"] for r in got} == {"a", "b", "c", "(none)"}
    assert mixing.mixed(no_docs(spark)).collect() == []
    with pytest.raises(ValueError):
        mixing.mixed(edge_docs(spark), {"a": 1.0})
    with pytest.raises(ValueError):
        mixing.mixed(edge_docs(spark), name="score")


def deviations(shares_of, weights, periods):
    """The largest distance from the unrounded w * t after any slot, in blocks."""
    total, given, slots, worst = sum(weights.values()), Counter(), 0, 0.0
    for k in range(periods):
        for source, _, _ in mixing.schedule(shares_of(k)):
            before = given[source] - weights[source] / total * slots
            given[source] += 1
            slots += 1
            worst = max(worst, abs(before), abs(given[source] - weights[source] / total * slots))
        worst = max([worst, *(abs(given[s] - w / total * slots) for s, w in weights.items())])
    return worst


@pytest.mark.parametrize("n, periods", [(20, 120), (600, 40), (5000, 12)])
def test_deviation_does_not_grow(n, periods):
    rng = random.Random(n)
    weights = {f"s{i}": rng.random() ** 3 + 1e-3 for i in range(n)}
    weights["s0"] = sum(weights.values()) / 2  # a third
    names = sorted(weights)
    steps = mixing.stepped(mixing.whole_weights(np.array([weights[s] for s in names])), mixing.PERIOD)
    totals = [np.zeros(n, int), *(next(steps) for _ in range(periods))]
    exact = np.array([weights[s] for s in names]) / sum(weights.values())
    for k, had in enumerate(totals):
        assert had.sum() == k * mixing.PERIOD and abs(had - exact * k * mixing.PERIOD).max() < 1
    assert deviations(lambda k: dict(zip(names, (totals[k + 1] - totals[k]).tolist())), weights, periods) < 2


def test_many_periods_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PERIOD", 64)
    sources = [(f"s{i:03}", float(1 + i % 7), 1 + i % 5) for i in range(300)]
    table = spark.createDataFrame(sources, "source string, weight double, blocks long")
    got = sorted((r["slot"], r["source"], r["epoch"], r["block"]) for r in mixing.planned(table).collect())
    assert [g[0] for g in got] == list(range(len(got))) and len(got) > 10 * 64
    blocks, total, given = {s: n for s, _, n in sources}, sum(w for _, w, _ in sources), Counter()
    for slot, s, epoch, block in got:
        assert epoch * blocks[s] + block == given[s]
        given[s] += 1
        if slot % 64 == 63:
            assert all(abs(given[x] - w / total * (slot + 1)) < 1 for x, w, _ in sources)
    assert all(given[s] >= n for s, n in blocks.items()) and given[got[-1][1]] == blocks[got[-1][1]]


def test_more_sources_than_slots_in_a_period(spark):
    docs = spark.range(12_000).selectExpr("id AS doc_id", "'text' AS text", "concat('site', id % 6000) AS source").unionByName(
        spark.range(12_000, 12_500).selectExpr("id AS doc_id", "repeat('x', 100) AS text", "'large' AS source"))
    got = mixing.mixed(docs, 0.7, 8).select("doc_id", "mix.*").collect()
    assert {r["doc_id"] for r in got} == set(range(12_500))
    slots = {(r["source"], r["slot"]) for r in got}
    end = max(r["slot"] for r in got) + 1
    weight = 50_000 ** 0.7 / (50_000 ** 0.7 + 6000 * 8 ** 0.7)
    large = sum(r["size"] for r in got if r["source"] == "large") / 8
    assert end > mixing.PERIOD and abs(large - weight * end) < 2 + 2 * 100 / 8
    assert len([1 for s, _ in slots if s != "large"]) == len({t for s, t in slots if s != "large"}) >= 6000
