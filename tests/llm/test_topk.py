import math

import numpy as np
import pytest

from scorelake.llm import topk


def brute(rows, k, every):
    fine = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fine if i % every == 0}):
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for j, x in fine if j == q for i, y in fine if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def search(spark, rows, k, every):
    vectors = topk.weighted(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string"))
    return sorted(tuple(r) for r in topk.top_k(vectors.where(f"id % {every} = 0"), vectors, k).select("query_id", "rank", "vec_id", "score").collect())


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.2, 12))]) for i in range(400)]
    rows += [(400 + i, rows[i % 7][1]) for i in range(60)]  # ties
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 12), (510, [float("inf")] * 12), (None, [1.0] * 12), (520, []), (530, [0.5, -0.25]), (10, rows[3][1]), (540, [0.0] * 12)]
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 20)
    assert search(spark, rows, 5, 10) == brute(rows, 5, 10)


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (50, [-1.0, 0.0])]
    assert search(spark, rows, 5, 50) == brute(rows, 5, 50)
    assert search(spark, [(1, [1.0])], 5, 50) == []
    assert search(spark, [(0, [1.0])], 5, 50) == []


def test_components_out_of_range_are_an_error(spark):
    with pytest.raises(Exception, match="out of range"):
        search(spark, [(0, [1e30, 1.0]), (1, [1.0, 1.0])], 5, 50)


def test_pruning_is_exact():
    rng = np.random.default_rng(2)
    for sparse in (0.0, 0.8):
        table = rng.integers(-40, 90, (600, 30)) * (rng.random((600, 30)) >= sparse)
        shard = topk.Shard(np.arange(600), table)
        for q in range(0, 600, 13):
            ids, scores = shard.top(q, table[q], 5)
            want = sorted((-int(table[q] @ table[i]), i) for i in range(600) if i != q)[:5]
            assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == want
