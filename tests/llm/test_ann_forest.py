from __future__ import annotations

import numpy as np

from textloom.llm.ann_forest import nearest_neighbours


def test_recall_scores_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[100:160] = x[50]
    rows = [(int(i), [float(v) for v in r], "b", "c") for i, r in enumerate(x)]
    rows += [(5000, None, "b", "c"), (5050, [0.0] * 16, "b", "c"), (5100, [float("nan")] * 16, "b", "c"), (5150, [None] * 16, "b", "c"), (None, rows[0][1], "b", "c"), (5200, [1.0], "b", "c"), (50, rows[50][1], "b", "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string, chunk string")
    got: dict = {}
    for r in nearest_neighbours(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 3000, 50))
    full = x.astype(float)
    unit = full / np.linalg.norm(full, axis=1, keepdims=True)
    found = total = 0
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == [1, 2, 3, 4, 5]
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        best = np.lexsort((np.arange(len(s)), -s))[:5].tolist()
        found += len(set(best) & {h[1] for h in hits})
        total += 5
        for _, v, score in hits:
            assert abs(score - float(full[v] @ full[q] / np.linalg.norm(full[v]) / np.linalg.norm(full[q]))) < 1e-12
        assert [(-round(h[2], 12), h[1]) for h in hits] == sorted((-round(h[2], 12), h[1]) for h in hits)
    assert found / total >= 0.9
    assert [h[1] for h in got[50]] == [100, 101, 102, 103, 104]


def test_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    got = nearest_neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], kind)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1)]
    assert nearest_neighbours(spark.createDataFrame([], kind)).count() == 0
