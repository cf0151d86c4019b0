from __future__ import annotations

import numpy as np
import pytest

from plumbline.llm import ann_forest


def frame(spark, vectors, ids=None):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 7, 0.5)
            for i, v in zip(ids if ids is not None else range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double")


def brute(vectors, ids, asked, k):
    x = np.asarray(vectors, dtype=np.float32).astype(np.float64)
    out = {}
    for q in asked:
        s = (x * x[ids.index(q)]).sum(axis=1)
        out[q] = sorted(((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q))[:k]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_whole_share_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((120, 8)) * rng.uniform(0.2, 3, (120, 1))
    x[50:60] = x[50]  # ties
    df = frame(spark, x)
    found = result(ann_forest.nearest(df, df.where("vec_id % 20 = 0"), k=12, share=1.0, shard=40, query_block=3))
    want = brute(x, list(range(120)), range(0, 120, 20), 12)
    assert {q: [i for _, i in v] for q, v in found.items()} == {q: [i for _, i in v] for q, v in want.items()}
    for q in want:
        assert [s for s, _ in found[q]] == pytest.approx([s for s, _ in want[q]], abs=1e-12)


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = [r.vec_id for r in rows], [r.embedding for r in rows]
    asked = [i for i in ids if i % 20 == 0]
    found = result(ann_forest.nearest(df, df.where("vec_id % 20 = 0")))
    want = brute(x, ids, asked, 20)
    assert set(found) == set(asked) and all(len(v) == 20 for v in found.values())
    assert np.mean([len({i for _, i in found[q]} & {i for _, i in want[q]}) / 20 for q in asked]) >= 0.9


def test_deep_prefixes_come_first():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((20, 16)) * 0.05 + 1, rng.standard_normal((400, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = ann_forest.Forest(x, 16, 16, 3)
    places = next(forest.ascend(x[:1], 20))
    assert len(set(range(20)) & set(places.tolist())) >= 15 and len(places) < 200


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    x = [[1, 0], None, [0, 0], [nan, 1], [inf, 1], [None, 1], [2, 1], [1, 2, 3], [], [2, 1], [-1, 0]]
    df = frame(spark, x, [0, 1, 2, 3, 4, 5, 6, 7, 8, 6, None])
    found = result(ann_forest.nearest(df, df))
    assert found == {0: [(-2.0, 6)], 6: [(-2.0, 0)]}  # a vector alone in its length has no partner; ids repeat once
    assert ann_forest.nearest(df.where("false"), df.where("false")).count() == 0
    assert ann_forest.nearest(df, df.where("false")).count() == 0


def doubles(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


def test_repeats_of_an_id_push_nothing_out(spark):
    rng = np.random.default_rng(4)
    rows = [(0, [1, 0, 0])] + [(1, [9 + i, 1, 0]) for i in range(40)] + [(i + 2, rng.standard_normal(3)) for i in range(38)]
    df = doubles(spark, rows)
    found = result(ann_forest.nearest(df, df.where("vec_id = 0")))
    best = {}
    for i, v in rows[1:]:
        best[i] = max(best.get(i, -1e9), float(np.asarray(v, dtype=float)[0]))
    want = sorted((-s, i) for i, s in best.items())[:20]
    assert [i for _, i in found[0]] == [i for _, i in want] and [s for s, _ in found[0]] == pytest.approx([s for s, _ in want])


@pytest.mark.parametrize("size", [1e-170, 1e-320, 1e160, 1e300])
def test_very_small_and_large_numbers(spark, size):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 4)) * size
    found = result(ann_forest.nearest(doubles(spark, enumerate(x)), doubles(spark, [(i, x[i]) for i in range(0, 40, 20)]), k=10, share=1.0))
    assert set(found) == {0, 20} and all(len(v) == 10 for v in found.values())
    with np.errstate(over="ignore", invalid="ignore"):
        for q, hits in found.items():
            s = (x * x[q]).sum(axis=1)
            order = sorted((i for i in range(40) if i != q), key=lambda i: (np.isnan(s[i]), -s[i] if not np.isnan(s[i]) else 0, i))[:10]
            assert [i for _, i in hits] == order
