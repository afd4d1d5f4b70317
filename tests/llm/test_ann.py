import numpy as np

from folioweave.llm.ann import nearest, op2_ann

SCHEMA = "label string, vec_id long, embedding array<float>"


def brute(rows, k=5):
    good = {(i, tuple(v)) for _, i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good:
        if i % 50:
            continue
        a = np.array(v, np.float32).astype(float)
        scored = []
        for j, w in good:
            b = np.array(w, np.float32).astype(float)
            if j != i:
                scored.append((-(a * b).sum() / (np.linalg.norm(a) * np.linalg.norm(b)), j))
        out[i] = sorted(scored)[:k]
    return out


def odd_rows():
    rng = np.random.default_rng(0)
    rows = [("x", i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(120)]
    same = rows[50][2]
    rows += [("x", 200 + i, same) for i in range(30)] + [("x", 201, same), ("x", 7, rows[7][2])]
    nan, inf = float("nan"), float("inf")
    return rows + [("x", 300, None), ("x", 350, [0.0] * 8), ("x", 400, [nan] * 8), ("x", 450, [1.0, None] * 4), ("x", 500, [inf] + [0.0] * 7), ("x", 550, []), ("x", 600, [1.0]), ("x", None, same)]


def check(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i, x in want.items() if x}
    for i, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(want[i]) + 1))
        assert np.allclose([-r[2] for r in rows], [s for s, _ in want[i]], atol=1e-12)
        assert [r[1] for r in rows] == [j for _, j in want[i]]


def test_odd_rows_by_brute_force(spark, tmp_path):
    """All buckets probed, so the search is exact; the rows hold everything that takes no part."""
    rows = odd_rows()
    got = nearest(spark.createDataFrame(rows, SCHEMA), lambda v: v % 50 == 0, probes=16).collect()
    check(got, brute(rows))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.query_id for r in op2_ann(spark, str(tmp_path)).collect()} == set(brute(rows))


def test_split_blocks_and_short_queries(spark):
    rows = odd_rows()
    frame = spark.createDataFrame(rows, SCHEMA)
    # Few probes of one table find too little; such queries are searched again in full.
    got = nearest(frame, lambda v: v % 50 == 0, tables=1, probes=1, block=4).collect()
    assert all(len([r for r in got if r.query_id == i]) == 5 for i in brute(rows))


def test_a_query_without_any_candidate_is_searched_in_full(spark):
    """Vectors of signed axes: a query's bucket holds no other vector."""
    rows = [("x", 50 * i, [float(i == k) + 0.001 * i * k for k in range(8)]) for i in range(8)]
    check(nearest(spark.createDataFrame(rows, SCHEMA), lambda v: v % 50 == 0, tables=1, probes=1, block=3).collect(), brute(rows))


def test_ties_go_to_the_least_id(spark):
    """Powers of two times one vector have the very same cosine."""
    base = np.random.default_rng(5).normal(size=8).astype(np.float32)
    rows = [("x", i, (base * 2.0 ** ((i * 7) % 58 - 20)).tolist()) for i in range(58)] + [("x", 100, (-base).tolist())]
    got = nearest(spark.createDataFrame(rows, SCHEMA), lambda v: v == 0, block=16).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5] and len({r.score for r in got}) == 1


def test_double_components_are_not_rounded(spark):
    rows = [("x", 0, [1.0, 1e-9, 0.0]), ("x", 1, [1.0, 0.1 + 1e-12, 0.0]), ("x", 2, [1.0, 0.1, 0.0])]
    got = nearest(spark.createDataFrame(rows, "label string, vec_id long, embedding array<double>"), lambda v: v == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 1]


def recall(got, x):
    unit = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i in range(0, len(x), 50):
        s = unit @ unit[i]
        s[i] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & {r.vec_id for r in got if r.query_id == i})
    return hits / (5 * len(range(0, len(x), 50)))


def test_recall_of_the_query(spark, tmp_path):
    """Gaussian vectors, which have no near neighbours, with every default."""
    x = np.random.default_rng(2).normal(size=(3000, 64)).astype(np.float32)
    spark.createDataFrame([("x", i, v) for i, v in enumerate(x.tolist())], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert recall(op2_ann(spark, str(tmp_path)).collect(), x) >= 0.9


def test_empty_and_lonely(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    assert op2_ann(spark, f"{tmp_path}/a").count() == 0
    spark.createDataFrame([("x", 50, [1.0, 2.0])], SCHEMA).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert op2_ann(spark, f"{tmp_path}/b").count() == 0
