import os
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from folioweave.llm.toxicity import DRIFT, SIGNIFICANT, Model, extreme_value, maximal_segments, op4_toxicity, score, train, training_rows

from .helpers import docs, write_docs


def brute_segments(scores):
    """All maximal segments by recursion on the best one (ties: leftmost, then shortest)."""

    def best(a, b):
        found = max(((sum(scores[i:j]), -i, -j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if found[0] <= 1e-9:
            return []
        i, j = -found[1], -found[2]
        return best(a, i) + [(i, j)] + best(j, b)

    return best(0, len(scores))


@given(st.lists(st.sampled_from([0.0, 0.0, 1.03, 2.17, 0.77]), max_size=14))
def test_segments_by_brute_force(values):
    hits = [(i, v, i, i + 1) for i, v in enumerate(values) if v]
    got = [(a, b) for _, a, b in maximal_segments(hits)]
    assert got == brute_segments([v or -DRIFT for v in values])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = op4_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.97
    toxic = [r for r in held if r.toxic]
    assert np.mean([r.predicted for r in toxic]) > 0.85


def test_odd_documents(spark, tmp_path):
    folder = write_docs(spark, tmp_path)
    spark.createDataFrame([(5, 1, 0), (None, 0, 1), (6, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert all(r.predicted == 0 and 0 <= r.score <= 1 for r in op4_toxicity(spark, folder).collect())


def test_passages_and_empty(spark):
    model = Model({"scum": 5.0, "clown": 5.0}, 0.1, 3.0, 1.0, -1.0)
    text = "a fine day " * 30 + "you scum and clown" + " then more words" * 30
    row = score(docs(spark, [(1, text)]), model).first()
    (passage,) = row.passages
    assert text[passage.start : passage.end] == "scum and clown" and row.score > 0.5
    assert score(docs(spark, []), model).count() == 0
    assert train(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).weights == {}


def test_score_by_brute_force(spark):
    """Words, segments, p-values and score of every text, the plain way."""
    rng = np.random.default_rng(8)
    words = ["scum", "clown", "clownish", "Moron", "fine", "day", "we", "walk"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40), p=[0.02, 0.02, 0.02, 0.02, 0.23, 0.23, 0.23, 0.23]))) for i in range(60)]
    model = Model({"scum": 3.03, "clow*": 2.07, "clown": 2.51, "moron": 1.01}, 0.02, 1.7, 2.0, -1.5)
    weight = {"scum": 3.03, "clown": 2.51, "clownish": 2.07, "moron": 1.01}
    got = {r.doc_id: r for r in score(docs(spark, rows), model).collect()}
    for i, text in rows:
        values = [weight.get(w.lower(), -DRIFT) for w in text.split()]
        starts = np.cumsum([0] + [len(w) + 1 for w in text.split()])
        surprise = {}
        for a, b in brute_segments(values):
            surprise[int(starts[a]), int(starts[b]) - 1] = 1.7 * sum(values[a:b]) - np.log(0.02 * (len(values) + 1))
        significant = {k: x for k, x in surprise.items() if 1 - np.exp(-np.exp(-x)) <= SIGNIFICANT}
        evidence = max(surprise.values(), default=-np.log(0.02 * (len(values) + 1))) + sum(sorted(significant.values())[:-1])
        z = np.sign(evidence) * np.log1p(abs(evidence))
        assert np.isclose(got[i].score, 1 / (1 + np.exp(1.5 - 2 * z)), rtol=1e-9)
        assert {(p.start, p.end) for p in got[i].passages} == set(significant)
        assert all(np.isclose(p.p, 1 - np.exp(-np.exp(-significant[p.start, p.end])), rtol=1e-6) for p in got[i].passages)


def test_extreme_value_law_is_found_again():
    rng = np.random.default_rng(1)
    size = rng.integers(20, 2000, 4000).astype(float)
    best = np.maximum(0, (np.log(0.003 * size) - np.log(-np.log(rng.random(4000)))) / 1.6)
    rate, decay = extreme_value(size, best)
    assert abs(rate / 0.003 - 1) < 0.15 and abs(decay / 1.6 - 1) < 0.1
    assert extreme_value(size, best * 0)[1] == 1.0


def test_a_doc_id_of_many_rows_is_one_training_row(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    rows = [(7, f"text {i}") for i in range(500)] + [(i, "x") for i in range(8, 20)]
    assert training_rows(docs(spark, rows), labels, 10).count() <= 10
