import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioweave.llm import textvec
from folioweave.llm.quality import BASE, FEATURES, grow, judge, long_statistics, op5_quality_rules, statistics, train

from .helpers import ODD, docs, write_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, marked = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            marked |= set(range(i, i + 8))
    return [len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(marked)]


def test_counts_by_brute_force():
    rng = np.random.default_rng(1)
    alphabet = ["a", "b", "é", "##", "\n", " ", "\t", "a\n", "\x1c", "中", "|"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 120))) for _ in range(300)] + [t or "" for _, t in ODD]
    assert statistics(texts)[0].tolist() == [brute(t) for t in texts]


def test_odd_documents(spark, tmp_path):
    folder = write_docs(spark, tmp_path)
    spark.createDataFrame([(5, 1, 0), (9, 0, 0), (None, 0, 1), (6, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = op5_quality_rules(spark, folder).collect()
    assert sorted([r[c] for c in BASE] for r in rows) == sorted(brute(t) for _, t in ODD)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in rows)


def test_monotone_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = (rng.random(4000) < np.where(x[:, 0] > 0.5, 0.1, 0.9)).astype(float)
    y[x[:, 0] > 0.9] = 1.0
    model = grow(x, y, [-1, 0, 0])
    grid = np.full((50, 3), 0.5)
    grid[:, 0] = np.linspace(0, 1, 50)
    assert (np.diff(model.score(grid)) <= 1e-12).all()
    assert ((model.score(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.95


def test_empty_tables(spark, tmp_path):
    assert judge(docs(spark, []), None).count() == 0
    assert len(statistics([])[1]) == 0 and len(FEATURES) == statistics(["x"])[1].shape[1]


def test_long_texts_are_counted_segment_by_segment(monkeypatch):
    rng = np.random.default_rng(6)
    alphabet = ["a", "b", "é", "##", "\n", " ", "\t", "a\n", "\x1c", "\xa0", "中", "|", "word word "]
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 400))) for _ in range(60)] + ["x" * 300, " \n ", "a\n", "\n\n"]
    base, more = statistics(texts)
    sets, at = textvec.shingle_sets(texts)
    monkeypatch.setattr(textvec, "HASH_CHARS", 20)
    for k, text in enumerate(texts):
        long_base, long_more = long_statistics(text)
        assert long_base[0].tolist() == base[k].tolist() and np.allclose(long_more[0], more[k])
        assert textvec._long_set(text, 5).tolist() == sets[at[k] : at[k + 1]].tolist()


def test_a_text_over_one_chunk():
    text = "Ein Satz mit WORTEN, Zahl 12 und | Zeichen!\nNoch eine Zeile.\n" * 12_000
    base, more = statistics([text, "kurz"])
    assert len(text) > textvec.HASH_CHARS and base[0].tolist() == brute(text)
    assert base[1].tolist() == brute("kurz") and np.isfinite(more).all()


def walk(model, x):
    """One row through every tree, node by node."""
    margin = model.bias
    for node in model.roots:
        while model.feature[node] >= 0:
            node = model.left[node] + int(x[model.feature[node]] > model.threshold[node])
        margin += model.value[node]
    return 1 / (1 + np.exp(-margin))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_query_by_a_plain_walk_and_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = train(documents, labels.where(~held))
    got = {r.doc_id: r for r in judge(documents, model).join(labels.where(held), "doc_id").collect()}
    texts = {r.doc_id: r.text for r in documents.join(labels.where(held).select("doc_id"), "doc_id").collect()}
    for i in sorted(got)[:300]:
        _, more = statistics([texts[i] or ""])
        assert np.isclose(got[i].score, walk(model, more[0]))
        assert got[i].kept == (not got[i].base_failed and got[i].score >= 0.5)
    passed = [r for r in got.values() if not r.base_failed and r.quality is not None]
    right = np.mean([r.kept == bool(r.quality) for r in passed])
    good = np.mean([r.kept for r in passed if r.quality == 1])
    print("held out", len(passed), right, good)
    assert right > 0.9 and good > 0.95
