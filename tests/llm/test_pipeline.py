import numpy as np
import pytest

import corpus_pipeline as pipeline
from folioweave.llm import toxicity
from folioweave.llm.packing import SIZE

from .helpers import docs
from .test_neardup import brute

LINES = ["shared footer line of the site", "another shared line"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(7)
    words = [f"word{k}" for k in range(3000)]
    path, rows, labels = tmp_path_factory.mktemp("corpus"), [], []
    text = lambda n: [words[k] for k in rng.integers(0, 3000, n)]
    for i in range(400):
        w = text(80)
        kind = i % 8
        if kind == 0:
            for at in range(3, 80, 12):
                w[at] = ("scumbag", "clownish", "moronic")[at % 3]
        if kind == 1:
            w = [x + "%%%" for x in w]
        body = " ".join(w[:40]) + "\n" + " ".join(w[40:]) + ("\n" + LINES[i % 2] if i % 3 == 0 else "")
        rows.append((i, body))
        if i % 5:
            labels.append((i, int(kind != 1), int(kind == 0)))
    rows += [(1000 + i, rows[2 + i // 4 * 8][1] + f" tail{i % 4}") for i in range(12)] + [(2000, None), (2001, ""), (2002, "too short")]
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def stage(spark, folder, number):
    source = spark.read.parquet(f"{folder}/documents.parquet")
    return source, pipeline.STAGES[number][1](spark, source, folder)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_filters_keep_clean_documents(spark, folder):
    source, good = stage(spark, folder, 0)
    assert good.columns == source.columns
    kept = texts(good)
    assert not any(i % 8 == 1 for i in kept if i < 400) and 2002 not in kept and 2000 not in kept
    assert all(i in kept for i in range(400) if i % 8 not in (0, 1))
    source, clean = stage(spark, folder, 1)
    kept = texts(clean)
    assert clean.columns == source.columns and not any(i % 8 == 0 for i in kept if i < 400)
    assert all(i in kept for i in range(400) if i % 8)


def test_lines_and_near_duplicates_by_brute_force(spark, folder):
    source, lines = stage(spark, folder, 2)
    before, after = texts(source), texts(lines)
    assert lines.columns == source.columns and set(before) == set(after)
    first = {line: min(i for i, t in before.items() if line in (t or "").split("\n")) for line in LINES}
    dropped = 0
    for i, text in before.items():
        stay = [x for x in (text or "").split("\n") if first.get(x, i) == i]
        dropped += len((text or "").split("\n")) - len(stay)
        assert after[i] == "\n".join(stay)
    assert dropped > 100
    source, single = stage(spark, folder, 3)
    component = brute(list(before.items()), 80)
    assert single.columns == source.columns and set(texts(single)) == {i for i, c in component.items() if i == c}


def test_many_exact_copies_end_as_one_document(spark, folder, tmp_path):
    """Ten copies hold nothing but lines that ten documents share; one of them is packed, whole, and no emptied one."""
    source = spark.read.parquet(f"{folder}/documents.parquet")
    own = "\n".join(" ".join(f"word{(k * 37 + line * 11) % 3000}" for k in range(30)) for line in range(4))
    copies = spark.createDataFrame([(5000 + i, own, "en", "s", len(own)) for i in range(12)], source.schema)
    source.unionByName(copies).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    packed = pipeline.run(spark, str(tmp_path)).collect()
    mine = [r for r in packed if r.doc_id >= 5000]
    assert {r.doc_id for r in mine} == {5000} and sum(r.length for r in mine) > 100
    assert min(r.doc_tokens for r in packed) > 1


def test_whole_run(spark, folder):
    packed = pipeline.run(spark, folder).collect()
    assert {(r.sequence_tokens == SIZE or r.sequence_tokens & (r.sequence_tokens - 1) == 0) for r in packed} == {True}
    ids = {r.doc_id for r in packed}
    assert not any(i % 8 in (0, 1) for i in ids if i < 400) and not any(1000 <= i < 2000 for i in ids)


def test_empty_corpus(spark, tmp_path):
    docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    assert toxicity.Model({}).probability(0, []) < 0.5
