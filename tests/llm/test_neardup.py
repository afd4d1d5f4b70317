import math
import re
from collections import defaultdict

import numpy as np

from folioweave.llm import neardup
from folioweave.llm.neardup import CHUNK, are_near, components, index_miss, keep_one, linked_in_block, near_duplicates, op9_minhash_dedup

from .helpers import ODD, docs, write_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def near_copies():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for group in range(12):
        base = [words[k] for k in rng.integers(0, 400, 120)]
        for copy in range(6):
            text = list(base)
            for _ in range(int(rng.integers(0, 5))):
                text[int(rng.integers(0, 120))] = f"edit{group}{copy}"
            rows.append((1000 + len(rows), " ".join(text)))
    # A chain whose ends are too far apart to be linked themselves.
    chain = [f"c{k}" for k in range(200)]
    for step in range(6):
        chain[step * 30] = f"s{step}"
        rows.append((2000 + step, " ".join(chain)))
    return rows


def test_against_brute_force(spark, tmp_path):
    rows = near_copies() + ODD
    got = op9_minhash_dedup(spark, write_docs(spark, tmp_path, rows)).collect()
    want = brute(rows, 85)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    size = dict(rows)
    assert all(r.n_shingles == len(shingles(size[r.doc_id])) for r in got)


def test_large_group_of_copies(spark):
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(400):
        text = list(base)
        text[int(rng.integers(0, 100))] = f"x{i}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(base)) for i in range(200)]
    got = near_duplicates(docs(spark, rows)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_far_signatures_lose_less_than_the_index(spark):
    """The share of pairs at the threshold that the filter drops, by exact binomial weights of each number of differing symbols."""
    for chunks, percent in ((8, 85), (10, 80)):
        n, same = chunks * CHUNK, percent / 100
        rows = [([0] * n, [1] * d + [0] * (n - d), d) for d in range(n + 1)]
        frame = spark.createDataFrame(rows, "sig_a array<int>, sig_b array<int>, d int").selectExpr("*", "100L AS n_a", "100L AS n_b")
        lost = [r.d for r in frame.where(~are_near(chunks, percent)).collect()]
        assert sum(math.comb(n, d) * (1 - same) ** d * same ** (n - d) for d in lost) <= 0.1 * index_miss(chunks, percent)


def test_keep_one_decides_by_document_not_by_id(spark):
    text = lambda name, n=60: " ".join(f"{name}{k}" for k in range(n))
    rows = [
        (1, text("a")), (5, text("a") + " more"), (5, text("b")), (None, text("a") + " other"),
        (7, text("c")), (7, text("c")), (None, text("d")), (None, text("d")), (9, text("e") + " x"), (8, text("e")),
        (10, ""), (11, None),
    ]
    got = keep_one(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns
    want = [(1, text("a")), (5, text("b")), (7, text("c")), (None, text("d")), (8, text("e")), (10, ""), (11, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    labels = defaultdict(set)
    for r in components(links).collect():
        labels[r.label].add(r.node)
    assert labels == {0: set(range(41)), 100: {100, 101}}


def test_empty_table(spark, tmp_path):
    assert op9_minhash_dedup(spark, write_docs(spark, tmp_path, [])).count() == 0


def alike_but_apart(n=90):
    """Texts of one group whose similarities spread from 0.5 to 1, few of them linked, and a chain among them."""
    rng = np.random.default_rng(11)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for copy in range(n):
        text = list(base)
        for at in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            text[at] = f"e{copy}x{at}"
        rows.append((copy + 1, " ".join(text)))
    return rows


def test_blocks_find_the_links_of_a_torn_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    rows = alike_but_apart() + near_copies()
    got = near_duplicates(docs(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows, 85)


def test_pairs_that_are_no_link_never_become_rows(spark, tmp_path):
    """Rows that the last comparison makes are links, at most one less than a block has members."""
    sig = np.repeat(np.arange(56, dtype=np.uint16)[None], 4, 0)
    sets = [np.arange(100), np.arange(5, 105), np.arange(50, 150), np.arange(100)]
    assert linked_in_block(sig, np.arange(4), sets, None, 0, 85, 8) == [(0, 1), (0, 3)]
    assert linked_in_block(sig, np.arange(4), sets, None, 7, 85, 8) == []  # an earlier bucket has these pairs
    assert linked_in_block(sig, np.array([5, 5, 6, 5]), sets, None, 0, 85, 8) == []
    assert linked_in_block(sig, np.arange(4), sets, np.array([True, False, False, True]), 0, 85, 8) == [(0, 1), (3, 1)]


def test_a_doc_id_of_many_rows(spark, tmp_path):
    rows = [(7, "one two three four five six seven"), (7, "other words of the same id here")] * 40 + [(9, "one two three four five six seven")]
    got = near_duplicates(docs(spark, rows)).collect()
    assert len(got) == 81 and {r["component_id"] for r in got} == {7}
