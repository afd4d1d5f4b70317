import zlib
from collections import defaultdict

from folioweave.llm.sharding import assign_shards, op10_sharding, schedule

from .helpers import ODD, docs, write_docs


def check(rows, source):
    assert sorted(((r.doc_id or -1), r.size, r.text_crc32) for r in rows) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in source)
    slots, group = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        group[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(8))
    assert all(len(x) == 1 for x in group.values())


def test_odd_documents(spark, tmp_path):
    out = op10_sharding(spark, write_docs(spark, tmp_path)).collect()
    check(out, ODD)
    assert all(r.law == "bytes" and r.grown_shard is None for r in out)


def test_near_equal_bytes(spark):
    rows = [(i, f"text {i} " * (1 + i % 40)) for i in range(6000)] + [(9000 + i, "copy " * 50) for i in range(300)]
    out = assign_shards(docs(spark, rows)).collect()
    check(out, rows)
    load = defaultdict(int)
    for r in out:
        load[r.shard] += r.size
    assert max(load.values()) < 1.01 * min(load.values())


def test_hot_group_is_whole(spark):
    rows = [(i, "hot" * 10) for i in range(200)] + [(1000 + i, f"cold {i}") for i in range(300)]
    check(assign_shards(docs(spark, rows)).collect(), rows)


def test_empty_table(spark, tmp_path):
    assert op10_sharding(spark, write_docs(spark, tmp_path, [])).count() == 0


def test_schedule_is_longest_first():
    assert schedule([(5, "a"), (4, "b"), (3, "c"), (3, "d")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_one_doc_id_and_equal_rows_are_spread_over_cells(spark):
    rows = [(5, f"text {i}") for i in range(400)] + [(5, "the same row")] * 400 + [(None, "none")] * 50
    check([r for r in assign_shards(docs(spark, rows)).collect()], rows)


def test_against_scheduling_every_group_by_itself(spark):
    """With fewer groups than units and each above the limit, the shards are those of the plain schedule."""
    rows = [(i, "x" * (100 + 7 * (i % 23)) + str(i % 40)) for i in range(200)]
    size = defaultdict(int)
    for _, t in rows:
        size[t] += len(t) + 1
    want = sorted(sum(size[t] for t, s in schedule([(n, t) for t, n in size.items()], 8).items() if s == k) for k in range(8))
    load = defaultdict(int)
    for r in assign_shards(docs(spark, rows)).collect():
        load[r.shard] += r.size
    assert sorted(load.values()) == want
