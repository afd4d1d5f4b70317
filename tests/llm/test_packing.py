import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers as P
from tokenizers import Tokenizer

from folioweave.llm.packing import assign, capacities, op1_packing, pack_documents

from .helpers import docs, write_docs


def tokens(texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [x.ids + [0] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, expected):
    """Every id lies in one piece, sequences are gapless and full or a power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(expected)
    for doc, pieces in by_doc.items():
        left = defaultdict(int)
        for ids in expected[doc]:
            left[tuple(ids)] += 1
        at, ids = 0, expected[doc][0]
        if len(expected[doc]) == 1:
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids)
                assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(ids)
        else:
            assert sum(p.length for p in pieces) == sum(map(len, expected[doc]))
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)


def by_id(rows):
    out = defaultdict(list)
    for (i, _), ids in zip(rows, tokens([t for _, t in rows]), strict=True):
        out[i].append(ids)
    return out


def test_odd_documents(spark, tmp_path):
    from .helpers import ODD

    check(op1_packing(spark, write_docs(spark, tmp_path)).collect(), by_id(ODD))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(op1_packing(spark, folder).collect(), by_id(rows))


def test_small_blocks_and_ids(spark):
    out = pack_documents(docs(spark), P.path("byte_bpe_50k.json"), block_tokens=100, with_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)


def test_empty_table(spark, tmp_path):
    assert op1_packing(spark, write_docs(spark, tmp_path, [])).count() == 0


def test_balance_and_capacity():
    assert capacities(2 * 1024 + 5) == [1024, 1024, 4, 1]
    lengths = [int(x) for x in np.random.default_rng(0).integers(1, 900, 500)]
    placed = assign(lengths)
    cost = defaultdict(float)
    for _, _, n, k, _ in placed:
        cost[k] += n + n * n / 1024
    full = [cost[k] for k in range(sum(lengths) // 1024)]
    in_order, at = [0.0] * (sum(lengths) // 1024 + 2), 0
    for n in lengths:
        while n:
            take = min(n, 1024 - at % 1024)
            in_order[at // 1024] += take + take * take / 1024
            at, n = at + take, n - take
    assert np.std(full) < np.std(in_order[: len(full)])


def test_a_text_over_one_chunk(spark, tmp_path):
    rows = [(1, "Überall stand ein Wort-Ungetüm 12345 und noch eins. " * 25_000), (2, "kurz")]
    check(op1_packing(spark, write_docs(spark, tmp_path, rows)).collect(), by_id(rows))
