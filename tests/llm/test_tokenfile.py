import os
import zlib

import numpy as np
import pytest
import public_tokenizers as P
from tokenizers import Tokenizer

from folioweave.llm.tokenfile import op6_token_orc, read_tokens, write_tokens

from .helpers import ODD, docs, write_docs


def expected(rows):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out, start = [], 0
    for (i, _), e in zip(rows, t.encode_batch([x or "" for _, x in rows], add_special_tokens=False), strict=True):
        ids = e.ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=lambda r: r[1])


def got(df):
    return [tuple(r) for r in sorted(df.select("doc_id", "start", "n_tokens", "ids_crc32").collect(), key=lambda r: r[1])]


def test_odd_documents(spark, tmp_path):
    assert got(op6_token_orc(spark, write_docs(spark, tmp_path))) == expected(ODD)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert got(op6_token_orc(spark, folder)) == expected(rows)


def test_empty_table(spark, tmp_path):
    assert op6_token_orc(spark, write_docs(spark, tmp_path, [])).count() == 0


def test_pruned_read(spark, tmp_path):
    path = str(tmp_path / "orc")
    write_tokens(docs(spark), path, P.path("word_bpe_49k.json"), partitions=3)
    assert {r.doc_id for r in read_tokens(spark, path, [5, 9]).collect()} == {5, 9}
    plan = read_tokens(spark, path, [5])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id, [5])]" in plan or "EqualTo(doc_id,5)" in plan
    from pyarrow import orc

    part = next(f for f in os.listdir(path) if f.endswith(".orc"))
    assert orc.ORCFile(f"{path}/{part}").nstripes >= 1


def test_a_text_over_one_chunk_and_rows_of_one_doc_id(spark, tmp_path):
    rows = [(1, "Überall stand ein Wort-Ungetüm 12345 und noch eins. " * 25_000)] + [(5, "the same row")] * 300 + [(None, "none")] * 40 + [(9, "last")]
    assert got(op6_token_orc(spark, write_docs(spark, tmp_path, rows))) == expected(rows)


def test_rows_of_one_doc_id_are_split_over_files(spark, tmp_path):
    write_tokens(docs(spark, [(5, "the same row")] * 400).repartition(4), f"{tmp_path}/t", P.path("word_bpe_49k.json"), partitions=8)
    sizes = [r["count"] for r in spark.read.orc(f"{tmp_path}/t").groupBy("part").count().collect()]
    assert sum(sizes) == 400 and max(sizes) < 200
