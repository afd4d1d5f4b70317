import os

import duckdb
import pytest

from folioweave.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents conversations events".split()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, name, tmp_path):
    df = catalogue.QUERIES[name](spark, FOLDER)
    df.write.parquet(str(tmp_path / "out"))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    con.execute(f"CREATE TABLE want AS {catalogue.ORACLES[name]}")
    con.execute(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    for a, b in (("want", "got"), ("got", "want")):
        assert con.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() == []


def test_quality_gate_judges_rewrites_of_whole_texts(spark, tmp_path):
    text = "Uzun bir konuşma. " * 300
    spark.createDataFrame([(1, m, "user", text) for m in range(4)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.id: r.validation for r in catalogue.QUERIES["quality_gate"](spark, str(tmp_path)).collect()}
    assert {v.original_characters for v in got.values()} == {len(text)}
    assert [got[f"1/{m}"].cleaned_characters for m in range(4)] == [len(text), len(text), len(text) + len("Analiz: "), len(text.replace("e", ""))]
    assert got["1/0"].valid and not any("length_ratio_out_of_range" in got[f"1/{m}"].reasons for m in range(3))


def test_the_entry_stands_without_the_optional_subpackage(tmp_path):
    import subprocess
    import sys

    code = "import sys; sys.modules['folioweave.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'tts_manifest' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
