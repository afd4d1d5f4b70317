import hashlib
import time
from collections import Counter

from pyspark.sql import functions as F

from folioweave.llm.linededup import drop_common_lines, op8_line_dedup

from .helpers import ODD, docs, write_docs

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)


def expected(rows, least=10):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    count = Counter(k for _, lines in split for k in {key(x) for x in lines} if k)
    out = []
    for i, lines in split:
        stay = [x for x in lines if count[key(x)] < least]
        out.append((i or -1, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def test_odd_documents(spark, tmp_path):
    rows = ODD + [(100 + i, f"  SHARED Line É\nown {i}\nshared line É \r\n\nshared line é") for i in range(12)] + [(200 + i, "Shared line É") for i in range(3)]
    out = op8_line_dedup(spark, write_docs(spark, tmp_path, rows)).collect()
    assert sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.kept_sha256) for r in out) == expected(rows)


def test_low_threshold_hits_everything(spark):
    out = drop_common_lines(docs(spark), min_documents=2)
    assert "extra" in out.columns and sum(r.line_dropped for r in out.collect()) == sum(r[2] for r in expected(ODD, 2))


def test_native_plan(spark):
    plan = drop_common_lines(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark, tmp_path):
    assert op8_line_dedup(spark, write_docs(spark, tmp_path, [])).count() == 0


def test_columns_of_any_name_are_kept(spark):
    names = ["gone", "d1", "h1", "k", "pos", "row", "t", "__text", "line_total", "first", "holder"]
    source = docs(spark, [(i, "shared line here\nown line") for i in range(12)]).withColumns({c: F.lit(c) for c in names})
    for keep_first in (False, True):
        out = drop_common_lines(source, keep_first=keep_first)
        assert out.columns == [*source.columns, "line_total_", "line_dropped"]
        rows = out.collect()
        assert all(r[c] == c for r in rows for c in names) and {r.line_total_ for r in rows} == {2}
        # Both lines are shared by all twelve.
        assert sorted((r.text, r.line_dropped) for r in rows)[:11] == [("", 2)] * 11
        assert (max(r.text for r in rows) == "shared line here\nown line") == keep_first


def test_first_holder_keeps_its_lines(spark):
    rows = [(i, f"own {i}\nShared Line\nshared line ") for i in range(20, 5, -1)] + [(None, "shared line")] + [(3, "other")]
    kept = {r.doc_id: r.text for r in drop_common_lines(docs(spark, rows), keep_first=True).collect()}
    assert kept.pop(6) == "own 6\nShared Line\nshared line " and kept.pop(3) == "other" and kept.pop(None) == ""
    assert all(text == f"own {i}" for i, text in kept.items())


def test_a_text_of_many_lines_takes_linear_time(spark):
    def seconds(n):
        rows = [(i, "\n".join(f"line {k}" if k % 2 else f"own {i} {k}" for k in range(n))) for i in range(12)]
        at = time.perf_counter()
        assert drop_common_lines(docs(spark, rows)).agg(F.sum("line_dropped")).first()[0] == 6 * n
        return time.perf_counter() - at

    seconds(100)
    small, large = seconds(4000), seconds(16000)
    assert large < 8 * small + 1
