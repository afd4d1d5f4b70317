from folioweave.sources import services


def test_results_of_a_worker_are_bounded(spark):
    """A service is asked for as many texts as its answers may fill the room; all texts of a partition at once were asked for before."""
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('a', 100) AS text")

    def large(texts):
        return [b"%6d" % len(texts) + b"x" * 400_000 for _ in texts]

    calls = [int(r.n) for r in services.applied(rows.limit(300), large, "text", "out", "binary").selectExpr("substring(out, 1, 6) AS n").collect()]
    assert len(calls) == 300 and max(calls) * 400_000 <= 2 * services.RESULT_BYTES
    small = services.applied(rows, services.identity_cleaner, "text", "out", "string")
    assert small.where("text = out").count() == 3000
    assert max(r.n for r in services.applied(rows, lambda texts: [len(texts)] * len(texts), "text", "n", "int").collect()) == services.MOST_TEXTS


def test_shares_take_every_text_once():
    texts = [16, 21, 3016, 17, 17, 16, 16] + [17] * 600
    got = list(services.shares(texts, lambda: 1000.0))
    assert [s for s, _, _ in got] == [0] + [e for _, e, _ in got[:-1]] and got[-1][1] == len(texts)
    assert all(e > s and (w <= 1000 or e == s + 1) for s, e, w in got)
    assert list(services.shares([], lambda: 1.0)) == []


def test_an_abort_ends_the_run_across_calls(spark):
    """Batches are cut into calls, but a run ends where its error says; what follows has no attempts."""
    def call(text):
        if text == "7":
            raise RuntimeError("tokens per day exhausted")
        return text

    rows = spark.range(0, 1000, 1, 1).selectExpr("id", "cast(id AS string) AS text")
    done = services.applied(rows, services.attempted(call), "text", "r", "struct<value:string,error:string,error_class:string,attempts:bigint>")
    got = {r.id: r.r.attempts for r in done.collect()}
    assert [i for i, n in got.items() if n] == list(range(8)) and len(got) == 1000
    again = services.attempted(call)
    assert [r["attempts"] for r in again(["7", "8"])] == [1, 0] and [r["attempts"] for r in again(["8"])] == [1]
