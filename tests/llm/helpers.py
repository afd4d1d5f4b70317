"""Small odd tables that every operator must take."""

DOCS = "extra string, doc_id long, text string, lang string, source string, n_chars long"

LONG = "alpha beta gamma\n" * 4000
ODD = [
    (1, "The quick brown fox jumps over the lazy dog.\nSame line\n"),
    (2, "The quick brown fox jumps over the lazy dog.\nSame line\n"),
    (3, None),
    (4, ""),
    (5, LONG),
    (6, "x"),
    (None, "no id here"),
    (7, "It's 12'345 — naïve  café\t\tΣΑΣ İstanbul ﬁ\r\n\x85end"),
    (8, "same row"),
    (8, "same row"),
    (9, "a" * 5000),
    (10, " \t\n \x0b "),
    (11, "don't 'S 's's '' I'll we've ,'re"),
    (12, "abc<|endoftext|>def <|startoftext|><|endoftext|>  's <|ENDOFTEXT|> <|endoftext"),
]


def docs(spark, rows=ODD):
    full = [("clash", i, t, None if i == 6 else "en", "src0", len(t) if t else None) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def write_docs(spark, folder, rows=ODD):
    docs(spark, rows).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)
