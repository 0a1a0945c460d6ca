"""Small tables with everything that operators must bear."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, content string, score double, a long, b long, start long, line_hash long, count long"


def docs(spark, rows, schema=SCHEMA):
    """A table of (doc_id, text) or (doc_id, text, source), with more columns whose names the operators use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "c", 0.5, 2, 3, 4, 5, 6) for r in rows]
    return spark.createDataFrame(full, schema)


ODD = [(None, None), (None, "a text without an id " * 4), (5, None), (6, ""), (7, " \n\t\n "), (8, "one"), (8, "one"), (9, "long words " * 30_000)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))
