"""Small tables with every awkward row."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, id string, key string"


def table(spark, rows):
    """Rows of (doc_id, text, source); the other columns carry names that operators use inside."""
    full = [(d, t, "en", s, len(t or ""), "x", "y", "z") for d, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


AWKWARD = [
    (1, "Common line\nown one\n common LINE \n", "a"),
    (2, "common line\r\nÄ other", "a"),
    (2, "common line\r\nÄ other", "a"),
    (3, None, None),
    (4, "", "b"),
    (None, "common line", "b"),
    (None, None, None),
    (5, words(6000), "c"),
    (6, " \t\n  \x0b\n", "a"),
    (7, "x" * 50_000, "c"),
]
