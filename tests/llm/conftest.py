import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; as columns of the input they must do no harm.
CLASHING = ("id", "n", "key", "k", "m", "at", "rep", "node", "bucket", "component", "component_id", "kept", "line", "leaf", "size", "rank", "finish", "target", "copies", "drop", "h", "url2", "digest", "own", "links", "part", "start", "classes", "common", "ref_lang")


def words(rng, n, vocabulary=None):
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [rng.choice(vocabulary) if vocabulary else "".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(n)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, schema=DOCS):
        width = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and blank texts, ties, repeated rows, copies, a long text, one source for a third."""
    rng = random.Random(11)
    a, b = " ".join(words(rng, 120)), "\n".join(" ".join(words(rng, 9)) for _ in range(12))
    near = " ".join([*a.split()[:-1], "other"])
    lines = "\n".join(f"{rng.choice('xyz')}{k} opened the door at {k} today" for k in range(6))
    rows = [
        (1, a, "en", "s1", 3), (2, a.upper(), "en", "s1", 3), (3, near, "en", "s1", None), (4, None, "en", "s1", 0), (5, "", "en", "s2", 0),
        (6, " \t\r\n\x0b\x0c ", None, "s2", 0), (7, b, "de", None, 5), (9, "one", "fr", "s3", 1), (10, "one", "fr", "s3", 1), (11, "ONE two", "fr", "é", 1),
        (12, lines, "en", "s1", 9), (13, lines + "\n\nanother line of five words", "en", "s1", 9), (14, lines[::-1], "en", "", 9), (15, lines, "en", "s1", 9),
        (16, " ".join(words(rng, 8000, words(rng, 3000))), "en", "s1", 9), (17, "no break 𝒳é ﬁ İ x" * 20, "xx", "s1", 9), (18, "a b c d e " * 400, "en", "s1", 9),
    ]
    return rows


@pytest.fixture(scope="session")
def with_clashes():
    def add(df):
        from pyspark.sql import functions as F

        return df.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHING if c not in df.columns])

    return add
