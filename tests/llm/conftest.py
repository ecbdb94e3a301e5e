import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text) or (doc_id, text, source)."""

    def build(rows, extra=False):
        full = [(d, t, "en", (rest or ["s0"])[0], None if t is None else len(t)) for d, t, *rest in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:  # columns whose names the operators use inside
            for c in ("row", "size", "members", "pattern", "label", "node", "digest", "spans", "base", "times", "length"):
                df = df.withColumn(c, df["doc_id"].cast(T.StringType()))
        return df

    return build


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """(doc_id, text) of the small documents table."""
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture()
def folder(tmp_path):
    return f"file://{tmp_path}/work"


#: Nulls, empty and long texts, ties, repeated rows, odd signs.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three four"), (6, "word " * 3000), (7, "word " * 3000), (8, "Grüße 😀 ß " * 40), (8, "Grüße 😀 ß " * 40),
    (9, "a\x01b\x85c d e <|endoftext|> </s>"), (10, "x" * 70000), (None, "no id here but text " * 20), (11, "tab\tsep\r\nlines\x0b\x0cend"), (-5, "negative id text with some more words to read " * 9),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
