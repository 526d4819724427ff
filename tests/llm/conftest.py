import pytest

#: Texts that every operator must bear: null, empty, blank, short, ties, repeats, odd characters, one very long.
TEXTS = [None, "", " \n\t ", "one", "one two three four", "one two three four five six", "one two three four five six", "a  b", "é😀 ñ\x00 中文\n\nzwei", "x" * 5000, "word " * 3000, "1 2 3", "▁ meta"]


@pytest.fixture(scope="session")
def edge(spark):
    """Odd rows, a null id, a repeated row, an id with two texts, and columns whose names the operators use inside."""
    rows = [(k, x, "en" if k % 2 else None, "s", k) for k, x in enumerate(TEXTS)] + [(None, "no id at all here", "en", None, 1), (5, TEXTS[5], None, "s", 5), (5, "other text under one id", "en", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    for name in ("score", "kept", "h", "key", "cls", "node", "g", "x0", "batch", "range", "bucket", "kind"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
