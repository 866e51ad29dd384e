import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with the table's other columns and clashing extras."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (", score string, doc long, span long, key string, ids string, fp string, base string, found string, `__letter` string, `__cuts` string, `__doc` string, kinds string, letter string, there string, row string, size long" if extra else "")
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * 0, *(("x", 7, 7, "k", "i", "f", "b", "f", "l", "c", "d", "n", "e", "t", "r", 3) if extra else ())) for i, t in rows], schema)

    return make


@pytest.fixture
def folder(tmp_path, spark):
    """A folder of tables for a query."""

    def make(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "The same text, twice over."), (6, "The same text, twice over."), (7, "é日本😀 <|im_end|> \x00 ▁"), (8, "long " * 40_000), (-3, "below zero"), (None, "no id"), (5, "Another text under an id that has one. " * 8), (5, "The same text, twice over.")]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD
