import pytest

from icuflow.llm.session import prepare


@pytest.fixture(scope="session")
def llm(spark):
    """The session as the queries prepare it."""
    prepare(spark)
    return spark


@pytest.fixture
def docs(llm):
    """Makes a documents table; columns that operators use inside come along as clashing extras."""

    def make(rows, extra=True):
        df = llm.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
        if extra:
            for name in ("key", "n", "id", "spans", "n_words", "token_ids", "bucket", "score", "row", "target", "mentions"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df.repartition(3)

    return make


#: Rows that every operator must survive: nulls, empty and blank texts, repeated rows, ties, no id.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Alpha beta gamma"), (4, "Alpha beta gamma"), (5, "alpha beta  gamma"), (None, "alpha beta gamma"), (6, "é漢 ½ 😀!"), (7, "word " * 3000)]
