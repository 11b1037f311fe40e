import pytest
from pyspark.sql import types as T

#: A table with nulls, blanks, ties, repeated rows, a long text and columns that bear names the operators use inside.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("doc", T.StringType()),
    T.StructField("fp", T.LongType()), T.StructField("_size", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("n_tokens", T.StringType()),
])


def document_rows():
    good = "The first meeting of the council was held in autumn and nobody wrote down what had been said there by the older members"
    more = " ".join(f"word{i} follows another{i} quietly" for i in range(20))
    texts = [
        None, "", " \t\n\x0b\f\r ", "one", "two words", good, good, good + " ever", more + "\n" + good, more + "\n" + good + "!", "ÄÖ x\x1cy  z\n\n\n",
        " ".join(["### $$$ &&&"] * 40), "same line here, long enough to be compared with others\n" * 30, " ".join(f"w{i % 997}x{i}" for i in range(6000)), more,
    ]
    rows = [(i, t, "en", "abc"[i % 3] if i % 5 else None, len(t or ""), "x", 1, 2, 3, "y") for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[8], (None, good, None, "a", 5, None, None, None, None, None), (5, "another text under an id that is taken already", "en", "a", 1, "", 0, 0, 0, "")]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(document_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
