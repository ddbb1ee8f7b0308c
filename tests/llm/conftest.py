import pytest
from pyspark.sql import types as T

#: Texts of the cases that every operator must take: null, empty, blanks, ties, repeats, controls, long.
ODD = [None, "", " ", "\n\t\n", "a", "A b", "same text " * 9, "same text " * 9, "É ß 漢字 😀 \x00 \x1c x", "word " * 30_000, "tab\t\n foo  bar \n"]


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) rows, with extra columns whose names clash with those the operators use inside."""
    def build(rows):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.LongType()), T.StructField("part", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("n", T.LongType())])
        return spark.createDataFrame([(i, t, 1, None, "x", None) for i, t in rows], schema).repartition(3)
    return build


@pytest.fixture
def odd():
    return [*enumerate(ODD), (3, "repeated id"), (3, "repeated id"), (None, "no id"), (None, None)]
