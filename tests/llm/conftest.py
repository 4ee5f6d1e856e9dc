import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def documents(spark):
    """Make a documents table from (doc_id, text[, lang, source]) rows."""

    def make(rows):
        full = [(*row, *("en", "src0")[len(row) - 2 :]) if len(row) < 4 else row for row in rows]
        return spark.createDataFrame([(*row, len(row[1] or "")) for row in full], SCHEMA)

    return make


#: Texts that every operator over texts has to take.
ODD_TEXTS = [
    None, "", " \n\t ", "a", "one two three", "no_space" * 2000, "word " * 20000, "\x00\x1c\x85  x", "İΣß ﬁ é 中文字 \U0001f600",
    "<|endoftext|>", "<|im_start|><\\|im_end|>", "12 34 %%% --", "one two three", "'s't're \x0b y",
]
