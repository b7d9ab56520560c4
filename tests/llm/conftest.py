import pytest
from pyspark.sql import types as T

#: Texts that every operator must live with.
ODD_TEXTS = [
    None, "", " ", "\n\n\n", "word", "two words", "a\nb\nc", "é😀 ß  x", "\x00\x1c\x85",
    "x" * 60_000, "long " * 20_000, "line one is here\n" * 3_000, "@" * 3000, "1" * 5000,
    "<" * 2000, "+1 " * 500, "same text twice over and over", "same text twice over and over",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, repeated rows and columns of clashing names."""
    rows = [(i if i % 7 else None, text, None if i % 3 else "en", "s", None, 1, "x")
            for i, text in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5], (5, "another text under the id of five", None, None, 3, 2, "y")]
    schema = T.StructType([
        T.StructField(name, kind()) for name, kind in [
            ("doc_id", T.LongType), ("text", T.StringType), ("lang", T.StringType),
            ("source", T.StringType), ("n_chars", T.LongType), ("n_tokens", T.IntegerType),
            ("key", T.StringType)]])
    frame = spark.createDataFrame(rows, schema)
    # Names the operators use themselves.
    from pyspark.sql import functions as F
    for name in ("spans", "pii", "token_ids", "decoded", "n_lines", "component_id", "kept", "band",
                 "chunk_no", "shard", "position", "block", "role", "a", "b", "item_id", "hub"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame.repartition(4)
