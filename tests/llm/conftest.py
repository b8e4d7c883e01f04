import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("_wanted", T.StringType()),
    T.StructField("keep_id", T.StringType()), T.StructField("size", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("_copies", T.StringType()), T.StructField("_own", T.StringType()), T.StructField("v", T.StringType())])
LONG = "Lorem ipsum  dolor\tsit\n" * 30_000
TEXTS = [
    (1, "Same text here"), (2, "same TEXT here"), (3, "SAME TEXT HERE"), (4, None), (5, ""), (6, "   \n\t "), (7, "É"), (8, "é"),
    (9, LONG), (10, LONG + "x"), (11, "Released under the MIT License. Apache License, Version 2.0; CC BY-NC 4.0"), (11, "Released under the MIT License. Apache License, Version 2.0; CC BY-NC 4.0"),
    (12, "one"), (None, "one"), (None, None), (13, "word " * 2000), (14, "a b　c ▁▁x  y \r\n z"), (15, "under the mit license " * 3),
    (16, "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files"),
    (17, "日本語 テキスト 😀 \x00 end"), (18, "quick brown fox jumps over the lazy dog near the river bank today")]


def rows(texts):
    return [(i, t, "en", None if i is None or i % 3 == 0 else f"s{i % 3}", 1, "w", "k", "z", "l", "c", "o", "v") for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows, shared and missing ids, columns with clashing names."""
    return spark.createDataFrame(rows(TEXTS), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return TEXTS
