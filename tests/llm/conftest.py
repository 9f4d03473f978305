import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SF_DIR = "/root/testdata/sf0.001"

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        # columns that have names of the operators' own
        T.StructField("print", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("component_id", T.StringType()),
        T.StructField("doc", T.StringType()),
        T.StructField("tie", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("_print", T.StringType()),
        T.StructField("_doc", T.StringType()),
        T.StructField("_Tie", T.StringType()),
        T.StructField("_spans", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("count", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def odd_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and long texts, ties, repeated rows, repeats within and across texts."""
    draw = random.Random(3)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    passage = " ".join(draw.choice(words) for _ in range(60))
    plain = " ".join(draw.choice(words) for _ in range(90))
    long = " ".join(draw.choice(words) for _ in range(30_000))
    return [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b\x0c\r "),
        (4, "one"),
        (5, plain),
        (6, plain),
        (7, plain.upper() + " more"),
        (8, "a b c " + passage + " x y z"),
        (9, passage + "\n\n" + passage),
        (10, "the " * 300),
        (11, long),
        (12, "    mid dle ́ ﬁ Å \U0001f600\U0001f600 中文字符 " + passage[:200]),
        (13, long[:5000] + " " + long[:5000]),
        (14, "x" * 20_000),
        (15, plain),
        (15, plain),
        (-3, plain.replace("w1 ", "v1 ", 1)),
        (None, passage),
        (None, None),
        (9_000_000_000, passage.lower()),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", "p", "s", "c", "d", "t", "sp", "p", "d", "t", "s", "k", "c", 7) for i, t in odd_texts()]
    return spark.createDataFrame(rows, DOCS).repartition(4, "n_chars", F.xxhash64("text"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
