import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    os.environ.setdefault("PYTHONHASHSEED", "0")
    spark.sparkContext.environment["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def marks(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark, docs):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns named like those of the operators."""
    rows = [
        (1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (None, None), (None, "a b c d e f g h i j"), (2, ""), (3, None), (4, " \n\t "), (5, "x" * 70000), (6, "word " * 20000), (7, "É ß 中 😀 'tis"), (7, "other text altogether, of one line"),
    ]
    out = spark.createDataFrame([(i, t, None if i == 3 else "en", None if i in (2, None) else f"s{i % 2}", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: F.lit("mine") for c in ("score", "_row", "fp", "_fp", "bucket", "shard", "size", "label", "_label", "copy", "spans", "class")}
    return out.repartition(3).withColumns(extra).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
