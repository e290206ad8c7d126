import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
AWKWARD = [
    (1, "the same words in the same order make copies of this short text", "en", "a", 1),
    (2, "The SAME words in the same order make copies of this short text", "en", "a", 1),
    (2, "The SAME words in the same order make copies of this short text", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", "en", None, 3),
    (6, LONG, "en", "b", len(LONG)),
    (None, "a row without an id, token = abcdefgh1234", "de", "c", 9),
    (8, "one", "de", "c", 3),
    (9, "One", "de", "c", 3),
    (10, "ünïcödé 𝒳 password: hunter2hunter2 end", "de", "é", 40),
]
# columns beyond those of the tables, some with names that operators use inside
EXTRA = {"score": "x", "n": 1, "id": 2, "blob": "b", "key": 3, "size": 4, "epoch": 5, "class": 6, "component": 7}


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def tables(spark, sf_dir):
    def read(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    return read
