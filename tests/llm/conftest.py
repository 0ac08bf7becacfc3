import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Invented prose of a seed: prose(seed, words)."""

    def make(seed, n, lexicon=4000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(lexicon):x}q" for _ in range(n))

    return make


@pytest.fixture()
def put(spark, tmp_path):
    """Writes tables of a folder: put(documents=(rows, ddl), ...) gives the folder."""

    def write(**tables):
        for name, (rows, ddl) in tables.items():
            spark.createDataFrame(rows, ddl).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
