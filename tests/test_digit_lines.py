"""Lines that begin or end with the digits of their own index, or with blanks, against the SQL."""

import duckdb
import pytest

from pagemend import queries

TEXTS = [
    "0 Zéro tient ici 0\n1219538112535716 Éaielletre un 11\n  deux blancs devant et derrière  \n33 trois 3",
    "Premier texte sans chiffre\n1\nLes 2 chats 2\nune autre ligne 3",
    "Oben stand nichts\n\n 2 Straßen 22 \n3",
]


@pytest.fixture(scope="module")
def digits(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("digits"))
    # ids of which some lines get a dash, a suffix or an edit, and some nothing
    spark.createDataFrame([(i, TEXTS[i % 3]) for i in range(60)], "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["prompt_batches", "queue_context", "queue_dispositions", "queue_with_replies", "deep_queue"])
def test_equals_sql(spark, digits, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{digits}/documents.parquet/*.parquet')")
    got = queries.queries()[name](spark, digits)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and want
