"""Lines of other scripts, with wide blanks and with young signs, against the SQL."""

import unicodedata

import duckdb
import pytest

from pagemend import queries
from pagemend.functions import text as T

ODD = ["Ελλάς και ὀξεῖα", "мир, йод и ёлка", "テキスト が ここ", "\u05e9\u05c1\u05c1\u05b8לום", "한국어 문장", "\xa0", "\u3000\u2003Blancs larges devant et derrière\xa0", "\U0001fae0 un signe jeune", "\u212b \u212a \u2126"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    # long and short lines, ids of which some lines get a dash, a suffix or an edit, and some nothing
    texts = ["\n".join([x, f"Une ligne qui tient plus de trente signes {x}", f"x{x}y", f"{x} fin"]) for x in ODD]
    spark.createDataFrame([(i * 7, texts[i % len(ODD)]) for i in range(40 * len(ODD))], "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


def wanted(d, name, columns):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    return con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()


@pytest.mark.parametrize("name", ["queue_dispositions", "queue_with_replies"])
def test_equals_sql(spark, odd, name):
    got = queries.queries()[name](spark, odd)
    want = wanted(odd, name, got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_lines_without_an_answer(spark, odd):
    """The size of no array is -1 where the session is not ANSI."""
    was = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        got = queries.queries()["queue_with_replies"](spark, odd)
        want = wanted(odd, "queue_with_replies", got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(want) and {0, 2} == {n for *_, n in want}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", was)


def test_accents_of_all_scripts(spark):
    texts = [*ODD, "ǅ ﬃ ḗ ᾧ Й ガ क़ \ufb2a"]
    plain = ["".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn") for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(T.strip_accents(T.F.col("t"))).collect()] == [unicodedata.normalize("NFC", p) for p in plain]


def test_young_signs_are_no_controls(spark):
    rows = spark.createDataFrame([(0, "a\U0001fae0"), (1, "a\x07"), (2, "a\u200b"), (3, "a\U000e0080"), (4, "a\t\n")], "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(T.garbage_score(T.F.col("t"))).collect()] == [2.0, 12.0, 12.0, 12.0, 0.0]
