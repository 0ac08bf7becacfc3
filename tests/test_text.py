import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from pagemend.functions import similarity
from pagemend.functions import text as T
from pagemend.functions.numbers import rounded

TEXTS = ["Ví dụ — Đường 42!", "«Größe» ẞß", "a  b\tc d\n", "", "   ", "é́x", "€uro $5 #1 @x * [y] <z> = | % & / + _", "x" * 30 + " \x07", "'quoted'", "ZEBRA-ñandú…", "1.2,3", "naïve façade Ångström Łódź"]


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(T.F.col("t"))).first()[0]


def many(spark, column, texts=TEXTS):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column(T.F.col("t"))).collect()]


def test_accents_and_cores(spark):
    plain = ["".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").replace("đ", "d").replace("Đ", "D") for t in TEXTS]
    assert many(spark, T.strip_accents) == [unicodedata.normalize("NFC", p) if p else p for p in plain]
    edges = T.TOKEN_EDGES
    words = ["(Ví", "dụ)…", "—", "ẞtraße.", "«x»", "'A'"]
    assert many(spark, T.token_core, words) == [w.strip(edges).casefold() for w in words]
    assert many(spark, T.shape, ["Ví dụ", "Vidu", "Đ-x!"]) == ["vidu", "vidu", "dx"]


def test_measures(spark):
    odd = re.compile(r"[^\w\sÀ-ỹĐđ.,;:!?…'\"“”‘’()\-–—/+%&]")
    assert many(spark, T.garbage) == [len(odd.findall(t)) for t in TEXTS]
    assert many(spark, T.visible) == [sum(not c.isspace() for c in t) for t in TEXTS]
    assert many(spark, T.garbage_score)[3] == 100.0 and many(spark, T.garbage_score)[7] == 2.0 + 6.0 + 10.0
    assert many(spark, T.strip) == [t.strip() for t in TEXTS]
    assert many(spark, T.tokens) == [t.split() for t in TEXTS]


def test_lines_and_escapes(spark):
    texts = ["a\nb", "a\r\nb\x0bc\x85d e\n", "", "\n\n"]
    assert many(spark, T.split_lines, texts) == [t.splitlines() for t in texts]
    assert one(spark, "<a href=\"x\">'&</a>", T.escape_xml) == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&lt;/a&gt;"
    assert one(spark, "a b/ç.txt", T.safe_name) == "a_b_.txt"
    assert many(spark, T.confidence, ["95.5", "x", "", "-1"]) == [95.5, -1.0, -1.0, -1.0]


def test_header_key(spark):
    assert many(spark, T.header_key, ["Chương 1: Đường  dài!", "ÉTÉ-x"]) == ["chuong 1 đuong dai", "ete x"]


def test_replacing_once(spark):
    rows = spark.createDataFrame([("a b a", "b", "$1"), ("a b a", "a", "x"), ("aaa", "aa", "b"), ("x", "", "y")], "t string, o string, n string")
    got = [tuple(r) for r in rows.select(T.spelled_once(T.F.col("t"), T.F.col("o")), T.replace_once(T.F.col("t"), T.F.col("o"), T.F.col("n"))).collect()]
    assert [g[0] for g in got] == [True, False, True, False] and got[0][1] == "a $1 a"


def test_rounding_is_exact(spark):
    values = [0.125, 0.375, 2.675, 58.29374999999999, 58.29375, 63.831250000000004, 0.00005, 1.00005, -0.125, 1e-9, 123456.78945, 44.75625]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    for digits in (0, 2, 4, 5):
        assert [r[0] for r in rows.select(rounded(T.F.col("v"), digits)).collect()] == [round(v, digits) for v in values]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aáàbđ c", max_size=25), st.lists(st.text(alphabet="aáàbđ c", max_size=25), max_size=6))
def test_best_match_equals_comparing_with_all(text, rows):
    scores = [similarity.ratio(similarity.folded(text), similarity.folded(r)) for r in rows]
    best = max(range(len(rows)), key=lambda i: scores[i], default=None)
    assert similarity.best_matches([text], rows, 0.45) == [best if best is not None and scores[best] >= 0.45 else None]
