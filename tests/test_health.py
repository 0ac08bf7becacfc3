from itertools import product

from pagemend.config import HealthThresholds
from pagemend.operators import health as H
from pagemend.schemas import EVIDENCE

SIDE = ["book", "page", "side"]
CLEAN = ["Người đọc có thể hiểu nội dung chính của trang sách này một cách rõ ràng.", "Các câu văn được nối tiếp nhau bằng những ý tưởng đầy đủ và tự nhiên.", "Không có dấu hiệu hỏng nào trong phần văn bản được nhận dạng ở đây."]
NOISE = ["{1} ~~ |x [=] @@ # s } t < > ] $ ^ q", "0 = [| x } ~ @ ] # = a | { z } < b >", "u ] [ ~ | = @ # $ ^ x } { > < y | ~ ="]


def evidence(spark, sources):
    rows = [("b", 1, "L", name, i, n, text, float(conf), 0, 0, 100, 20) for i, (name, lines, conf) in enumerate(sources) for n, text in enumerate(lines)]
    return spark.createDataFrame(rows, EVIDENCE)


def report(spark, sources):
    found = evidence(spark, sources)
    words = spark.createDataFrame([], "word string")
    return H.side_health(H.pass_health(found, words, SIDE), H.cross_similarity(found, SIDE), spark.createDataFrame([("b", 1, "L"), ("b", 2, "R")], "book string, page int, side string"), SIDE)


def test_clean_prose_is_healthy(spark):
    out = {r.page: r for r in report(spark, [("base", CLEAN, 91), ("sharp", CLEAN, 89), ("p6", CLEAN, 88)]).collect()}
    assert not out[1].catastrophic and out[1].best_source == "base" and out[1].cross_pass_similarity == 1.0 and [p.source for p in out[1].passes] == ["base", "sharp", "p6"]
    assert out[2].catastrophic and list(out[2].reasons) == ["no_ocr_evidence"] and out[2].best_source is None


def test_soup_is_collapse_and_a_clean_retry_rescues(spark):
    noisy = [("base", NOISE, 43), ("sharp", NOISE[::-1], 39), ("p6", NOISE, 35)]
    before = report(spark, noisy).where("page = 1").first()
    assert before.catastrophic and len(before.reasons) >= 2
    after = report(spark, noisy[:2] + [("fallback_p6", CLEAN, 92), ("fallback_otsu", CLEAN, 90)]).where("page = 1").first()
    assert not after.catastrophic and after.best_source == "fallback_p6"


def test_all_reason_sets(spark):
    """Every subset of the five reasons against the rule."""
    sets = [[n for n, on in zip(H.REASONS, flags, strict=True) if on] for flags in product([0, 1], repeat=5)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, reasons array<string>")
    got = {r.i: r.c for r in rows.select("i", H.collapsed(H.F.col("reasons")).alias("c")).collect()}
    for i, s in enumerate(sets):
        has = set(s)
        soup, frag, lex, cross, conf = (n in has for n in H.REASONS)
        assert got[i] == ((soup and (lex or cross or frag)) or (lex and cross) or (conf and cross) or len(has) >= 3), s


def test_small_sides_and_ties(spark):
    out = report(spark, [("a", ["x ~"], 5), ("b", ["x ~"], 5)]).where("page = 1").first()
    assert not out.catastrophic and out.best_source == "a" and list(out.reasons) == []
    assert HealthThresholds().min_chars == 80


def test_lexicon_counts(spark):
    found = evidence(spark, [("a", ["alpha beta gamma1 xy zeta, alpha"], 90), ("blank", [" "], 90)])
    rows = {r.source: r for r in H.pass_health(found, spark.createDataFrame([("alpha",), ("zeta",)], "word string"), SIDE).collect()}
    assert rows["a"].dictionary_ratio == 0.75 and rows["a"].words == 6 and rows["blank"].words == 0 and rows["blank"].dictionary_ratio is None
