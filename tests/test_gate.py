"""Cases of the gate, as data."""

import pytest

from pagemend.operators import gate

CASES = [
    ("thói quen đứt khoát", ["thói quen dứt khoát"], ("", "đứt", "dứt", ".95"), "thói quen dứt khoát", "ocr_evidence"),
    ("ông ta uà chờ", ["ông ta và chờ"] * 2, ("", "uà", "và", ".93"), "ông ta và chờ", "ocr_evidence"),
    ("sáng tạo để thấy 6 ngoài kia", ["sáng tạo để thấy ở ngoài kia"], ("", "6", "ở", ".98"), "sáng tạo để thấy ở ngoài kia", "ocr_evidence"),
    ("một câu bình thường", [], ("", "bình", "hoàn", ".99"), "một câu bình thường", "unsupported_new"),
    ("khán giả dé hiểu", [], ("", "dé", "dễ", ".98"), "khán giả dễ hiểu", "shape_preserving"),
    ("người kế chuyện tự do kết nối", ["người kể chuyện tự do kết nối"], ("", "kế", "kể", ".98"), "người kể chuyện tự do kết nối", "ocr_evidence"),
    ("4. Vidu về thói quen", [], ("segment", "Vidu", "Ví dụ", ".99"), "4. Ví dụ về thói quen", "segmentation_shape"),
    ("4. Vidu về thói quen", ["4. Ví dụ về thói quen"], ("segment", "Vidu", "Ví dụ", ".95"), "4. Ví dụ về thói quen", "segmentation_evidence"),
    ("một abc ví dụ", [], ("segment", "abc", "hai chữ", ".99"), "một abc ví dụ", "segmentation_without_visual_or_shape_support"),
    ("a b a", [], ("", "a", "á", ".99"), "a b a", "old_not_unique_token_in_current"),
    ("a b", [], ("", "a", "a", ".99"), "a b", "same_value"),
    ("a b", [], ("", "", "x", ".99"), "a b", "empty_token"),
    ("a b", [], ("", "a b", "x", ".99"), "a b", "old_must_be_one_token"),
    ("a b", [], ("replace", "a", "x y", ".99"), "a b", "replace_new_must_be_one_token"),
    ("abcd e", [], ("", "abcd", "a b c d", ".99"), "abcd e", "invalid_segmentation"),
    ("dé x", [], ("", "dé", "dễ", "high"), "dé x", "insufficient_confidence_for_evidence"),
    ("cost $1 \\E now", ["cost $2 \\E now"] * 2, ("", "$1", "$2", "1"), "cost $2 \\E now", "ocr_evidence"),
]
DDL = "id int, current string, candidates array<string>, ops array<struct<kind:string,old:string,new:string,confidence:string>>"


def test_cases(spark):
    rows = [(i, c[0], c[1], [c[2]]) for i, c in enumerate(CASES)]
    out = {r.id: r for r in gate.apply_ops(spark.createDataFrame(rows, DDL)).collect()}
    for i, (_, _, _, text, verdict) in enumerate(CASES):
        assert (out[i].corrected, out[i].audit[0].gate, out[i].audit[0].applied) == (text, verdict, out[i].corrected != CASES[i][0]), CASES[i]
    assert out[0].audit[0].required_confidence <= 0.95 and out[0].audit[0].evidence.new_votes == 1


def test_operations_see_what_earlier_ones_left_and_only_three_count(spark):
    ops = [("", "dé", "dễ", ".99"), ("", "dễ", "dẻ", ".99"), None, ("", "x", "ẋ", ".99")]
    out = gate.apply_ops(spark.createDataFrame([(1, "dé x", [], ops)], DDL)).first()
    assert out.corrected == "dẻ x" and [a.gate for a in out.audit] == ["shape_preserving", "shape_preserving", "empty_token"]


@pytest.mark.parametrize("votes,shape,needs", [(2, False, 0.92), (2, True, 0.90), (1, False, 0.95), (1, True, 0.93), (0, True, 0.98), (0, False, None)])
def test_required_confidence(spark, votes, shape, needs):
    got = spark.range(1).select(gate.required(0.97, gate.F.lit(votes), gate.F.lit(shape))).first()[0]
    assert got is None and needs is None or abs(got - needs) < 1e-12
