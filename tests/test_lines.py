from pagemend.config import WHOLE_PASSES
from pagemend.operators import cleanup, lines, refine, review
from pagemend.plans.providers import pass_table, require_languages
from pagemend.schemas import WORDS
from pagemend.sources import tsv


def test_words_to_lines(spark):
    rows = [
        (0, 1, 1, 2, 1, 50, 100, 20, 10, "90", "low"), (0, 1, 1, 1, 2, 10, 10, 20, 10, "80.5", "hello"), (0, 1, 1, 1, 3, 40, 12, 25, 11, "-1", "there"), (0, 1, 1, 1, 4, 0, 0, 1, 1, "95", "  "),
        (0, 1, 1, 3, 5, 5, 5, 5, 5, "bad", "lost"), (0, 1, 1, 2, 6, 71, 99, 20, 10, "x", "box"), (1, 1, 1, 1, 7, 3, 3, 3, 3, "", "one"),
    ]
    out = {(r.image, r.row_no): r for r in lines.words_to_lines(spark.createDataFrame(rows, WORDS), [], 2.5).collect()}
    assert (out[0, 1].text, out[0, 1].conf, out[0, 1].x, out[0, 1].y, out[0, 1].w, out[0, 1].h) == ("hello there", 80.5, 4, 4, 22, 5)
    assert (out[0, 2].text, out[0, 2].conf, out[0, 2].w) == ("low box", 90.0, 8)  # an unreadable word gives text but no box
    assert (out[1, 1].text, out[1, 1].conf) == ("one", 0.0) and len(out) == 3  # a line without any box is dropped


def test_tsv(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    body = '5\t1\t1\t1\t1\t1\t10\t20\t30\t40\t96.5\t"quote\n5\t1\t1\t1\t1\t2\t50\t20\t30\t40\t91\tend"\n5\t2\tx\t1\t1\t1\t0\t0\t1\t1\t9\tno place\n'
    (tmp_path / "a.tsv").write_text(head + body, encoding="utf-8")
    words = tsv.read_words(spark, str(tmp_path / "a.tsv"))
    assert [r.text for r in lines.words_to_lines(words, []).collect()] == ['"quote end"']
    held = spark.createDataFrame([(7, head + body)], "side int, tsv string")
    assert [(r.side, r.text) for r in lines.words_to_lines(tsv.parse_words(held, ["side"]), ["side"]).collect()] == [(7, '"quote end"')]
    readings = lines.words_to_readings(tsv.parse_words(held, ["side"]), ["side"])
    assert [tuple(r) for r in readings.collect()] == [(7, '"quote end"', 93.75)]


def test_anchor_ids_have_gaps(spark):
    rows = spark.createDataFrame([(1, "L", 1, " a "), (1, "L", 2, " \t"), (1, "L", 3, "b"), (1234, "R", 1, "c")], "page int, side string, row_no int, text string")
    assert sorted((r.line_id, r.text) for r in lines.anchors(rows).collect()) == [("001-L-L001", "a"), ("001-L-L003", "b"), ("1234-R-L001", "c")]


def test_jobs_and_passes(spark):
    items = spark.range(5).withColumn("b", lines.F.lit("x"))
    jobs = lines.jobs(items, pass_table(spark, WHOLE_PASSES), 2, ["b"], ["id"]).collect()
    assert len(jobs) == 25 and {r.chunk for r in jobs} == {0, 1, 2}
    require_languages({"vie", "eng", "deu"})
    try:
        require_languages({"eng"})
        raise AssertionError
    except RuntimeError as e:
        assert "vie" in str(e)


def furniture(spark, sides):
    rows = [("b", s, n, t, 70.0) for s, ls in enumerate(sides) for n, t in enumerate(ls)]
    side = ["book", "side"]
    held = cleanup.numbered(spark.createDataFrame(rows, "book string, side int, row_no int, text string, conf double"), side)
    heads = cleanup.repeated_headers(held, spark.createDataFrame([("b", s) for s in range(len(sides))], "book string, side int"), "book")
    return heads, {(r.side, r.row_no): r.reason for r in cleanup.dispositions(held, heads, "book").collect()}


def test_furniture_reasons_in_order(spark):
    head = "The Long Header"
    heads, got = furniture(spark, [[head, "12", "body text", "**", "***", "— 7 —", "l0"], ["x", "y y y y y y y", "z", head, head, "9", "body", "body", "body"], ["THE LONG HEADER!", "", "a1"], [], [head.lower(), "é"]])
    assert [r.key for r in heads.collect()] == ["the long header"]  # three of five sides; the one below line three does not count
    assert [got[0, i] for i in range(7)] == ["repeated_header", "page_number", None, "ornament", None, "page_number", "page_number"]
    assert got[1, 3] == "repeated_header" and got[1, 4] is None and got[1, 5] is None and got[1, 0] is None
    assert [got[2, i] for i in range(3)] == ["repeated_header", "empty", None] and got[4, 1] is None


def test_paragraphs(spark):
    long = "a line of more than sixty-five characters that goes on to the very margin of it"
    rows = [("s", 0, 0, 20, "Heading"), ("s", 1, 24, 20, long), ("s", 2, 48, 20, "and ends."), ("s", 3, 72, 20, "Next one,"), ("s", 4, 120, 20, long), ("s", 5, 144, 20, " ")]
    lines_ = spark.createDataFrame(rows, "side string, row_no int, y int, h int, text string")
    got = [r.text for r in cleanup.paragraphs(lines_, ["side"]).orderBy("par").collect()]
    assert got == ["Heading", f"{long} and ends. Next one,", long]
    text = cleanup.side_texts(cleanup.paragraphs(lines_, ["side"]), ["side"], cleanup.side_tag(cleanup.F.lit(7), cleanup.F.lit("L"))).first().text
    assert text.startswith("===== PDF007-L =====\n\nHeading\n\n")


HELD = "line_id string, text string, conf double, reasons array<string>"


def test_votes_and_repairs(spark):
    cands = [("l", n, f"s{n}", "thói quen dứt khoát", 90.0) for n in range(4)] + [("l", 4, "s4", "other shape here x", 70.0), ("l", 5, "s5", "too few", 99.0), ("p", 0, "a", "x, y", 90.0), ("p", 1, "b", "x, y", 90.0), ("p", 2, "c", "x, y", 90.0), ("p", 3, "d", "x, y", 90.0)]
    c = spark.createDataFrame(cands, "line_id string, cand_order int, source string, text string, conf double")
    held = spark.createDataFrame([("l", "thói quen đứt khoát", 90.0, []), ("p", "x. y", 90.0, []), ("q", "alone", 90.0, [])], HELD)
    votes = refine.token_votes(held, c)
    assert {(r.old, r.new): r.votes for r in votes.collect()} == {("đứt", "dứt"): 4, ("x.", "x,"): 4}
    out = {r.line_id: r for r in refine.refine(held, votes, None).collect()}
    assert out["l"].text == "thói quen dứt khoát" and out["l"].edits[0].reason == "valid_diacritic_visual_margin" and list(out["l"].edits[0].sources) == ["s0", "s1", "s2", "s3"]
    assert out["p"].text == "x, y" and out["p"].edits[0].reason == "case_visual_consensus" and out["q"].edits == []


def test_lexicon_lets_three_votes_repair(spark):
    c = spark.createDataFrame([("l", n, f"s{n}", "the house", 90.0) for n in range(3)], "line_id string, cand_order int, source string, text string, conf double")
    held = spark.createDataFrame([("l", "the hovse", 90.0, [])], HELD)
    words = spark.createDataFrame([("the",), ("house",)], "word string")
    out = refine.refine(held, refine.token_votes(held, c), words).first()
    assert out.text == "the house" and out.edits[0].reason == "invalid_to_valid_visual_consensus"
    assert refine.refine(held, refine.token_votes(held, c), None).first().text == "the hovse"


def test_suspects_and_review(spark):
    cand = "array<struct<source:string,kind:string,text:string,conf:double,scale:double,psm:int>>"
    rows = [("a", "Plain words hovse 12x", 81.0, [("s", "w", "Plain", 1.0, None, None), ("t", "w", "plaìn", 2.0, None, None), ("u", "w", "", 3.0, None, None)]), ("b", "fine", 99.0, [])]
    held = spark.createDataFrame(rows, f"line_id string, text string, conf double, whole_candidates {cand}")
    words = spark.createDataFrame([("plain",), ("fine",)], "word string")
    got = {r.line_id: list(r.reasons) for r in refine.suspect_reasons(held, words).collect()}
    assert got == {"a": ["whole_pass_disagreement", "diacritic_disagreement", "low_word_conf", "non_dictionary:words,hovse"], "b": []}
    marked = refine.suspect_reasons(held, None).withColumn("edits", refine.F.array().cast("array<string>"))
    cands = marked.select("line_id", refine.F.posexplode("whole_candidates").alias("cand_order", "c")).select("line_id", "cand_order", "c.text", "c.conf")
    assert [(r.line_id, [a.text for a in r.alts]) for r in review.review_lines(marked, cands).collect()] == [("a", ["", "plaìn", "Plain"])]
