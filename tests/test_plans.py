import functools
import io
import json
import sys
import time
import zipfile

import numpy as np
import pytest

from pagemend import cli, config
from pagemend.operators import queue
from pagemend.plans.deep import run_deep
from pagemend.plans.local import run_local
from pagemend.plans.providers import EngineProvider, TableProvider, ask, find_program, installed_languages, png
from pagemend.schemas import AUDIT, EVIDENCE
from pagemend.sinks import epub, files
from pagemend.sinks.logs import RunLog
from pagemend.sources import images, json_files, lexicon, marker_text, pdf
from pagemend.streaming import queue_stream

CLEAN = ["Người đọc có thể hiểu nội dung chính của trang sách này một cách rõ ràng.", "Các câu văn được nối tiếp nhau bằng những ý tưởng đầy đủ và tự nhiên.", "Không có dấu hiệu hỏng nào trong phần văn bản được nhận dạng ở đây."]
NOISE = ["{1} ~~ |x [=] @@ # s } t < > ] $ ^ q", "0 = [| x } ~ @ ] # = a | { z } < b >", "u ] [ ~ | = @ # $ ^ x } { > < y | ~ ="]
TEXT = "===== PDF001-L =====\n\nĐoạn một.\n\nĐoạn hai.\n\n\n===== PDF001-R =====\n\nTrang phải.\n"


def rows(page, source, order, lines, conf):
    return [("b", page, "L", source, order, n, t, conf, 0, 30 * n, 100, 20) for n, t in enumerate(lines)]


def sources(spark):
    plain = [t.replace("được", "duoc") for t in CLEAN]
    whole = rows(1, "p0", 0, plain, 75.0) + rows(1, "p1", 1, CLEAN, 74.0) + rows(1, "p2", 2, CLEAN, 73.0) + rows(2, "p0", 0, NOISE, 43.0) + rows(2, "p1", 1, NOISE[::-1], 39.0) + rows(3, "p0", 0, NOISE, 40.0) + rows(3, "p1", 1, NOISE[::-1], 30.0)
    again = rows(2, "fallback_a", 5, CLEAN, 92.0) + rows(2, "fallback_b", 6, CLEAN, 90.0)
    line = [(f"b/001-L-L{n:03d}", f"line_{k}", k, CLEAN[n], 90.0) for n in range(3) for k in range(4)]
    return TableProvider(spark.createDataFrame(whole, EVIDENCE), spark.createDataFrame(again, EVIDENCE), spark.createDataFrame(line, "line_id string, source string, pass_order int, text string, conf double"))


def test_local_run(spark):
    provider = sources(spark)
    run = run_local(provider, provider.whole.select("book", "page", "side").distinct(), spark.createDataFrame([], "word string"))
    audit = {r.page: (r.fallback_used, r.rescued) for r in run.health_audit().collect()}
    assert audit == {1: (False, False), 2: (True, True), 3: (True, False)}
    text = run.texts.first().text
    assert "được nối tiếp" in text and text.startswith("===== PDF001-L =====") and "===== PDF002-L =====" in text
    got = run.summary().first().asDict()
    assert (got["sides_in"], got["fallback_triggered"], got["fallback_rescued"], got["fallback_unresolved"], got["edits"]) == (3, 2, 1, 1, 2)
    assert {r.page for r in run.side_review().collect()} == {3}
    assert all("whole_side_catastrophe" in r.reasons for r in run.refined.where("page = 3").collect())


def deep_inputs(spark):
    cand = lambda *texts: [("s", "whole", t, 90.0, None, None) for t in texts]
    audit = [
        ("1", 1, "L", ["low_word_conf"], "Đoạn mot.", "Đoạn mot.", [], cand("Đoạn một."), cand("Đoạn một.")),
        ("2", 1, "R", ["low_word_conf"], "— Trang phải.", "", [], [], []), ("3", 1, "R", [], "x", "x", [], [], []), ("4", 1, "R", ["whole_side_catastrophe"], "x", "x", [], [], []), ("5", 1, "R", ["a"], "nowhere", "nowhere", [], [], []), ("6", 1, "R", ["a"], " ", "", [], [], []),
    ]
    df = spark.createDataFrame(audit, AUDIT).withColumnRenamed("id", "item_id").withColumn("book", queue.F.lit("b"))
    return df, spark.createDataFrame([("b", TEXT.replace("một", "mot"))], "book string, text string")


def test_deep_run_patches_what_evidence_supports(spark):
    audit, texts = deep_inputs(spark)
    reply = 'thinking…\n```json\n{"items":[{"id":"1","ops":[{"kind":"replace","old":"mot","new":"một","confidence":0.95},"junk"]},{"id":"9","ops":[]}]}\n```'
    run = run_deep(TableProvider(None, replies=spark.createDataFrame([("b", 0, reply)], "book string, batch_no long, reply string")), audit, texts)
    assert {r.item_id: r.disposition for r in run.admitted.collect()} == {"1": "queued", "2": "queued", "3": "done", "4": "collapsed", "5": "unresolved", "6": "blank"}
    assert run.patched.first().text == TEXT
    got = run.summary().first().asDict()
    assert (got["queue_items"], got["skipped_items"], got["applied_lines"], got["applied_ops"], got["patched_lines"], got["missed_lines"], got["ai_calls"]) == (2, 3, 1, 1, 1, 0, 1)
    assert [o.gate for r in run.audit().where("item_id = '1'").collect() for o in r.ops] == ["ocr_evidence", "empty_token"]


def test_an_unanswered_batch_stops_everything(spark):
    audit, texts = deep_inputs(spark)
    provider = TableProvider(None, replies=spark.createDataFrame([("b", 0, "no json")], "book string, batch_no long, reply string"))
    with pytest.raises(RuntimeError, match="1 of 1"):
        run_deep(provider, audit, texts)


def test_books_with_the_same_batch_numbers_keep_their_replies(spark):
    audit, texts = deep_inputs(spark)
    both = audit.unionByName(audit.withColumn("book", queue.F.lit("c")))
    reply = lambda new: json.dumps({"items": [{"id": "1", "ops": [{"kind": "replace", "old": "mot", "new": new, "confidence": 0.99}]}]})
    replies = spark.createDataFrame([("b", 0, reply("một")), ("c", 0, reply("mốt"))], "book string, batch_no long, reply string")
    run = run_deep(TableProvider(None, replies=replies), both, texts.unionByName(texts.withColumn("book", queue.F.lit("c"))))
    assert run.calls == 2
    assert {r.book: r.corrected for r in run.gated.where("item_id = '1'").collect()} == {"b": "Đoạn một.", "c": "Đoạn mốt."}


def program(path, body):
    """A stand-in for an outside program."""
    path.write_text(f"#!{sys.executable}\n{body}", encoding="utf-8")
    path.chmod(0o755)
    return str(path)


ENGINE = """
import pathlib, sys, zlib
if "--list-langs" in sys.argv:
    print("List of languages (2):\\neng\\nvie")
    sys.exit()
log = pathlib.Path(__file__).with_name("calls")
marked = pathlib.Path(__file__).with_name("marked").exists()
images = pathlib.Path(sys.argv[1]).read_text().split()
language, psm = sys.argv[sys.argv.index("-l") + 1], sys.argv[sys.argv.index("--psm") + 1]
with log.open("a") as f:
    f.write(f"{len(images)} {language} {psm}\\n")
print("level\\tpage_num\\tblock_num\\tpar_num\\tline_num\\tword_num\\tleft\\ttop\\twidth\\theight\\tconf\\ttext")
for n, name in enumerate(images, 1):
    data = pathlib.Path(name).read_bytes()
    assert data[:4] == b"\\x89PNG"
    mark = "Trang " + "abcdefghij"[zlib.crc32(data[16:24]) % 10] * 3 + str(int.from_bytes(data[16:20], "big")) + ". "
    lines = ["Người đọc có thể hiểu nội dung chính của trang sách này một cách rõ ràng.", "Các câu văn được nối tiếp nhau bằng những ý tưởng đầy đủ và tự nhiên."]
    for row, line in enumerate(lines if psm in "34" else lines[:1], 1):
        for k, word in enumerate(((mark if marked else "") + line).split(), 1):
            print(f"5\\t{n}\\t1\\t1\\t{row}\\t{k}\\t{100 * k}\\t{300 * row}\\t90\\t50\\t{80 if language == 'vie' else 75}\\t{word}")
"""


def test_engine_reads_sides_and_lines_in_batches(spark, tmp_path):
    engine = program(tmp_path / "engine", ENGINE)
    assert installed_languages(engine) == {"eng", "vie"}
    image = np.full((60, 80), 255, np.uint8)
    sides = spark.createDataFrame([("b", page, side, 60, 80, 1, image.tobytes()) for page in (1, 2) for side in "LR"], "book string, page int, side string, height int, width int, channels int, pixels binary")
    provider = EngineProvider(sides, engine, workers=1)
    keys = ["book", "page", "side"]
    whole = provider.read_sides(sides.where("page = 1 or side = 'L'"), keys).collect()
    calls = lambda: [x.split() for x in (tmp_path / "calls").read_text().split("\n") if x]
    assert sorted(c[0] for c in calls()) == sorted(["2"] * 5 + ["1"] * 5)  # three sides, two at once, five passes
    assert len(whole) == 3 * 5 * 2 and {r.pass_order for r in whole} == set(range(5)) and {r.row_no for r in whole} == {1, 2}
    first = next(r for r in whole if r.row_no == 1 and r.source == "base_ve_25")
    assert first.text.startswith("Người đọc") and (first.x, first.y, first.conf) == (40, 120, 75.0)
    (tmp_path / "calls").unlink()
    again = provider.read_fallback(sides.where("page = 2"), keys).collect()
    assert {c[0] for c in calls()} == {"1"} and len(calls()) == 8 and {r.pass_order for r in again} == {5, 6, 7, 8}
    (tmp_path / "calls").unlink()
    asked = spark.createDataFrame([("b", 1, "L", f"l{n:02d}", 1, n, 30, 10) for n in range(30)], "book string, page int, side string, line_id string, x int, y int, w int, h int")
    read = provider.read_lines(asked).collect()
    assert sorted(c[0] for c in calls()) == sorted(["28"] * 5 + ["2"] * 5) and len(read) == 150 and {r.conf for r in read} == {75.0, 80.0}
    assert png(image)[:8] == b"\x89PNG\r\n\x1a\n"
    bad = EngineProvider(sides, program(tmp_path / "bad", "import sys; sys.exit('no')"), workers=1)
    with pytest.raises(Exception, match="recognition by base_ve_25 failed"):
        bad.read_sides(sides, keys).collect()


def test_replies_of_a_program(spark, tmp_path):
    asked = spark.createDataFrame([("b", n, f"prompt {n} é") for n in range(3)], "book string, batch_no long, prompt string")
    said = program(tmp_path / "said", "import sys, json; t = open(sys.argv[1], encoding='utf-8').read(); print('ok', json.dumps({'items': [], 'said': t})) if '1' not in t else sys.exit('broken')")
    replies = {r.batch_no: r.reply for r in EngineProvider(None, "", command=[said, "{prompt}"]).reply(asked).collect()}
    assert json.loads(json_files.first_json(replies[0]))["said"] == "prompt 0 é" and replies[1] is None and replies[2]
    locked = program(tmp_path / "locked", f"import sys, pathlib; p = pathlib.Path({str(tmp_path / 'n')!r}); n = len(p.read_text()) if p.exists() else 0; p.write_text('x' * (n + 1)); sys.exit('database is locked') if n < 2 else print('[]')")
    assert ask([locked, "{prompt}"], "x", 20, (0.01, 0.01)).strip() == "[]"
    with pytest.raises(RuntimeError):
        ask([program(tmp_path / "broken", "import sys; sys.exit(3)")], "x", 20, (0.01,))


def test_book_to_book_by_command_line(spark, tmp_path, monkeypatch):
    engine = program(tmp_path / "engine", ENGINE)
    (tmp_path / "scan.pdf").write_bytes(b"xx")
    (tmp_path / "marked").touch()

    def draw(path, index, scale):
        page = np.full((400, 900, 3), 255, np.uint8)
        page[50:350, 50 : 300 + 40 * index] = 0
        page[50:350, 500 : 700 + 90 * index] = 0
        return page

    monkeypatch.setattr(pdf, "sides", functools.partial(pdf.sides, renderer=(lambda path: 2, draw)))
    out = tmp_path / "out"
    assert cli.main([str(tmp_path / "scan.pdf"), "--start", "1", "--end", "2", "--output", str(out), "--tesseract", engine, "--workers", "2", "--batch-sides", "2"]) == 0
    paths = config.outputs(config.LOCAL_OUTPUTS, "scan_1_2", str(out))
    text = open(paths["text"], encoding="utf-8").read()
    assert text.count("=====") == 8 and "Người đọc" in text and zipfile.is_zipfile(paths["book"])
    assert json.load(open(paths["summary"]))["sides_in"] == 4 and len(json.load(open(paths["health"]))) == 4
    said = program(tmp_path / "model", "import json; print(json.dumps({'items': []}))")
    assert cli.main([str(tmp_path / "scan.pdf"), "--start", "1", "--end", "2", "--output", str(out), "--deep-only", "--reply-program", said, "--model", "m"]) == 0
    assert open(config.outputs(config.DEEP_OUTPUTS, "scan_1_2", str(out))["text"], encoding="utf-8").read() == text


def test_compiled_word_list(spark, tmp_path):
    unpack = program(tmp_path / "unpack", "import sys; [open(sys.argv[3] + x, 'w').write('x') for x in ('lstm-unicharset', 'lstm-word-dawg')]")
    listed = program(tmp_path / "list", "import sys; open(sys.argv[3], 'w').write('Sách\\n\\nđọc\\nsách\\n')")
    assert sorted(r.word for r in lexicon.compiled_lexicon(spark, "vie.traineddata", unpack, listed).collect()) == ["sách", "đọc"]
    assert lexicon.compiled_lexicon(spark, "vie.traineddata", "/no/such", listed).count() == 0


def test_stream_of_replies(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    items = spark.createDataFrame([("1", "dé x", ["dễ x"]), ("2", "y", [])], "item_id string, current string, candidates array<string>")
    for n, op in enumerate((("1", "dé", "dễ"), ("2", "y", "z"))):
        reply = json.dumps({"items": [{"id": op[0], "ops": [{"old": op[1], "new": op[2], "confidence": 0.99}]}]})
        (folder / f"{n}.json").write_text(json.dumps({"batch_no": n, "reply": reply}))
        time.sleep(0.05)
    query = queue_stream.gate_stream(queue_stream.read_replies(spark, str(folder), 1), items, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.item_id, r.corrected) for r in out} == {("1", "dễ x"), ("2", "y")} and len({r.batch for r in out}) == 2


def test_marker_text(spark):
    text = "before\n" + TEXT + "\n===== PDF1234-L =====\nfour digits\n===== PDF001-L =====\n\n again \n"
    texts = spark.createDataFrame([("b", text), ("c", "no marker")], "book string, text string")
    got = [(r.ord, r.page, r.side, list(r.paragraphs)) for r in marker_text.sides(texts).orderBy("ord").collect()]
    assert got == [(1, 1, "L", ["Đoạn một.", "Đoạn hai."]), (2, 1, "R", ["Trang phải."]), (3, 1234, "L", ["four digits"]), (4, 1, "L", ["again"])]
    lines = {(r.page, r.side): list(r["lines"]) for r in marker_text.page_lines(texts).collect()}
    assert lines[1, "L"] == ["Đoạn một.", "Đoạn hai.", "again"] and len(lines) == 3


def test_epub_round_trip_and_source(spark, tmp_path):
    sides = marker_text.sides(spark.createDataFrame([("b", TEXT)], "book string, text string"))
    made = epub.books(sides, "book", "ord", queue.F.format_string("PDF%03d-%s", "page", "side"), queue.F.col("paragraphs")).first()
    names = zipfile.ZipFile(io.BytesIO(bytes(made.epub))).namelist()
    assert names[0] == "mimetype" and {"EPUB/p001.xhtml", "EPUB/p002.xhtml"} <= set(names) and made.pages == 2
    epub.validate(bytes(made.epub))

    def altered(change):
        old, out = zipfile.ZipFile(io.BytesIO(bytes(made.epub))), io.BytesIO()
        with zipfile.ZipFile(out, "w") as new:
            for entry in old.infolist():
                name, content = change(entry.filename, old.read(entry.filename).decode())
                if name:
                    new.writestr(name, content)
        return epub.faults(out.getvalue())

    assert altered(lambda name, content: (name, content)) == []
    assert altered(lambda name, content: (name, content.replace("<p>", "<q>"))) and altered(lambda name, content: (None if "p002" in name else name, content)) == ["EPUB/p002.xhtml is missing"]
    assert altered(lambda name, content: (name.replace("p002", "p009"), content)) == ["EPUB/p002.xhtml is missing", "EPUB/p009.xhtml is not in the manifest"]
    assert altered(lambda name, content: (name, content.replace('idref="p2"', 'idref="p7"'))) == ["the reading order names p7, which the manifest does not"]
    assert altered(lambda name, content: (name, "other" if name == "mimetype" else content)) and epub.faults(b"x")
    with pytest.raises(ValueError):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("x", "y")
        epub.validate(out.getvalue())
    epub.register(spark)
    spark.createDataFrame([("a/b", bytes(made.epub))], "book string, epub binary").write.format("epub").mode("append").save(str(tmp_path / "books"))
    assert [p.name for p in (tmp_path / "books").iterdir()] == ["a_b.epub"]


def test_json_replies():
    find = json_files.first_json
    assert find('x {bad} [1, 2] {"a": 1}') == "[1, 2]" and find("none") is None and find(None) is None
    assert find('\x1b[1m{"a": "}"}\x1b[0m tail') == '{"a": "}"}' and find("```json\n{oops}\n```") is None and find('```\n[1]\n``` {"b":2}') == "[1]"


def test_lexicon(spark, tmp_path):
    (tmp_path / "w.txt").write_text("Alpha\n\n  beta \nalpha\n", encoding="utf-8")
    assert sorted(r.word for r in lexicon.read_lexicon(spark, str(tmp_path / "w.txt")).collect()) == ["alpha", "beta"]
    assert lexicon.read_lexicon(spark, str(tmp_path / "none.txt")).count() == 0


def test_files_of_rows_and_single_files(spark, tmp_path):
    rows = spark.createDataFrame([("é", [1, 2], None), ("b", [], "x\ny")], "id string, held array<int>, said string")
    files.write_rows(rows, str(tmp_path / "rows"))
    back = json_files.read_json(spark, str(tmp_path / "rows" / "*.json"), "id string, held array<int>, said string")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert sorted(json.loads(files.as_json(rows)), key=str) == sorted([{"id": "é", "held": [1, 2], "said": None}, {"id": "b", "held": [], "said": "x\ny"}], key=str)
    assert json.loads(files.as_json(rows.limit(0))) == [] and json.loads(files.as_json(rows.where("id = 'b'"), whole=True))["said"] == "x\ny"
    place = str(tmp_path / "new" / "one.txt")
    for text in (TEXT, "shorter é\n"):
        files.put(spark, place, text)
        assert files.get(spark, place) == text
    files.put(spark, str(tmp_path / "book.txt"), TEXT)
    read = marker_text.read_texts(spark, str(tmp_path / "book.txt")).collect()
    assert len(read) == 1 and read[0].text.rstrip("\n") == TEXT.rstrip("\n")


def test_images(spark):
    page = np.full((200, 400, 3), 255, np.uint8)
    page[50:60, 30:100] = 0
    page[80:90, 260:300] = 10
    left, right = images.halves(page)
    assert left.shape[0] == 10 + 16 and left.shape[1] == 70 + 16 and right.shape[:2] == (26, 56)
    df = spark.createDataFrame([(7, 200, 400, 3, page.tobytes())], "page int, height int, width int, channels int, pixels binary")
    assert sorted((r.page, r.side, r.height, r.width) for r in images.split_spreads(df).collect()) == [(7, "L", 26, 86), (7, "R", 26, 56)]
    assert images.trim(np.full((20, 20, 3), 255, np.uint8)).shape == (20, 20, 3)
    g = images.gray(page)
    for name in images.TRANSFORMS:
        assert images.prepare(page, name, 2.5).shape == (500, 1000)
    assert set(np.unique(images.otsu(page))) == {0, 255} and images.otsu(page)[55, 50] == 0 and images.adaptive(page)[55, 50] == 0 and images.adaptive(page)[5, 5] == 255
    assert (images.sharpen(np.full((9, 9), 77, np.uint8)) == 77).all() and (images.resize(g, 1.0) == g).all()
    assert images.crop(page, 30, 50, 70, 10).shape[:2] == (22 + 10 + 22, 25 + 70 + 25)
    with pytest.raises(ValueError):
        images.check_range(3, 2, 9)
    images.check_range(1, 9, 9)


def test_pages_of_a_book(spark, tmp_path):
    (tmp_path / "book.pdf").write_bytes(b"xxx")
    drawn = (lambda path: len(open(path, 'rb').read()), lambda path, index, scale: np.full((30, 60, 3), 10 * index, np.uint8))
    got = pdf.sides(spark, str(tmp_path / "book.pdf"), 2, 3, renderer=drawn).collect()
    assert sorted((r.page, r.side) for r in got) == [(2, "L"), (2, "R"), (3, "L"), (3, "R")] and all(r.channels == 3 for r in got)
    with pytest.raises(ValueError):
        pdf.spreads(spark, str(tmp_path / "book.pdf"), 2, 4, renderer=drawn)


def test_log(tmp_path, capsys):
    with RunLog(tmp_path / "a" / "run.log") as log:
        log("één 100 %")
    assert (tmp_path / "a" / "run.log").read_text(encoding="utf-8") == "één 100 %\n" and "100 %" in capsys.readouterr().out


def test_command_line(spark, tmp_path):
    provider = sources(spark)
    provider.whole.drop("book").write.parquet(str(tmp_path / "e"))
    provider.fallback.drop("book").write.parquet(str(tmp_path / "f"))
    base = [str(tmp_path / "book.pdf"), "--start", "1", "--end", "9", "--output", str(tmp_path / "out")]
    assert cli.main([*base, "--evidence", str(tmp_path / "e"), "--fallback", str(tmp_path / "f")]) == 0
    paths, later = config.outputs(config.LOCAL_OUTPUTS, "book_1_9", str(tmp_path / "out")), config.outputs(config.DEEP_OUTPUTS, "book_1_9", str(tmp_path / "out"))
    assert json.load(open(paths["summary"]))["sides_in"] == 3 and zipfile.is_zipfile(paths["book"])
    assert cli.main([*base, "--deep-only"]) == 0
    assert open(later["text"], encoding="utf-8").read() == open(paths["text"], encoding="utf-8").read()
    assert json.load(open(later["summary"]))["ai_calls"] >= 0
    with pytest.raises(FileNotFoundError):
        find_program(None, "NO_SUCH_VARIABLE", ("no-such-program",))
