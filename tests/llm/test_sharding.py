import zlib

from pagemend.llm import sharding as S

DDL = "doc_id long, text string, shard string, at int"


def run(spark, put, texts, extra=()):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + list(extra)
    return S.op7_shards(spark, put(documents=(rows, DDL))).collect(), rows


def laws(out, rows):
    assert sorted(str(r.doc_id) for r in out) == sorted(str(x[0]) for x in rows)
    texts = {x[0]: x[1] for x in rows}
    slots = {}
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        assert 0 <= r.shard < 40
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_are_balanced_whole_and_keep_copies_together(spark, put, prose):
    texts = [prose(i, 20 + i * 7 % 90) for i in range(900)] + [prose(5, 30)] * 7 + [prose(6, 31)] * 5 + [None, "", None]
    out, rows = run(spark, put, texts)
    laws(out, rows)
    total, largest = sum(r.size for r in out), max(r.size for r in out)
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(40)]
    assert all(abs(x - total / 40) <= 2 * largest for x in sizes)
    split = {t for t in texts if len({r.shard for r in out if texts[r.doc_id] == t}) > 1}
    assert len(split) <= 3  # only groups too large to keep


def test_a_hot_text_is_split(spark, put, prose):
    texts = [prose(i, 50) for i in range(200)] + [prose(999, 50)] * 400
    out, rows = run(spark, put, texts)
    laws(out, rows)
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(40)]
    assert max(sizes) - min(sizes) <= 4 * max(r.size for r in out)


def test_few_rows_empty_table_and_repeats(spark, put):
    out, rows = run(spark, put, ["a", "b", "b"], [(1, "b", "x", 1), (None, "n", None, None)])
    assert len(out) == 5 and {(r.shard, r.slot) for r in out}.__len__() == 5
    assert run(spark, put, [])[0] == []
    out, _ = run(spark, put, ["z" * 1_000_000, "a"])
    assert len(out) == 2
