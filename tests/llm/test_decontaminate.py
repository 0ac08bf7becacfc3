import hashlib
import re

from pagemend.llm import decontaminate as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DDL = "doc_id long, text string, n_words int, item_id string, mark string"


def words(t):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(10, len(v))
        spans = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in spans:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def check(spark, docs, items, **more):
    out = D.contamination(spark.createDataFrame(docs, DDL), spark.createDataFrame(items, "item_id long, text string"), **more).collect()
    assert len(out) == len({(d[0], d[1]) for d in docs})
    texts = {}
    for d in docs:
        texts.setdefault(d[0], d[1])
    for r in out:
        n, hit, found = brute(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, list(r["items"])) == (n, hit, found), r.doc_id


def fixture(prose):
    items = [(i, prose(100 + i, 12 + i)) for i in range(8)] + [(20, "Über den Wolken IST ES schön"), (21, "lone"), (22, ""), (23, None), (24, prose(100, 12)), (3, prose(999, 15))]
    texts = [
        None, "", prose(1, 300), prose(2, 40) + " " + items[2][1] + " " + prose(3, 40), items[0][1], items[5][1].upper() + "!!", " ".join(words(items[4][1])[:10]), " ".join(words(items[4][1])[:9]),
        items[1][1] + "\n" + items[1][1] + " " + items[6][1], "so über den wolken ist es schön, sagte", "alone", "a lone wolf, lone", "x" * 100_000, "Über", " ".join(["lone"] * 500), prose(7, 20_000) + " " + items[7][1],
    ]
    return [(i, t, 1, "x", "y") for i, t in enumerate(texts)] + [(3, texts[3], 1, "x", "y"), (None, items[0][1], 1, "x", "y")], items


def test_equals_brute_force(spark, prose):
    docs, items = fixture(prose)
    check(spark, docs, items)


def test_shuffled_joins_give_the_same(spark, prose):
    docs, items = fixture(prose)
    check(spark, docs, items, broadcast_bytes=0)


def test_empty_tables(spark, prose):
    docs, items = fixture(prose)
    check(spark, docs, [(1, None)])
    empty = spark.createDataFrame([], DDL)
    assert D.contamination(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_digest_and_cleaning(spark, put, prose):
    docs, items = fixture(prose)
    d = put(documents=(docs, DDL), benchmark=(items, "item_id long, text string"))
    out = {r.doc_id: r for r in D.op4_decontamination(spark, d).collect()}
    assert out[2].items_sha256 == hashlib.sha256(b"").hexdigest() and not out[2].contaminated
    assert out[8].items_sha256 == hashlib.sha256(b"1,6").hexdigest() and out[8].n_items == 2
    kept = D.clean(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"))
    want = sorted(str(x[0]) for x in docs if not brute(x[1], items)[1])
    assert sorted(str(r.doc_id) for r in kept.collect()) == want and kept.columns == [c.split()[0] for c in DDL.split(", ")]


def test_winnowing_selects_the_least_hash_of_every_window(spark, prose):
    w = words(prose(5, 60))
    row = spark.createDataFrame([(w,)], "w array<string>").select(D.winnow(D.F.col("w")).alias("m"), D.grams(D.F.col("w"), 5).alias("g")).first()
    assert list(row.m) == [min(row.g[i : i + 6]) for i in range(len(w) - 9)]


def test_items_without_an_id_are_hits(spark, prose):
    text = prose(100, 12)
    docs = spark.createDataFrame([(1, text + " more"), (2, prose(5, 30))], "doc_id long, text string")
    out = {r.doc_id: (r.n_hit, list(r["items"])) for r in D.contamination(docs, spark.createDataFrame([(None, text)], "item_id long, text string")).collect()}
    assert out == {1: (12, []), 2: (0, [])}


def test_an_id_named_null_is_not_a_null_id(spark, prose):
    text = prose(100, 12)
    docs = spark.createDataFrame([("null", text), (None, text), ("null", "clean"), (None, None), ("=", "")], "doc_id string, text string")
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert sorted((str(r.doc_id), r.doc_id is None, r.n_hit) for r in D.contamination(docs, items).collect()) == [("=", False, 0), ("None", True, 0), ("None", True, 12), ("null", False, 0), ("null", False, 12)]
    assert sorted((str(r.doc_id), str(r.text)) for r in D.clean(docs, items).collect()) == [("=", ""), ("None", "None"), ("null", "clean")]
