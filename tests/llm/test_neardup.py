import random
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemend.llm import neardup as N
from pagemend.llm.common import fold_words

DDL = "doc_id long, text string, class_id string, same string, sigs int"


def edited(text, seed, changes):
    r = random.Random(seed)
    w = text.split()
    for _ in range(changes):
        at = r.randrange(len(w))
        w[at : at + r.randint(0, 1)] = [f"new{r.randrange(9999)}"]
    return " ".join(w)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def alike(a, b):
    x, y = fold_words(a), fold_words(b)
    return bool(x and y) and 2 * lcs(x, y) >= 0.8 * (len(x) + len(y))


def test_classes_equal_brute_force(spark, prose):
    texts = [prose(i, 60 + i) for i in range(40)]
    texts += [edited(texts[k], 7 * k + c, 2) for k in range(10) for c in range(6)]  # families of near copies
    texts += [texts[3], texts[3], texts[50]]  # copies
    texts += [texts[20] + " " + " ".join(texts[21].split()[:6])]  # a longer one
    common = prose(500, 25)
    texts += [common + " " + prose(600 + i, 60) for i in range(12)]  # a passage that many share is no likeness
    texts += ["one two", "one two", "One, TWO!", "", "", "!!", None, None]
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(texts)] + [(0, texts[0], "x", "y", 1)]
    out = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, DDL), at_once=3).collect()}
    assert len(out) == len(texts)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if texts[i] is not None and texts[j] is not None and (texts[i] == texts[j] or alike(texts[i], texts[j])):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    assert out == {i: root(i) for i in range(len(texts))}


def chained(prose):
    """Four texts of which only neighbours are alike."""
    words = prose(70, 100).split()
    fresh = lambda lo, n: [f"z{lo + i}" for i in range(n)]
    return [" ".join(fresh(0, 12 * i) + words[12 * i :]) for i in range(4)]


def test_members_linked_only_in_the_middle_of_a_bucket_come_together(spark, prose):
    texts = chained(prose)
    assert [alike(a, b) for a, b in combinations(texts, 2)] == [True, False, False, True, False, True]
    sketched, N.sketches_of = N.sketches_of, lambda docs, *more: docs.selectExpr("sha2(cast(text as binary), 256) as same", "100 as n_words", "octet_length(text) as size", "array(7L, 8L) as sigs")  # one bucket
    try:
        for at_once in (2, 32):
            rows = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
            assert {r.class_id for r in N.near_duplicates(rows, sketches=2, at_once=at_once, block=2).collect()} == {1}, at_once
    finally:
        N.sketches_of = sketched


def test_pairs_of_a_large_bucket_are_found_as_in_a_small_one(prose):
    texts = [prose(800 + i, 100, 100_000) for i in range(150)]
    texts += [" ".join([*t.split()[:40], *(f"new{i}x{j}" for j in range(19)), *t.split()[59:]]) for i, t in enumerate(texts)]  # one replaced block each
    assert all(alike(texts[i], texts[150 + i]) for i in range(150))
    ids = list(range(300))
    want = [(i, 150 + i) for i in range(150)]
    assert N.links_of_blocks(ids, ids, [0] * 300, [[1]] * 300, texts, 0, 0.8) == want
    assert N.links_of_blocks(ids, ids, [0] * 150 + [1] * 150, [[1]] * 300, texts, 0, 0.8) == want


def test_query_and_one_of_each(spark, put, prose):
    base = prose(1, 200)
    rows = [(5, base, "x", "y", 1), (9, edited(base, 1, 3), "x", "y", 1), (7, base, "x", "y", 1), (2, prose(2, 100), "x", "y", 1), (5, base, "x", "y", 1), (3, None, None, None, None), (None, "no id", "x", "y", 1)]
    d = put(documents=(rows, DDL))
    assert sorted(((r.doc_id, r.class_id) for r in N.op10_near_dedup(spark, d).collect()), key=lambda r: (r[0] is None, r[0])) == [(2, 2), (3, 3), (5, 5), (7, 5), (9, 5)] + [(None, None)]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = N.keep_one(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "5", "None"] and kept.columns == docs.columns
    d = put(documents=([], DDL))
    assert N.op10_near_dedup(spark, d).count() == 0


def replaced(text, seed, share):
    """Words replaced all over a text."""
    r = random.Random(seed)
    w = text.split()
    for at in r.sample(range(len(w)), round(share * len(w))):
        w[at] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_recall_of_scattered_changes(prose):
    """Of pairs whose alignment reaches the threshold, nearly all share a sample, however short the texts and scattered the changes."""
    for words in (12, 60, 300):
        for percent in (2, 5, 8, 10, 12, 15, 18, 20):
            pairs = [(t, replaced(t, 31 * i + percent, percent / 100)) for i in range(60) for t in [prose(5000 + i, words)]]
            pairs = [p for p in pairs if alike(*p)]
            met = sum(bool(set(N.sketch(a)) & set(N.sketch(b))) for a, b in pairs)
            assert len(pairs) >= 55 and met >= 0.9 * len(pairs), (words, percent, met, len(pairs))


def test_recall_from_end_to_end(spark, prose):
    shares = (0.05, 0.1, 0.12, 0.15, 0.18)
    rows = [(2 * i + j, t) for i in range(50) for base in [prose(7000 + i, 300)] for j, t in enumerate((base, replaced(base, i, shares[i % 5])))]
    near = {i for i in range(50) if alike(rows[2 * i][1], rows[2 * i + 1][1])}
    out = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) >= 45 and sum(out[2 * i] == out[2 * i + 1] for i in near) >= 0.95 * len(near)


def test_one_id_with_two_texts_and_ids_of_other_types(spark, prose):
    a, z = prose(1, 80), prose(2, 80)
    rows = [("1", a), ("1", z), ("2", edited(z, 3, 2)), (None, edited(a, 4, 2)), (None, prose(5, 80)), (None, prose(5, 80)), ("3", ""), ("4", ""), ("5", None), ("5", None)]
    docs = spark.createDataFrame(rows, "name string, body string").withColumns({"same": F.lit(1), "sigs": F.lit("x"), "node": F.lit(2)})
    out = [(r.name, r.same, r.class_id, r.class_same) for r in N.near_duplicates(docs, "name", "body").collect()]
    assert len(out) == 8 and len({x[2:] for x in out}) == 5
    kept = N.keep_one(docs, id_col="name", text_col="body")
    assert kept.columns == docs.columns
    assert sorted((r.name or "null", r.body or str(r.body)) for r in kept.collect()) == sorted([("1", a), ("1", z), ("null", rows[4][1]), ("3", ""), ("5", "None")])


def test_seeds_go_on(prose):
    assert len(set(N.sketch(prose(1, 300), sketches=20_000))) == 20_000


def test_long_texts_and_a_large_group(spark, prose):
    base = prose(3, 20_000)
    rows = [(0, base), (1, edited(base, 5, 200)), (2, prose(4, 20_000))] + [(10 + i, edited(prose(9, 80), i, 2)) for i in range(150)]
    out = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == 0 and out[2] == 2
    assert {out[10 + i] for i in range(150)} == {10}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40), st.integers(0, 45))
def test_banded_alignment(a, b, band):
    whole = lcs(a, b)
    assert N.common_length(a, b, 50) == whole
    assert N.common_length(a, b, band) <= whole
    total = len(a) + len(b)
    sim = 2 * whole >= 0.8 * total
    assert N.similar(" ".join(map(str, a)), " ".join(map(str, b))) == sim


def test_hashes_depend_on_words_alone():
    a, b = N.word_hashes("One two, three  two"), N.word_hashes("xx two ONE three")
    assert a[1] == a[3] == b[1] and a[0] == b[2] and a[2] == b[3] and len({*a.tolist(), *b.tolist()}) == 4
    assert len(N.word_hashes(None)) == len(N.word_hashes(" ,.")) == 0
    kmers = N.kmer_hashes(N.word_hashes("a b c d e a b c d e a b c d e"))
    assert len(set(N.labelled(kmers).tolist())) == len(kmers) > len(set(kmers.tolist()))


def test_order_matters_to_the_sample():
    words = [f"w{i}" for i in range(200)]
    blocks = [words[i : i + 10] for i in range(0, 200, 10)]
    moved = [w for block in reversed(blocks) for w in block]
    plain, turned, near = (np.array(N.sketch(" ".join(x))) for x in (words, moved, words[:100] + ["new"] + words[101:]))
    assert (plain == near).sum() > (plain == turned).sum()
    assert SequenceMatcher(None, words, moved).ratio() < 0.8
