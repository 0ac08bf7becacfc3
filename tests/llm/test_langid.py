import random
import zlib

import numpy as np
import pytest

from pagemend.llm import langid as L

DDL = "doc_id long, text string, lang string, source string, score string"
SYLLABLES = {"aa": "ka ki ko ra ri ro".split(), "bb": "schu ber gen lich keit ung".split(), "cc": "ción oso ado mente rra ñe".split()}


def text(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def table(n=240):
    return [(i, text(lang, i), lang, "s", "x") for i in range(n) for lang in [sorted(SYLLABLES)[i % 3]]]


def test_learns_only_from_allowed_rows_and_predicts_held_out(spark, put):
    rows = table()
    # a held-out row with a wrong label must not be learned; its language exists nowhere else
    odd = next(i for i in range(10**6, 10**6 + 50) if zlib.crc32(str(i).encode()) % 3 == 1)
    rows += [(odd, text("aa", 1), "zz", "s", "x"), (-1, None, "aa", "s", "x"), (-2, "", "aa", "s", "x"), (-3, "123 !?", None, "s", "x"), (-4, text("bb", 9, 9000), None, "s", "x"), (-5, "世界" * 200, None, "s", "x"), (-1, None, "aa", "s", "x")]
    out = L.op3_language(spark, put(documents=(rows, DDL))).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, _, lang, _, _ in rows:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= by[i].score <= 1
    assert all(by[i].lang_pred == lang and not by[i].rejected for i, _, lang, _, _ in table())
    assert by[odd].lang_pred == "aa" and "zz" not in {r.lang_pred for r in out}
    assert [by[i].lang_pred for i in (-1, -2, -3, -4)] == ["und", "und", "und", "bb"]
    assert by[-1].rejected and by[-3].rejected and by[-5].rejected and by[-5].lang_pred in SYLLABLES


def test_nothing_to_learn(spark):
    rows = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score, r.rejected) for r in L.identify(rows, L.learn(rows)).collect()] == [("und", 0.0, True)]
    assert L.identify(rows.limit(0), L.learn(rows.limit(0))).count() == 0


def test_blocks_do_not_change_counts(monkeypatch):
    whole = text("bb", 3, 500) + " 1 2 3 " + text("cc", 3, 500)
    one, n = L.gram_counts(whole)
    monkeypatch.setattr(L, "BLOCK", 97)
    many, m = L.gram_counts(whole)
    assert n == m and abs(one - many).sum() == 0


def test_sample_is_bounded(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"text of row {i}", "aa") for i in range(3000)], "doc_id long, text string, lang string")
    seen, real = [], L.fit
    monkeypatch.setattr(L, "fit", lambda samples: seen.append(len(samples)) or real(samples[:5]))
    L.learn(rows, fit_rows=50)
    assert 20 <= seen[0] <= 100


def test_more_languages_than_the_bound_are_refused(spark):
    rows = spark.createDataFrame([(i, "some words", f"l{i}") for i in range(4)], "doc_id long, text string, lang string")
    assert len(L.learn(rows, languages=4).languages) == 4
    with pytest.raises(ValueError):
        L.learn(rows, languages=3)


def test_nearest_centroid_equals_brute_force():
    model = L.fit([(lang, np.flatnonzero(c), c[np.flatnonzero(c)].astype(np.float32)) for _, t, lang, _, _ in table(60) for c in [L.gram_counts(t)[0]]])
    for _, t, _, _, _ in table(30):
        v = L.weigh(L.gram_counts(t)[0], model.idf).tolist()
        near = [sum(a * b for a, b in zip(v, c, strict=True)) for c in model.centroids.tolist()]
        lang, score = model.nearest(L.gram_counts(t)[0])
        assert abs(score - max(near)) < 1e-5 and lang == model.owner[near.index(max(near))]
