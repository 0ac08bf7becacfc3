"""What SQL cannot state, against comparing each with each by the standard library."""

import random
from difflib import SequenceMatcher
from itertools import combinations
from statistics import median

from hypothesis import given, settings
from hypothesis import strategies as st

from pagemend import adapters as A
from pagemend import queries
from pagemend.functions import similarity as S


def brute(line, rows, at_least):
    scores = [1.0 if S.folded(line) == S.folded(r) else SequenceMatcher(None, S.folded(line), S.folded(r)).ratio() for r in rows]
    best = max(range(len(rows)), key=lambda i: (scores[i], -i), default=None)
    return best if best is not None and scores[best] >= at_least else None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abÀàđ ", max_size=8), max_size=5), st.lists(st.text("abÀàđ ", max_size=8), max_size=6), st.sampled_from([0.0, 0.45, 0.8]))
def test_best_matches_are_those_of_each_with_each(lines, rows, at_least):
    assert S.best_matches(lines, rows, at_least) == [brute(x, rows, at_least) for x in lines]


def some(spark, sf, lines):
    """Documents of few lines, so that each with each ends soon."""
    rows = A.lines(spark, sf).groupBy("doc_id").count().where(f"count between 2 and {lines}").orderBy("doc_id").limit(25)
    return {r.doc_id for r in rows.collect()}


def test_aligned_candidates_equal_brute_force(spark, sf):
    held = some(spark, sf, 8)
    evidence, got = {}, {}
    for r in A.evidence(spark, sf).collect():
        if r.doc_id in held:
            evidence.setdefault((r.doc_id, r.source, r.pass_order), {})[r.row_no] = (r.text, r.conf)
    for r in queries.aligned_candidates(spark, sf).collect():
        got[r.line_id, r.source] = (r.pass_order, r.text, r.conf)
    seen = 0
    for line in A.held_lines(spark, sf).collect():
        for (doc, source, order), found in evidence.items():
            if doc == line.doc_id:
                rows = [found[n] for n in sorted(found)]
                at = brute(line.text, [t for t, _ in rows], 0.45)
                assert got.get((line.line_id, source)) == (None if at is None else (order, *rows[at])), line.line_id
                seen += 1
    assert seen > 200


def test_cross_pass_similarity_equals_brute_force(spark, sf):
    held = some(spark, sf, 8)
    texts = {}
    for r in A.evidence(spark, sf).orderBy("doc_id", "pass_order", "row_no").collect():
        if r.doc_id in held and r.text.strip():
            texts.setdefault(r.doc_id, {}).setdefault(r.pass_order, []).append(r.text)
    got = {r.doc_id: r.similarity for r in queries.cross_pass_similarity(spark, sf).collect()}
    for doc, readings in texts.items():
        plain = [" ".join(S.folded("\n".join(t)).split()) for _, t in sorted(readings.items())]
        ratios = [1.0 if a == b else SequenceMatcher(None, a, b).ratio() for a, b in combinations([p for p in plain if p], 2)]
        assert abs(got[doc] - (median(ratios) if ratios else 1.0)) < 1e-12


def test_refine_with_a_lexicon_equals_brute_force(spark):
    """The branch of repairs from unknown to known words."""
    from pagemend.operators import refine

    r = random.Random(4)
    words, known = "sách đọc trang chính dung nội".split(), {"sách", "đọc", "trang", "chính", "dung", "nội"}
    rows = []
    for i in range(60):
        text = [r.choice(words) for _ in range(6)]
        bad = list(text)
        at = r.randrange(6)
        bad[at] = bad[at][:-1] + "x"
        rows.append((str(i), " ".join(bad), 90.0, [("p", "whole", " ".join(text), 90.0, None, None)] * r.choice((2, 3, 4))))
    lines = spark.createDataFrame(rows, "line_id string, text string, conf double, whole_candidates array<struct<source:string,kind:string,text:string,conf:double,scale:double,psm:int>>")
    out = {x.line_id: x for x in refine.refine(lines, refine.own_votes(lines), spark.createDataFrame([(w,) for w in known], "word string")).collect()}
    for key, bad, _, candidates in rows:
        good = candidates[0][2]
        old = next(a for a, b in zip(bad.split(), good.split(), strict=True) if a != b)
        repaired = len(candidates) >= 3 and bad.count(old) == 1
        assert out[key].text == (good if repaired else bad) and [e.reason for e in out[key].edits] == (["invalid_to_valid_visual_consensus"] if repaired else [])
