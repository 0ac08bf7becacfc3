from collections import Counter

from pagemend.llm import quality as Q

DDL = "doc_id long, text string, n_words string, kept string"  # extra columns with clashing names


def brute(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    hit = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def cases(prose):
    line = "one two three four five six seven eight nine"
    return [
        None, "", " \n\t ", "short text", line + "\n" + line, line + " x " + line + " y " + line, "a b " * 40, "é" * 30 + " ü ö", prose(1, 200), prose(2, 100) + "\n" + prose(2, 100),
        "WORD!! " * 40, "x### " * 30, "\n".join([prose(3, 30)] * 3), prose(4, 5000), "\x1c\x1d word\x85word " * 10, " | ".join(prose(5, 60).split()),
    ]


def test_measures_equal_brute_force(spark, put, prose):
    texts = cases(prose)
    d = put(documents=([(i, t, "a", "b") for i, t in enumerate(texts)] + [(0, None, "a", "b")], DDL))
    out = Q.op1_quality(spark, d).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in out}
    assert kept[8] and kept[13] and not kept[10] and not kept[11] and not kept[15]


def test_order_is_by_rejection_per_cost_and_keeps_the_verdict(prose):
    texts = cases(prose)
    ticks = iter(range(10**6))
    order = Q.plan_cascade([Q.trials(t, clock=lambda: next(ticks)) for t in texts])  # every rule costs the same
    rejected = [sum(r.rejects(Q.Measured(t)) for t in texts) for r in order]
    assert rejected[0] == max(rejected)
    assert {r.name for r in order} == {r.name for r in Q.RULES}
    for t in texts:
        assert (Q.first_rejection(Q.Measured(t), order) is None) == (Q.first_rejection(Q.Measured(t), Q.RULES) is None)
    assert Q.plan_cascade([]) == list(Q.RULES)


def test_cascade_names_the_rule_and_takes_an_empty_table(spark, prose):
    rows = spark.createDataFrame([(1, prose(1, 100)), (2, "few")], "doc_id long, text string")
    out = {r.doc_id: r.rejected_by for r in Q.quality_cascade(rows).collect()}
    assert out == {1: None, 2: "few_words"}
    assert Q.quality_cascade(rows.limit(0)).count() == 0
