from pagemend.llm import licenses as L

# notices broken over lines, alone and among other lines
WRAPPED = (
    "This work is licensed under the GNU General Public\nLicense, version 3.",
    "Some words\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation.\nmore words",
    "Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the\nfollowing conditions are met.\n\nnext",
    "Released under the\n\nMIT License.",
)
ODD = ("CC BY-SA 4.0", "Lizenziert unter CC BY-SA 4.0", "CC BY-NC 4.0", "CC0 1.0 Universal", "This Source Code Form is subject to the terms of the Mozilla Public Licence, v. 2.0.")

DDL = "doc_id long, text string, family string, paragraph int"


def confirmed(paragraph, fitted):
    best = fitted.best(paragraph)
    if best:
        words = L.tokens(paragraph)
        have = {" ".join(p) for p in zip(words, words[1:], strict=False)}
        for notice in L.TEMPLATES[best[0]]:
            w = L.tokens(notice)
            pairs = {" ".join(p) for p in zip(w, w[1:], strict=False)}
            if 100 * len(pairs & have) >= L.CONFIRM_PERCENT * len(pairs):
                return best
    return None


def brute(text, fitted):
    """Innermost confirmed paragraphs, without Spark and without gate words."""
    lines = (text or "").split("\n")
    found = []
    for wide in range(1, L.WRAP + 1):
        for at in range(len(lines) - wide + 1):
            part = lines[at : at + wide]
            if (wide == 1 or all(x.strip(" \t\n\v\f\r") for x in part)) and (best := confirmed("\n".join(part), fitted)):
                found.append((at, at + wide, *best))
    return [(f, over) for a, b, f, over in found if not any(f == g and a <= x and y <= b and (x, y) != (a, b) for x, y, g, _ in found)]


def test_scan_equals_brute_force(spark, prose):
    texts = [None, "", "\n \n", *[n for v in L.TEMPLATES.values() for n in v], *L.OTHERS, prose(1, 60) + "\nReleased under the MIT License.\n" + prose(2, 50), "Licensed under CC BY 4.0.\nReleased under the ISC License.", "released under the mit license", "Licensed under a license that nobody knows.", *WRAPPED, *ODD]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(2, texts[2], "x", 1), (None, "Released under the MIT License.", "x", 1)]
    out = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, DDL)).collect()}
    assert len(out) == len(texts) + 1  # repeated rows are one
    for i, t in enumerate(texts):
        want = brute(t, L.model())
        assert out[i].n_licenses == len(want), t
        assert out[i].families == ",".join(sorted({f for f, _ in want}))
        assert out[i].license == (min(want, key=lambda b: (-b[1], b[0]))[0] if want else "unknown")
    assert out[None].license == "mit"


def test_every_template_is_found_and_others_are_unknown():
    fitted = L.model()
    for family, notices in L.TEMPLATES.items():
        for notice in notices:
            assert fitted.best(notice)[0] == family
    assert all(fitted.best(x) is None for x in L.OTHERS)
    assert all(fitted.probability(family, L.features(L.tokens(n))) >= L.UNKNOWN for family, v in L.TEMPLATES.items() for n in v)


def test_broken_and_foreign_notices():
    fitted = L.model()
    families = lambda text: [f for f, _ in brute(text, fitted)]
    assert [families(t) for t in WRAPPED] == [["gpl"], ["gpl"], ["bsd"], []]
    assert [families(t) for t in ODD] == [["cc-by-sa"], ["cc-by-sa"], ["cc-by-nc"], ["cc0"], ["mpl"]]


def test_ordinary_words_speak_against_a_licence():
    fitted = L.model()
    assert all(any(fitted.weights[f].get(w, 0) < 0 for w in L.FILLER) for f in fitted.weights)


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_notice_is_lost_before_the_classifier(spark, put, prose):
    import duckdb

    fitted = L.model()
    cut = [" ".join(n.split()[i : len(n.split()) - j]) for v in L.TEMPLATES.values() for n in v for i in range(4) for j in range(4)]  # in part, as far as 60% confirm
    texts = ["All rights reserved.", prose(3, 40) + "\nAll rights reserved.\n" + prose(4, 9), "(c) 2001 ACME, ALL RIGHTS RESERVED", *cut, *WRAPPED, *ODD]
    d = put(documents=([(i, t, "x", 1) for i, t in enumerate(texts)], DDL))
    out = {r.doc_id: tuple(r) for r in L.op2_licenses(spark, d).collect()}
    for i, t in enumerate(texts):
        want = brute(t, fitted)
        assert out[i][2:4] == (len(want), ",".join(sorted({f for f, _ in want}))), t
    assert [out[i][4] for i in range(3)] == ["proprietary"] * 3
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    assert sorted(con.execute(L.op2_sql()).fetchall()) == sorted(out.values())


def test_pairs_without_a_gate_word_confirm_no_template():
    gate = L.gate_words()
    for notice in (n for v in L.TEMPLATES.values() for n in v):
        words = L.tokens(notice)
        pairs = set(zip(words, words[1:], strict=False))
        free = [p for p in pairs if not any(g in w if len(g) >= L.LONG else g == w for g in gate for w in p)]
        assert 100 * len(free) < L.CONFIRM_PERCENT * len(pairs), notice
