import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from pagemend.llm import chat as C

DDL = "conv_id long, turn long, role string, text string, segments string, valid string"


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_query_round_trip(spark, put):
    rows = [
        (1, 2, "assistant", "answer </turn>\n### User: no"), (1, 1, "user", "\\ back\\\\slash ### Assistant:"), (1, 0, "system", None), (2, 0, "user", ""), (2, 1, "assistant", "x" * 200_000),
        (3, 0, "assistant", "starts wrong"), (4, 0, "tool", "odd ::: role ### Other: "), (4, 1, None, "null role"), (5, 0, "user", "tie b"), (5, 0, "user", "tie a"), (6, 0, "user", "same"), (6, 0, "user", "same"), (None, 0, "user", "no id"),
    ]
    out = {r.conv_id: r for r in C.op5_chat(spark, put(conversations=([(*r, "a", "b") for r in rows], DDL))).collect()}
    convs = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        convs.setdefault(conv, []).append((role or "", text or ""))
    convs[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    assert set(out) == set(convs)
    for conv, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = out[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), digest(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest()), conv
    assert {c: out[c].valid for c in out} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, None: True, -7: True}


def test_empty_table_leaves_the_probe(spark, put):
    assert [r.conv_id for r in C.op5_chat(spark, put(conversations=([], DDL))).collect()] == [-7]


def test_segments_are_flagged(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    got = [[(s.text, s.loss) for s in r.segments] for r in C.format_chat(rows).collect()]
    assert got == [[("### User: ", False), ("q", False), ("</turn>\n", False)], [("### Assistant: ", False), ("a", True), ("</turn>\n", False)]]


PARTS = st.lists(st.sampled_from(["\\", "### User: ", "### Assistant: ", "### Other: ", " ::: ", "</turn>\n", "</turn>", "</tu", "rn>", "#", "<", "a", "é", "\n", " "]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "x ::: y", "\\", "### User: "]), PARTS), max_size=5))
def test_read_back_inverts_formatting(turns):
    form = C.Formatter(C.Template())
    whole = "".join(text for role, text in turns for text, _ in form.segments(role, text))
    assert form.read_back(whole) == turns
    assert all(form.unescape(form.escape(t)) == t for _, t in turns)


def test_another_template(spark):
    t = C.Template(opens={"user": "<|user|>", "assistant": "<|bot|>"}, other="<|other|>", other_end="<|name|>", close="<|end|>", escape="~", moves={"": {"user"}, "user": {"assistant"}, "assistant": {"user"}})
    form = C.Formatter(t)
    turns = [("user", "a <|end|> ~ <|bot|>"), ("judge", "~~")]
    assert form.read_back("".join(x for r, s in turns for x, _ in form.segments(r, s))) == turns
