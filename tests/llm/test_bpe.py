import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemend.llm import bpe as B

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DDL = "doc_id long, text string, ids string, n_tokens int"


@pytest.fixture(scope="module")
def enc():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "<|endoftext|> it's 'll", "naïve café 世界 🙂‍", "a" * 70_000, " \n\t  x  \n" * 20_000, ("word " * 30_000), "x" * 65_536 + "  y", "1" * 10 + "\x00\x1f" + "é" * 3]


def test_query(spark, put, enc):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash", 1), (None, "no id", None, None)]
    out = B.op9_byte_bpe(spark, put(documents=(rows, DDL))).collect()
    assert len(out) == len(rows)
    for r in out:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert B.op9_byte_bpe(spark, put(documents=([], DDL))).count() == 0


def test_round_trip_operators(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    ids = B.encode(rows, PATH, PATTERN)
    back = {r.doc_id: bytes(r.decoded) for r in B.decode(ids, PATH, PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TEXTS)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\tab'sé1.　", max_size=80), st.integers(1, 9))
def test_cuts_change_nothing(enc, text, size):
    parts = list(B.pieces(text, size))
    assert "".join(parts) == text
    assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_bytes_that_are_no_text(spark):
    ids = spark.createDataFrame([(1, [0, 188]), (2, None)], "doc_id long, ids array<int>")
    assert len(B.decode(ids, PATH, PATTERN).collect()) == 2
    with pytest.raises(ValueError):
        old, B.MAX_RANK_BYTES = B.MAX_RANK_BYTES, 10
        try:
            B.read_ranks(PATH)
        finally:
            B.MAX_RANK_BYTES = old
