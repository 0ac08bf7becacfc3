"""Byte-level BPE encoding and decoding with the tiktoken library and a rank file.

Long texts are cut before encoding at positions where no match of the split pattern can cross, so one call never holds more
than about ``PIECE`` characters unless a single unbroken run is longer.  Decoding joins raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

#: Characters of a text that are encoded in one call.
PIECE = 1 << 16
#: The rank file is shipped to executors; a vocabulary above this size is refused rather than broadcast.
MAX_RANK_BYTES = 64 << 20

# what is no space in Python is none in the pattern either; the characters behind are spaces in both
_CUT = re.compile(r"(?<=\S)(?=[ \t\r\n])")
_ENCODERS: dict = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"rank file is larger than {MAX_RANK_BYTES} bytes")
    return data


def encoder(rank_file: bytes, pattern: str):
    """The tiktoken encoding of a rank file, built once per process."""
    key = (hashlib.sha256(rank_file).digest(), pattern)
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def pieces(text: str, size: int = PIECE):
    """Consecutive parts of ``text``, each cut between a non-space and a space.

    Every alternative of the pattern holds white space only at its start, so a match that covers the character before such
    a cut ends there, and what follows is matched as if the text began there.
    """
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc, text: str | None) -> list[int]:
    """Ids of a whole text, null as empty; strings of special tokens are ordinary text."""
    if not text:
        return []
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text):
        ids += enc.encode_ordinary(piece)
    return ids


def encode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)`` for every row; null and empty texts give an empty array, repeated rows repeat."""
    shipped = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def setup():
        enc = encoder(shipped.value, pattern)
        return lambda key, text: (key, encode_text(enc, text))

    return map_rows(df, [id_col, text_col], f"`{id_col}` {dict(df.dtypes)[id_col]}, ids array<int>", setup)


def decode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, decoded binary)``: the raw bytes of the ids, also where they are no valid UTF-8; null ids give no bytes."""
    shipped = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def setup():
        enc = encoder(shipped.value, pattern)
        return lambda key, ids: (key, enc.decode_bytes(ids or []))

    return map_rows(df, [id_col, ids_col], f"`{id_col}` {dict(df.dtypes)[id_col]}, decoded binary", setup)


def digests(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: ``(id_col, n_tokens, ids_sha256, decoded_sha256)``."""
    shipped = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def setup():
        enc = encoder(shipped.value, pattern)
        names = [str(i) for i in range(enc.n_vocab)]

        def row(key, text):
            ids = encode_text(enc, text)
            said = hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest()
            return key, len(ids), said, hashlib.sha256(enc.decode_bytes(ids)).hexdigest()

        return row

    return map_rows(df, [id_col, text_col], f"`{id_col}` {dict(df.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string", setup)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text of documents."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
