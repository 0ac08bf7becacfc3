"""Quality rules as a short-circuit cascade.

Each rule's cost (seconds) and selectivity (share rejected) are estimated on a bounded sample; rules then run in the order of
rejection per cost, and a document stops at the first rule that rejects it.  The order never changes the verdict, which is
the conjunction of all rules.

Nulls and empty texts have zero words and fail ``few_words``.  Repeated rows are judged alike.  A text is measured whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

#: Words of a repeated window.
WINDOW = 8
#: Rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 512

_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in _SYMBOLS)
_SPACES = b" \t\n\x0b\x0c\r"
_TAILS = bytes(range(0x80, 0xC0))
_MIX = np.random.default_rng(8).integers(1 << 62, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)


class Measured:
    """Measures of one text, each computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # splits at exactly \\x20 and \\x09-\\x0D

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, _SPACES + _TAILS))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw.translate(None, _NOT_SYMBOLS))

    @cached_property
    def n_bangs(self) -> int:
        return self.raw.count(b"!")

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_stutters(self) -> int:
        return sum(a == b for a, b in zip(self.words, self.words[1:], strict=False))

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw.translate(None, _NOT_UPPER))

    @cached_property
    def n_letters(self) -> int:
        return len(self.raw.translate(None, _NOT_LETTER))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)


_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more, first occurrences included."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, n)
    if len(ids) == n:
        return 0
    windows = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        windows += (code[k : n - width + 1 + k] + np.uint64(1)) * _MIX[k % len(_MIX)]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


@dataclass(frozen=True)
class Rule:
    """``rejects`` says whether a measured text fails; ``base`` marks rules of the fixed base verdict."""

    name: str
    rejects: Callable[[Measured], bool]
    base: bool = False


RULES = (
    Rule("few_words", lambda m: m.n_words < 20, base=True),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 30 * m.n_words, base=True),
    Rule("symbols", lambda m: 100 * m.n_symbols > 10 * m.n_words),
    Rule("shouting", lambda m: 100 * m.n_bangs > 10 * m.n_words),
    Rule("capitals", lambda m: 100 * m.n_upper > 40 * m.n_letters),
    Rule("repeated_lines", lambda m: 100 * m.n_dup_lines > 50 * len(m.lines)),
    Rule("stutters", lambda m: 100 * m.n_stutters > 30 * m.n_words),
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 20 * m.n_words),
)


def trials(text: str | None, rules=RULES, clock=time.perf_counter) -> list[tuple[float, bool]]:
    """Each rule's seconds and verdict on a text, measured alone."""
    out = []
    for rule in rules:
        began = clock()
        hit = rule.rejects(Measured(text))
        out.append((max(clock() - began, 1e-9), hit))
    return out


def plan_cascade(sample: list[list[tuple[float, bool]]], rules=RULES) -> list[Rule]:
    """Greedy order: next is the rule with the most rejections per second among the sample rows still alive.

    Ties keep the given order; without any sample the given order stands.
    """
    left, alive, order = list(range(len(rules))), sample, []
    while left:
        rate = lambda r: sum(row[r][1] for row in alive) / max(sum(row[r][0] for row in alive), 1e-9)  # noqa: B023, E731
        best = max(left, key=lambda r: (rate(r), -r))
        order.append(rules[best])
        left.remove(best)
        alive = [row for row in alive if not row[best][1]]
    return order


def estimate(df: DataFrame, rules=RULES, text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[list[tuple[float, bool]]]:
    """Trials on at most ``rows`` texts, made where the texts are: only numbers reach the driver, and they only steer the order."""
    sample = df.select(F.col(text_col).alias("text")).sample(0.2, seed=7)
    tried = map_rows(sample, ["text"], "seconds array<double>, hits array<boolean>", lambda: lambda text: tuple(map(list, zip(*trials(text, rules), strict=True))))
    return [list(zip(r[0], r[1], strict=True)) for r in tried.limit(rows).collect()]  # as few partitions as give them


def first_rejection(measured: Measured, rules) -> str | None:
    return next((rule.name for rule in rules if rule.rejects(measured)), None)


def quality_cascade(df: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(id_col, kept, rejected_by)``; ``rejected_by`` is the rule that stopped the document, null if kept."""
    order = plan_cascade(estimate(df, rules, text_col, sample_rows), rules)

    def setup():
        def row(key, text):
            said = first_rejection(Measured(text), order)
            return key, said is None, said

        return row

    return map_rows(df, [id_col, text_col], f"`{id_col}` {dict(df.dtypes)[id_col]}, kept boolean, rejected_by string", setup)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, base verdict and the cascade's verdict for every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    order = plan_cascade(estimate(docs))

    def setup():
        base = [rule for rule in order if rule.base]

        def row(key, text):
            m = Measured(text)
            kept = first_rejection(m, order) is None
            failed = not kept and first_rejection(m, base) is not None
            return key, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, kept

        return row

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean", setup)


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w
), g AS (
  SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win FROM p
), c AS (
  SELECT doc_id, pos, len(win) = 8 AND count(*) OVER (PARTITION BY doc_id, win) > 1 AS twice FROM g
), r AS (
  SELECT doc_id, pos, max(twice::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM c
), n AS (SELECT doc_id, sum(hit)::BIGINT AS n_repeat_words FROM r GROUP BY doc_id
), l AS (
  SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS stutters,
    len(regexp_extract_all(coalesce(text, ''), '!')) AS bangs, len(regexp_extract_all(coalesce(text, ''), '[A-Z]')) AS upper_n,
    len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) AS letters
  FROM w JOIN l USING (doc_id) LEFT JOIN n USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * bangs > 10 * n_words
    OR 100 * upper_n > 40 * letters OR 100 * n_dup_lines > 50 * n_lines OR 100 * stutters > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM m
"""
