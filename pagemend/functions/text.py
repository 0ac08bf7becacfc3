"""Text measures as Column expressions.  Those without a lambda run inside whole-stage codegen; lambdas are interpreted, so what they
use more than once is bound by ``let`` or ``pinned``.

Character classes are spelled out because Java's ``\\w`` and ``\\s`` are not the classes the semantics need.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The character classes of recognised words, of glyphs that are no garbage, and of token edges.
LETTERS = r"\p{L}\p{N}_À-ỹĐđ"
WORD = f"[{LETTERS}]+"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
GARBAGE = rf"[^{LETTERS}{SPACE}.,;:!?…'\"“”‘’()\-–—/+%&]"
TOKEN_EDGES = ".,;:!?…'\"“”‘’()[]{}<>+-–—/*"
PAGE_NUMBER = rf"^[{SPACE}\-—–_]*[Il|1O0-9]{{1,5}}[{SPACE}\-—–_.]*$"
LEXICAL = "[0-9A-Za-zÀ-ỹĐđ]+"


@functools.lru_cache(maxsize=None)
def accent_table(fold_d: bool = True) -> tuple[str, str]:
    """(from, to) for ``translate``: every character whose canonical decomposition is one base character and marks, in any script.

    Built from the Unicode data of the running Python, not listed.  ``fold_d`` adds the barred d, which has no decomposition.
    """
    source, target = [], []
    for code in range(0x80, sys.maxunicode + 1):
        if unicodedata.decomposition(chr(code))[:1] not in ("", "<"):
            base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
            if len(base) == 1 and base != chr(code):
                source.append(chr(code))
                target.append(base)
    if fold_d:
        source += ["đ", "Đ"]
        target += ["d", "D"]
    return "".join(source), "".join(target)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that later expressions read instead of computing it again (a one-row generator keeps it apart)."""
    return df.withColumn(name, F.explode(F.array(value)))


def strip_accents(text: Column, fold_d: bool = True) -> Column:
    """Text without diacritics, composed where letters of several base characters are (Hangul).  ASCII text is left as it is."""
    source, target = accent_table(fold_d)
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(F.regexp_replace(F.translate(text, source, target), r"\p{Mn}", ""))


def fold(text: Column) -> Column:
    """Case folding: lower case with sharp s spelled out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def strip(text: Column) -> Column:
    """Text without white space (any, not only blanks) at either end."""
    return F.btrim(text, F.lit(SPACES))


def tokens(text: Column) -> Column:
    """Parts between runs of white space; none for empty text."""
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda t: t != "")


def squeezed(text: Column) -> Column:
    """The tokens of a text with one blank between."""
    return F.btrim(F.regexp_replace(text, f"[{SPACE}]+", " "), F.lit(" "))


def token_core(token: Column) -> Column:
    """A token without punctuation at its edges, case-folded."""
    return fold(F.btrim(token, F.lit(TOKEN_EDGES)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def shape(text: Column) -> Column:
    """What is left of a text without blanks, punctuation, case and diacritics."""
    return F.array_join(F.regexp_extract_all(fold(strip_accents(text)), F.lit(WORD), F.lit(0)), "")


def lexical(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(fold(text), F.lit(LEXICAL), F.lit(0)), " ")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def visible(text: Column) -> Column:
    """Characters that are no white space.  Runs of the others are taken out: counting matches would make one for each character."""
    return F.length(F.regexp_replace(text, f"[{SPACE}]+", ""))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))


def garbage(text: Column) -> Column:
    return count_of(text, GARBAGE)


@functools.lru_cache(maxsize=None)
def newer() -> str:
    """Ranges of the characters that came after Unicode 3.2, no controls: an older Java takes some of them for unassigned, and so for controls."""
    old, out = unicodedata.ucd_3_2_0, []
    for code in range(0x80, sys.maxunicode + 1):
        if old.category(chr(code)) == "Cn" and unicodedata.category(chr(code))[0] != "C":
            if out and out[-1][1] == code - 1:
                out[-1][1] = code
            else:
                out.append([code, code])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)


def garbage_score(text: Column) -> Column:
    """Penalty for symbol soup: odd glyphs, overlong runs, control characters; 100 for an empty text."""
    control = count_of(text, rf"[\p{{C}}&&[^\n\t{newer()}]]")
    return F.when(F.length(text) == 0, F.lit(100.0)).otherwise(garbage(text) * 2.0 + count_of(text, f"[^{SPACE}]{{24,}}") * 6.0 + control * 10.0)


def garbage_ratio(text: Column) -> Column:
    return garbage(text) / F.greatest(F.lit(1), visible(text))


def diacritic_only(old: Column, new: Column) -> Column:
    return (old != new) & (fold(strip_accents(old)) == fold(strip_accents(new)))


def header_key(text: Column) -> Column:
    """Key under which repeated page headers meet: folded, without diacritics (the barred d stays) and punctuation."""
    plain = strip_accents(fold(text), fold_d=False)
    return squeezed(F.regexp_replace(plain, rf"[^a-z0-9đ{SPACE}]", " "))


def spelled_once(text: Column, part: Column) -> Column:
    """Whether ``part`` occurs exactly once as a substring (non-overlapping count)."""
    return (F.length(part) > 0) & ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) == F.length(part))


def replace_once(text: Column, old: Column, new: Column) -> Column:
    """Splice instead of a pattern, so no character of ``new`` is special."""
    at = F.instr(text, old)
    return F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))


def quoted(token: Column) -> Column:
    """A regular expression for the literal token."""
    return F.concat(F.lit("\\Q"), F.replace(token, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def bounded(token: Column) -> Column:
    """Pattern of the token not inside another word."""
    return F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted(token), F.lit(r"(?![\p{L}\p{N}_])"))


def escape_xml(text: Column) -> Column:
    for raw, named in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(named))
    return text


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_")


def confidence(value: Column) -> Column:
    """A recognition confidence; what is no number is -1."""
    return F.coalesce(value.try_cast("double"), F.lit(-1.0))


def blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE}]")


def split_lines(text: Column) -> Column:
    """Lines at every Unicode line boundary; an empty last line is none."""
    parts = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
