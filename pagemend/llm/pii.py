"""Personal data: high-recall generators propose overlapping spans, boosted trees choose among them.

The base spans (email, ip, card, phone) follow fixed formats and always stay.  Wider generators propose further spans: written-out
emails, addresses of version 6, phones in national form, numbers shaped like cards, account and identity numbers, and secrets: values
after a sign, hexadecimal keys, tokens with a known beginning, private key blocks and passwords.  A gradient-boosted ensemble scores
each proposal by its format and its surroundings.  It is fitted on cases generated from a seed, so it needs no corpus and no labels:
one third fits the trees, one calibrates the scores (Platt), and on one a threshold for each kind is set for high precision.  Of
overlapping selections the most probable stays; none may overlap a base span.

Null and empty texts have no spans; repeated rows repeat; texts are searched whole and no span has a greatest length, but for formats
that fix one.
"""

import functools
import hashlib
import ipaddress
import math
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

# The formats of the base kinds, in the order in which kinds are listed.
KINDS = ("email", "ip", "card", "phone", "account", "identity", "secret")
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")
#: Characters on each side of a proposal that its features read.
CONTEXT = 32


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[0::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base formats: leftmost, non-overlapping within a kind; a failing match is dropped, not retried."""
    found = []
    last = 0
    if "@" in text:
        for m in EMAIL_TAIL.finditer(text):  # the local part is the run of its characters that ends at the @
            start = m.start()
            while start > last and text[start - 1] in EMAIL_CHARS:
                start -= 1
            if start < m.start():
                found.append(("email", start, m.end()))
                last = m.end()
    for m in IP.finditer(text):
        parts = [part.lstrip("0") or "0" for part in m[0].split(".")]
        if all(len(part) <= 3 and int(part) <= 255 for part in parts):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


# How tokens of public services begin.
PREFIXES = r"AKIA|ASIA|AIza|(?:sk|pk|rk)_(?:live|test)_|sk-|gh[opsur]_|github_pat_|glpat-|xox[abeoprs]-|npm_|hf_|SG\.|eyJ"
# How a password is announced in the four languages of the corpus and in settings.
PASSWORDS = r"password|passwd|passphrase|passcode|pwd|passwort|kennwort|contraseña|clave|mot de passe|pin"

_DIGITS = tuple("0123456789")
_BEGINNINGS = ("akia", "asia", "aiza", "sk_", "pk_", "rk_", "sk-", "gho_", "ghp_", "ghs_", "ghu_", "ghr_", "github_pat_", "glpat-", "xox", "npm_", "hf_", "sg.", "eyj")  # the same, as plain strings

# Wide generators: kind, what a text (in lower case) must hold for the pattern to be tried, and the pattern; group 1, where there is one, is the span.
GENERATORS = (
    ("email", ("@", "(at)", "[at]"), re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]{2,}+\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z]{2,}+\b", re.I)),
    ("ip", (":",), re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,39}+(?![0-9A-Za-z:])")),
    ("card", _DIGITS, re.compile(r"(?<![0-9])[0-9]{4}(?P<mark>[ .-]?)[0-9]{4}(?P=mark)[0-9]{4}(?P=mark)[0-9]{2,7}(?![0-9])")),
    ("phone", _DIGITS, re.compile(r"(?<![0-9.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9]|[.-][0-9])")),
    ("phone", ("0",), re.compile(r"(?<![0-9.+-])\(?0[0-9]{1,4}\)?[ /-]{1,3}[0-9]{3,8}(?:[ -][0-9]{2,5}){0,2}(?![0-9]|[.-][0-9])")),
    ("phone", ("0",), re.compile(r"(?<![0-9.+-])0[1-9](?:[ .-]?[0-9]{2}){4}(?![0-9]|[.-][0-9])")),
    ("account", _DIGITS, re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("identity", ("-",), re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("secret", (":", "="), re.compile(r"""[:=]\s{0,2}["']?([A-Za-z0-9_+/=.-]{12,}+)""")),
    ("secret", _DIGITS, re.compile(r"(?<![A-Za-z0-9])([A-Fa-f0-9]{32,}+)(?![A-Za-z0-9])")),
    ("secret", _BEGINNINGS, re.compile(rf"(?<![A-Za-z0-9_])((?:{PREFIXES})[A-Za-z0-9_.-]{{8,}}+)")),
    ("secret", tuple(PASSWORDS.split("|")), re.compile(rf"""(?<![A-Za-z])(?:{PASSWORDS})(?![A-Za-z])["']?\s{{0,2}}(?:[:=]|is|ist|es|est)\s{{0,2}}["']?([^\s"']{{4,}}+)""", re.I)),
)
_NAMED = re.compile(r"[A-Za-z_]{3,24}\s{0,2}$")
_KNOWN = re.compile(PREFIXES)
_KEY_BLOCK = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]{0,40}PRIVATE KEY-----")
_BEHIND = ".,;:)]}>"
# Words near a span that speak for (first) or against (last) personal data.
CUES = {
    "email": ("mail", "contact", "write"),
    "card": ("card", "visa", "credit", "pay", "amex", "master"),
    "ip": ("ip", "addr", "host", "server", "dns", "ping"),
    "phone": ("phone", "tel", "call", "fax", "mobil", "cell", "contact", "ruf", "llam"),
    "account": ("iban", "account", "bank", "transfer"),
    "identity": ("ssn", "social security", "tax id", "identity", "passport"),
    "secret": ("token", "secret", "key", "passw", "auth", "bearer", "credential", "api"),
}
AGAINST = ("order", "isbn", "invoice", "version", "sha", "commit", "checksum", "md5", "part", "item", "score", "ratio", "page", "serial", "model", "ref")


def propose(text: str) -> list[tuple[str, int, int]]:
    """All spans of all generators; they may overlap."""
    found, low = [], text.lower()
    for kind, needs, pattern in GENERATORS:
        if not any(x in low for x in needs):
            continue
        for m in pattern.finditer(text):
            if kind == "secret" and m[0][0] in ":=" and not _NAMED.search(text[max(0, m.start() - 28) : m.start()]):
                continue
            start, end = m.span(1) if kind == "secret" else m.span()
            while kind == "secret" and end - start > 4 and text[end - 1] in _BEHIND:
                end -= 1
            found.append((kind, start, end))
    if "PRIVATE KEY-----" in text:
        begin = None
        for m in _KEY_BLOCK.finditer(text):
            if m[1] == "BEGIN":
                begin = m.start() if begin is None else begin
            elif begin is not None:
                found.append(("secret", begin, m.end()))
                begin = None
        if begin is not None:  # a block that is cut off
            found.append(("secret", begin, len(text)))
    return list(dict.fromkeys(found))


def entropy(text: str) -> float:
    counts = [text.count(c) / len(text) for c in set(text)]
    return -sum(p * math.log2(p) for p in counts)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span = text[start:end]
    digits = digits_of(span)
    left, right = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    near = left[-28:]
    return [
        float(KINDS.index(kind)),
        float(end - start),
        float(len(digits)),
        float(len(digits) >= 12 and luhn(digits)),
        len(digits) / (end - start),
        entropy(span),
        float(len(re.findall(r"[ .()-]", span))),
        float(any(cue in near for cue in CUES.get(kind, ()))),
        float(any(cue in left + " " + right for cue in CUES.get(kind, ()))),
        float(any(cue in near for cue in AGAINST)),
        float(bool(left) and left[-1].isalnum()),
        float(bool(right) and right[0].isalnum()),
        float("@" in span or "at" in span.lower()),
        float(span.count("(") == span.count(")")),
        iban_rest(span) if kind == "account" else 0.0,
        float(any(c.isupper() for c in span)) + 2.0 * any(c.islower() for c in span),
        float(bool(re.search(r"[=:]\s*[\"']?$", left))),
        float(digits[:1] in ("0", "1") and bool(digits)),
        float(kind == "ip" and six(span)),
        float(bool(_KNOWN.match(span))) + 2.0 * span.startswith("-----BEGIN"),
        float(bool(_SAID.search(near))),
        float(sum(bool(re.search(x, span)) for x in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))),
    ]


_SAID = re.compile(rf"(?:{PASSWORDS})[\"']?\s*(?:[:=]|is|ist|es|est)\s*[\"']?$", re.I)


def six(span: str) -> bool:
    """Whether this is an address of version 6."""
    try:
        return ipaddress.ip_address(span).version == 6
    except ValueError:
        return False


def iban_rest(span: str) -> float:
    plain = re.sub(r"\s", "", span)
    number = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
    return float(int(number) % 97 == 1)


class Trees:
    """Gradient boosting with logistic loss: small regression trees on feature thresholds, then Platt calibration."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.3, leaf: int = 8):
        self.rounds, self.depth, self.rate, self.leaf = rounds, depth, rate, leaf
        self.trees, self.start, self.scale, self.shift = [], 0.0, 1.0, 0.0

    def _grow(self, x, residual, weight, depth):
        value = residual.sum() / max(weight.sum(), 1e-6)
        if depth == 0 or len(x) < 2 * self.leaf:
            return float(value)
        best = (1e-9, None, None)
        whole = residual.sum() ** 2 / max(weight.sum(), 1e-6)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            column, r, w = x[order, f], residual[order].cumsum(), weight[order].cumsum()
            places = np.flatnonzero(column[1:] > column[:-1])
            places = places[(places + 1 >= self.leaf) & (len(x) - places - 1 >= self.leaf)]
            if not len(places):
                continue
            gain = r[places] ** 2 / np.maximum(w[places], 1e-6) + (r[-1] - r[places]) ** 2 / np.maximum(w[-1] - w[places], 1e-6) - whole
            at = int(np.argmax(gain))
            if gain[at] > best[0] + 1e-12:
                best = (gain[at], f, (column[places[at]] + column[places[at] + 1]) / 2)
        if best[1] is None:
            return float(value)
        _, f, cut = best
        low = x[:, f] <= cut
        return f, float(cut), self._grow(x[low], residual[low], weight[low], depth - 1), self._grow(x[~low], residual[~low], weight[~low], depth - 1)

    @staticmethod
    def _leaf(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    def fit(self, x, y, held_x, held_y):
        self.start = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, y - p, p * (1 - p), self.depth)
            self.trees.append(tree)
            margin += self.rate * np.array([self._leaf(tree, row) for row in x])
        m = np.array([self.margin(row) for row in held_x])
        for _ in range(200):  # Platt: a logistic line through held-out margins
            p = 1 / (1 + np.exp(-(self.scale * m + self.shift)))
            self.scale -= 0.1 * float(((p - held_y) * m).mean()) / max(1.0, float((m * m).mean()))
            self.shift -= 0.1 * float((p - held_y).mean())
        return self

    def margin(self, row) -> float:
        return self.start + self.rate * sum(self._leaf(tree, row) for tree in self.trees)

    def probability(self, row) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.scale * self.margin(row) + self.shift))))


def generated_cases(n: int = 5400, seed: int = 11) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label): look-alikes and true cases in invented sentences."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "th", "on", "de", "re", "la", "ti", "sch", "ou")) for _ in range(r.randint(1, 4)))
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexed = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))

    def good_card():
        body = r.choice("3456") + number(14)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def bad_card():
        body = good_card()
        return body[:-1] + str((int(body[-1]) + r.randint(1, 9)) % 10)

    def grouped(digits, mark):
        return mark.join(digits[i : i + 4] for i in range(0, 16, 4))

    def iban(good):
        body = number(18)
        check = 98 - int(body + "131400") % 97
        return f"DE{check if good else (check + r.randint(1, 90)) % 97:02d}{body}"

    def phone():
        area = r.randint(201, 989)
        return r.choice((
            f"({area}) {r.randint(200, 999)}-{number(4)}", f"{area}-{r.randint(200, 999)}-{number(4)}", f"{area} {r.randint(200, 999)} {number(4)}", f"{area}.{r.randint(200, 999)}.{number(4)}",
            f"0{r.randint(10, 9999)}{r.choice((' ', '/', '-', ' / '))}{number(r.randint(5, 8))}", f"0{r.randint(1, 9)} {number(2)} {number(2)} {number(2)} {number(2)}", f"{r.choice('679')}{number(2)} {number(3)} {number(3)}",
        ))

    def address():
        groups = [f"{r.randrange(1 << 16):x}" for _ in range(8)]
        if r.random() < 0.6:
            at, n = r.randint(1, 5), r.randint(2, 3)
            return ":".join(groups[:at]) + "::" + ":".join(groups[at + n :])
        return ":".join(groups)

    def prefixed():
        big = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
        return r.choice((
            r.choice(("AKIA", "ASIA")) + big(16), r.choice(("sk_live_", "sk_test_", "rk_live_", "pk_live_")) + mixed(24), r.choice(("ghp_", "gho_", "ghs_")) + mixed(36), "glpat-" + mixed(20), "AIza" + mixed(35),
            f"xoxb-{number(11)}-{number(12)}-{mixed(24)}", "npm_" + mixed(36), "hf_" + mixed(34), f"SG.{mixed(22)}.{mixed(43)}", "sk-" + mixed(48), f"eyJ{mixed(33)}.eyJ{mixed(r.randint(40, 300))}.{mixed(43)}",
        ))

    def password():
        return r.choice((word() + number(r.randint(1, 4)), word().capitalize() + number(r.randint(1, 4)) + r.choice("!#$%&*?"), word() + r.choice("!#$%&*?_") + word() + number(1), mixed(r.randint(6, 12)) + number(1), number(r.randint(4, 8))))

    def key_block():
        name = r.choice(("RSA ", "EC ", "OPENSSH ", "")) + "PRIVATE KEY"
        return f"-----BEGIN {name}-----\n" + "\n".join(mixed(64) for _ in range(r.randint(2, 30))) + f"\n-----END {name}-----"

    cases = []
    for _ in range(n):
        kind = r.choice(("email", "ip", "card", "phone", "phone", "account", "identity", "secret", "secret", "secret"))
        true = r.random() < 0.5
        cue, against = r.choice(CUES[kind]), r.choice(AGAINST)
        if kind == "email":
            span = f"{word()}.{word()} at {word()}" if not true else f"{word()}.{word()}{r.choice((' (at) ', '(at)', ' [at] '))}{word()}{r.choice(('.', ' (dot) ', '[dot]'))}{r.choice(('com', 'org', 'net'))}"
            if not true:
                span = f"{word()} @ {word()}.{word()}"[:40]
            lead = cue if r.random() < 0.5 else word()
        elif kind == "card":
            span = grouped(good_card(), r.choice(". -")) if true else r.choice((bad_card(), grouped(bad_card(), r.choice(" .-"))))
            lead = cue if true and r.random() < 0.5 else against if r.random() < 0.4 else word()
        elif kind == "ip":
            span = address() if true else r.choice((f"{number(2)}:{number(2)}:{number(2)}", f"{hexed(2)}:{hexed(2)}:{hexed(2)}:{hexed(2)}:{hexed(2)}:{hexed(2)}", f"{number(1)}:{number(2)}:{number(3)}"))
            lead = cue if r.random() < 0.4 else word()
        elif kind == "phone":
            span = phone() if true else r.choice((phone(), f"{number(3)} {number(3)} {number(3)}", f"{number(4)}-{number(4)}-{number(4)}", f"{number(2)}.{number(3)}.{number(3)}", f"0{number(3)}-{number(4)}", f"0{number(1)}-{number(4)}"))
            lead = r.choice((cue, cue + ":", word() if span[0] == "(" else cue)) if true else r.choice((against, word())) if span[0] != "(" else against
        elif kind == "account":
            span = iban(true)
            lead = cue if r.random() < 0.5 else word()
        elif kind == "identity":
            span = f"{r.randint(1, 899):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
            lead = cue if true else r.choice((against, word()))
        else:
            true_span = r.choice((hexed(40), mixed(32), hexed(32), mixed(20), hexed(64)))
            style, said = r.random(), r.choice(PASSWORDS.split("|"))
            if style < 0.25:
                span, lead = prefixed() if true else r.choice(("sk-", "hf_", "npm_", "AIza", "eyJ")) + r.choice((word() + "-" + word() + "-" + word() + word(), word() + "_" + word() + "_" + word() + word())), r.choice((word() + " ", cue + " ", word() + ": "))
            elif style < 0.5:
                span, lead = password() if true else r.choice((word() + word(), word() + word() + word(), word().capitalize() + word())), said + r.choice((": ", "=", " = ", " is ", ': "'))
            elif style < 0.55 and true:
                span, lead = key_block(), r.choice(("", word() + "\n", cue + ": "))
            elif true:
                span, lead = true_span, r.choice((f'{cue} = "', f"{cue}=", f"{cue}: ", f"{cue} = "))
            else:
                span, lead = r.choice(((hexed(40), against + " "), (hexed(32), against + ": "), (word() + word() + word() + word(), word() + ": "), (word() + "." + word() + "." + word(), word() + "="), (mixed(24), against + ": ")))
        left = " ".join(word() for _ in range(r.randint(0, 6))) + " " + lead + ("" if kind == "secret" else " ")
        text = left + span + r.choice((" ", ". ", ", ", '" ')) + " ".join(word() for _ in range(r.randint(0, 6)))
        cases.append((text, kind, len(left), len(left) + len(span), int(true)))
    for _ in range(n // 20):  # signed tokens and keys of several hundred characters, and chains of words as long
        true = r.random() < 0.5
        cue, against, length = r.choice(CUES["secret"]), r.choice(AGAINST), r.randint(130, 1000)
        if true:
            span, lead = r.choice((hexed(length), mixed(length), f"{mixed(36)}.{mixed(length)}.{mixed(43)}")), r.choice((f'{cue} = "', f"{cue}=", f"{cue}: ", f"{cue} = "))
        else:
            span, lead = r.choice(((hexed(length), against + " "), (".".join(word() for _ in range(length // 5)), word() + "="), (mixed(length), against + ": ")))
        left = " ".join(word() for _ in range(r.randint(0, 6))) + " " + lead
        cases.append((left + span + r.choice((" ", ", ", '" ')) + " ".join(word() for _ in range(r.randint(0, 6))), "secret", len(left), len(left) + len(span), int(true)))
    return cases


@functools.lru_cache(maxsize=1)
def chooser(precision: float = 0.99) -> tuple[Trees, dict[str, float]]:
    """The fitted trees and, for each kind, the lowest threshold with that precision on generated cases that neither fit nor calibration saw."""
    cases = generated_cases()
    rows = np.array([features(text, kind, a, b) for text, kind, a, b, _ in cases])
    label = np.array([c[4] for c in cases], float)
    fit, curve, check = (np.arange(len(cases)) % 3 == third for third in range(3))
    trees = Trees().fit(rows[fit], label[fit], rows[curve], label[curve])
    thresholds = {}
    chance = np.array([trees.probability(row) for row in rows])
    for kind in sorted({c[1] for c in cases}):
        own = check & np.array([c[1] == kind for c in cases])
        p, y = chance[own], label[own]
        order = np.argsort(-p, kind="stable")
        good = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
        fine = np.flatnonzero(good >= precision)
        last = int(fine[-1]) if len(fine) else -1
        below = float(p[order][last + 1]) if last + 1 < len(order) else 0.0
        thresholds[kind] = max(0.5, (float(p[order][last]) + below) / 2) if last >= 0 else 1.1  # halfway to the next case
    return trees, thresholds


def spans(text: str | None, model) -> tuple[list, list]:
    """Base spans, and all spans with the chosen proposals, each sorted by start and then kind."""
    key = lambda s: (s[1], KINDS.index(s[0]), s[2])
    if not text:
        return [], []
    base = sorted(base_spans(text), key=key) if HINT.search(text) else []
    trees, thresholds = model
    chosen = []
    for kind, a, b in propose(text):
        if any(a < y and x < b for _, x, y in base):
            continue
        p = trees.probability(features(text, kind, a, b))
        if p >= thresholds[kind]:
            chosen.append((p, kind, a, b))
    kept: list = []
    for _, kind, a, b in sorted(chosen, key=lambda c: (-c[0], c[2], KINDS.index(c[1]), -c[3])):
        if not any(a < y and x < b for _, x, y in kept):
            kept.append((kind, a, b))
    return base, sorted(base + kept, key=key)


def written(found: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in found)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, spans array<struct<kind, start, end>>)`` in code points, end exclusive."""
    shipped = df.sparkSession.sparkContext.broadcast(chooser())

    def setup():
        model = shipped.value
        return lambda key, text: (key, [{"kind": k, "start": a, "end": b} for k, a, b in spans(text, model)[1]])

    return map_rows(df, [id_col, text_col], f"`{id_col}` {dict(df.dtypes)[id_col]}, spans array<struct<kind:string,start:int,end:int>>", setup)


def redact_text(text: str | None, model) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in spans(text, model)[1]:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the text redacted; every other column and every row stay."""
    shipped = df.sparkSession.sparkContext.broadcast(chooser())

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        model = shipped.value
        return pd.Series([redact_text(t, model) for t in texts], index=texts.index, dtype=object)

    return df.withColumn(text_col, clean(F.col(text_col)))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base spans, their digest, and all spans and their number of every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    shipped = spark.sparkContext.broadcast(chooser())

    def setup():
        model = shipped.value

        def row(key, text):
            base, whole = spans(text, model)
            counts = [sum(s[0] == k for s in base) for k in KINDS[:4]]
            return (key, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(whole), len(whole))

        return row

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long", setup)
