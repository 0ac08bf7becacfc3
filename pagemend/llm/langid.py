"""Language identification by nearest centroid.

A text becomes a hashed TF-IDF vector of letter 1- to 3-grams, scaled to length one.  Each language has several centroids from
spherical k-means over a bounded sample of labelled rows; the prediction is the language of the centroid with the highest
cosine.  A text too far from every centroid, for its length, is marked as rejected.

Null texts and texts without a letter are ``und`` with score 0, and rejected.  If nothing can be learned, every text is.
Ties go to the first language in sort order.  Texts are read whole, in blocks, so memory does not follow their length.  The fit
collects counts of hashed n-grams, at most about ``FIT_ROWS`` rows of ``DIMENSIONS`` numbers for each language, and no texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

#: Buckets that n-grams are hashed into.
DIMENSIONS = 1 << 14
#: Centroids of each language.
CLUSTERS = 3
#: Labelled rows that a language contributes to the fit, at most (chosen by a hash of the id).
FIT_ROWS = 300
#: Languages that can be learned; more are refused, since they would not bound the model that is shipped to executors.
MAX_LANGUAGES = 500
#: Characters handled at once.
BLOCK = 1 << 20
#: A text is rejected under this share of the lowest cosine seen, at its length, on labelled rows.
REJECT_SHARE = 0.5

_LETTERS: list = []


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter; built once a process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def gram_counts(text: str | None) -> tuple[np.ndarray | None, int]:
    """Hashed counts of letter 1-3-grams with marks at word edges, and the number of letters; (None, 0) without a letter."""
    total, letters, edge = None, 0, np.zeros(0, np.uint64)
    text = text or ""
    for lo in range(0, len(text), BLOCK):
        code = np.frombuffer(text[lo : lo + BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = _letters()[code]
        found = int(is_letter.sum())
        if not found and not letters:
            continue
        letters += found
        code = np.where(is_letter, code, 0).astype(np.uint64)
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[0] = True
        code = np.concatenate([edge, code[keep]]) if len(edge) else np.concatenate([np.zeros(1, np.uint64), code[keep]])
        code = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]
        a = code * np.uint64(0x9E3779B97F4A7C15)
        two = (a[:-1] ^ (a[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + a[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + a[2:]
        shift = np.uint64(64 - DIMENSIONS.bit_length() + 1)
        old = max(1, len(edge))  # what the last block has counted
        part = np.bincount(np.concatenate([a[old:], two[old - 1 :], three[max(0, old - 2) :]]) >> shift, minlength=DIMENSIONS)
        total = part if total is None else total + part
        edge = code[-2:]
    return (total, letters) if letters else (None, 0)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float32)) * idf
    norm = float(np.sqrt(v @ v))
    return v / norm if norm else v


class Model:
    """``centroids`` (rows of length one), ``owner`` (language index per row), ``idf`` and the lowest cosine by length class."""

    def __init__(self, languages, centroids, owner, idf, floor):
        self.languages, self.centroids, self.owner, self.idf, self.floor = languages, centroids, owner, idf, floor

    def nearest(self, counts: np.ndarray) -> tuple[int, float]:
        near = self.centroids @ weigh(counts, self.idf)
        best = int(np.argmax(near))
        return int(self.owner[best]), float(min(1.0, max(0.0, near[best])))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, and whether the text is rejected as too far from all."""
        counts, letters = gram_counts(text)
        if counts is None or not self.languages:
            return "und", 0.0, True
        at, score = self.nearest(counts)
        return self.languages[at], score, score < self.floor[min(letters.bit_length(), len(self.floor) - 1)]


def spherical_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means on the unit sphere, begun from the mean direction and then the rows farthest from all starts."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    starts = [int(np.argmax(rows @ unit(rows.mean(0))))]
    while len(starts) < min(k, len(rows)):
        starts.append(int(np.argmin((rows @ rows[starts].T).max(1))))
    centres = rows[starts].copy()
    for _ in range(rounds):
        nearest = np.argmax(rows @ centres.T, axis=1)
        fresh = unit(np.stack([rows[nearest == c].mean(0) if (nearest == c).any() else centres[c] for c in range(len(centres))]))
        if np.allclose(fresh, centres):
            break
        centres = fresh
    return centres.astype(np.float32)


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], clusters: int = CLUSTERS) -> Model:
    """Centroids from (language, buckets, counts) of texts with a letter; the model's floors are still to be set."""
    languages = sorted({c[0] for c in samples})
    if not languages:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.ones(DIMENSIONS, np.float32), [0.0])
    seen = np.zeros(DIMENSIONS)
    for _, at, _ in samples:
        seen[at] += 1
    idf = (np.log((1 + len(samples)) / (1 + seen)) + 1).astype(np.float32)
    centroids, owner = [], []
    for number, lang in enumerate(languages):
        own = [(at, values) for name, at, values in samples if name == lang]
        rows = np.zeros((len(own), DIMENSIONS), np.float32)
        for row, (at, values) in zip(rows, own, strict=True):
            row[at] = values
            row[:] = weigh(row, idf)
        centres = spherical_means(rows, clusters)
        centroids.append(centres)
        owner += [number] * len(centres)
    return Model(languages, np.concatenate(centroids), np.array(owner), idf, [0.0])


#: Length classes (bits of the number of letters) that have a floor of their own.
LENGTHS = 21


def lowest_by_length(model: Model, text: str | None) -> list[float | None]:
    """The lowest cosine of a text and of its beginnings of 4, 8, 16, ... characters, by length class."""
    lowest: list = [None] * LENGTHS
    for power in range(2, LENGTHS):
        part = (text or "")[: 1 << power]
        counts, letters = gram_counts(part)
        if counts is not None:
            at = min(letters.bit_length(), LENGTHS - 1)
            score = model.nearest(counts)[1]
            lowest[at] = score if lowest[at] is None else min(lowest[at], score)
        if len(part) < 1 << power:
            break
    return lowest


def floors(lowest: list[float | None]) -> list[float]:
    """The rejection threshold of each length class: lengths that were not seen are held to the nearest shorter one, and a shorter text may be as far as any longer one."""
    lowest = list(lowest)
    for at in range(1, len(lowest)):
        lowest[at] = lowest[at - 1] if lowest[at] is None else lowest[at]
    out, so_far = [], 1.0
    for value in reversed(lowest):
        so_far = min(so_far, 0.0 if value is None else value)
        out.append(REJECT_SHARE * so_far)
    return out[::-1]


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable: Column | None = None, fit_rows: int = FIT_ROWS, languages: int = MAX_LANGUAGES) -> Model:
    """Fit on at most about ``fit_rows`` rows of each language, chosen by a hash of the id, among rows where ``usable`` holds."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.where(usable) if usable is not None else rows
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).alias("lang")).count().limit(languages + 1).collect()}
    if len(counts) > languages:
        raise ValueError(f"more than {languages} languages; raise the bound if the executors can hold {CLUSTERS} x {DIMENSIONS} numbers for each")
    if not counts:
        return fit([])
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, fit_rows / n))])
    order = F.xxhash64(F.col(id_col).cast("string"))
    chosen = rows.where(F.pmod(order, F.lit(1 << 20)) / F.lit(float(1 << 20)) < F.coalesce(F.try_element_at(share, F.col(lang_col)), F.lit(0.0)))

    def counted():
        def row(lang, order, text):
            found = gram_counts(text)[0]
            at = np.flatnonzero(found) if found is not None else np.zeros(0, int)
            return lang, order, at.tolist(), found[at].tolist() if len(at) else []

        return row

    most = 2 * fit_rows * len(counts)  # of rows that share an id all are chosen
    grams = map_rows(chosen, [F.col(lang_col), order, F.col(text_col)], "lang string, at_hash long, buckets array<int>, counts array<long>", counted).where("size(buckets) > 0")
    model = fit([(r[0], np.array(r[1], np.int32), np.array(r[2], np.float32)) for r in grams.orderBy("at_hash", "lang", "buckets", "counts").limit(most).select("lang", "buckets", "counts").collect()])
    if not model.languages:
        return model
    shipped = df.sparkSession.sparkContext.broadcast(model)
    lows = map_rows(chosen, [F.col(text_col)], "low array<double>", lambda: lambda text: (lowest_by_length(shipped.value, text),))
    model.floor = floors(list(lows.agg(*[F.min(F.get("low", F.lit(at))) for at in range(LENGTHS)]).first()))
    return model


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score, rejected)`` of every whole text."""
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def setup():
        predict = shipped.value.predict
        return lambda key, text: (key, *predict(text))

    return map_rows(df, [id_col, text_col], f"`{id_col}` {dict(df.dtypes)[id_col]}, lang_pred string, score double, rejected boolean", setup)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no fit may see: crc32 of the id as text leaves 1 when divided by 3 (a null id is held out too)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, usable=~held_out())
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
