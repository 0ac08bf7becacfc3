"""Main text of web pages from streaming parser events.

The standard-library parser's events are cut into lines at block elements.  Each line has a text-to-tag ratio; the ratios are
smoothed with a Gaussian and split into two clusters by a threshold, and the dense cluster's lines vote for the region of the
page that holds the article.  All lines of that region come out, short ones too, and where no article element names it also the
blocks beside it and around it that are mostly dense text or headings.

Elements that are never article text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments)
stay out, by their element name or because class, id or role say nothing else.  Where such a word is only part of a name
(``social-history``, ``related-work``) the name is a hint: lines under it count only if they are in the dense cluster.

A null or empty page, and a page without text, gives an empty string.  Unclosed and misnested elements are tolerated: a block
element closes an open paragraph, an end tag closes everything above its start tag, and an end tag without a start is ignored.
Work grows in proportion to the page, however deep it nests.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0
#: A region is entered when it holds this share of the dense cluster's text.
SHARE = 0.8

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("head script style noscript template svg math iframe object nav header footer aside form button select textarea input option menu dialog canvas audio video".split())
REGIONS = frozenset("body div section article main td table tbody tr html center".split())
ARTICLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Names that sites give to parts that are no article, as words of class, id and role.
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar aside complementary ad ads advert adverts advertisement advertising banner contentinfo sponsor sponsored "
    "promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search comment comments commentlist disqus reply replies respond share sharing "
    "social related recommended widget toolbar pagination pager paywall".split()
)
# Words that add nothing to such a name.
PLAIN_WORDS = frozenset(
    "area bar bars block blocks body bottom box boxes button buttons center col column container content contents element fixed float footer form group holder inner item items label large left link links list lists main "
    "mobile module outer page panel post posts primary right row secondary section sections site slot small sticky story stories tab tabs text title top unit view wrap wrapper zone article articles global local page "
    "form field default desktop icon icons js".split()
)
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_SPACE = re.compile(r"\s+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

_STANDS_BY = frozenset("with has no without".split())
_IN_ARTICLES = frozenset("comment comments reply replies ad ads advert sponsored promo related".split())
_CONTENT = frozenset("main content article story post text body".split())


def name_says(value: str, words: frozenset = ASIDE_WORDS) -> int:
    """2 if a name says that an element is no article text and nothing else, 1 if such a word is its first or last, else 0."""
    most = 0
    for token in value.split():
        parts = [w.lower() for w in _WORD.findall(token)]
        if not parts or _STANDS_BY.intersection(parts):
            continue
        told = [w in words or w.removesuffix("s") in words for w in parts]
        if all(x or w in PLAIN_WORDS for x, w in zip(told, parts, strict=True)) and any(told) and not (parts[-1] in _CONTENT and parts[0] in _CONTENT):
            return 2
        most = max(most, int(told[0] or told[-1]))
    return most


def hides(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """2 if an element is never article text, 1 if its name hints at that, else 0."""
    if tag in NEVER:
        return 2
    most = 0
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return 2
        if value and name in ("class", "id", "role") and tag not in ("html", "body"):
            most = max(most, name_says(value, _IN_ARTICLES if tag in ARTICLE else ASIDE_WORDS))
        if value and name == "style" and _UNSEEN.search(value):
            return 2
    return most


class Region:
    """A container; ``mass`` is the dense text under it, ``good`` that of dense lines and headings by themselves, of ``size``."""

    __slots__ = ("tag", "parent", "article", "mass", "good", "size", "below", "within")

    def __init__(self, tag, parent, article):
        self.tag, self.parent, self.article, self.mass, self.good, self.size, self.below, self.within = tag, parent, article, 0, 0, 0, [], False


class Open:
    """An open element: its region before it, what its name says, the paragraph that a block would close, and the list scope."""

    __slots__ = ("tag", "region", "hides", "paragraph", "scope")

    def __init__(self, tag, region, hides, paragraph, scope):
        self.tag, self.region, self.hides, self.paragraph, self.scope = tag, region, hides, paragraph, scope


#: Items that an item of the same name closes, within these.
_ITEMS, _LISTS = frozenset("li dd dt td th tr option".split()), frozenset("ul ol dl table menu select".split())


class Lines(HTMLParser):
    """Collects (region, text, tags, heading, hinted) lines outside of never-article elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Region("", None, False)
        self.regions = [self.root]  # each after its parent
        self.open: list[Open] = []
        self.count: dict[str, int] = {}
        self.region, self.hidden, self.hinted, self.headings, self.buffer, self.tags = self.root, 0, 0, 0, [], 0
        self.lines: list[tuple[Region, str, int, bool, bool]] = []

    def cut(self):
        if self.buffer:
            if text := _SPACE.sub(" ", "".join(self.buffer)).strip():
                self.lines.append((self.region, text, self.tags, self.headings > 0, self.hinted > 0))
                self.tags = 0
            self.buffer = []

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.buffer.append(" ")
            return
        if tag in BLOCKS:
            self.cut()
            if self.open and self.open[-1].paragraph >= 0:
                self._pop_to(self.open[-1].paragraph)
        if tag in _ITEMS and self.open and (at := self.open[-1].scope.get(tag)):
            self._pop_to(at[-1])
        if tag in VOID:
            return
        says, region, above = hides(tag, attrs), self.region, self.open[-1] if self.open else None
        if tag in REGIONS and not self.hidden and says < 2:
            self.region = Region(tag, region, tag in ARTICLE or ("role", "main") in attrs)
            self.regions.append(self.region)
        place = len(self.open)
        paragraph = place if tag == "p" else -1 if tag in REGIONS or says == 2 or above is None else above.paragraph
        scope = {} if tag in _LISTS or above is None else above.scope
        if tag in _ITEMS:
            scope.setdefault(tag, []).append(place)
        self.open.append(Open(tag, region, says, paragraph, scope))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.hidden += says == 2
        self.hinted += says == 1
        self.headings += tag in HEADINGS

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1].tag == tag:
            self.handle_endtag(tag)

    def _pop_to(self, place):
        """Closes the element at this place and all above it."""
        while len(self.open) > place:
            one = self.open.pop()
            self.region = one.region
            self.count[one.tag] -= 1
            self.hidden -= one.hides == 2
            self.hinted -= one.hides == 1
            self.headings -= one.tag in HEADINGS
            if one.tag in _ITEMS and (at := one.scope.get(one.tag)) and at[-1] == len(self.open):
                at.pop()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        if self.count.get(tag):
            place = len(self.open) - 1
            while self.open[place].tag != tag:
                place -= 1
            self._pop_to(place)

    def handle_data(self, data):
        if not self.hidden:
            self.buffer.append(data)

    def close(self):
        super().close()
        self.cut()


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with edges repeated."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def dense(ratios: np.ndarray, rounds: int = 32) -> np.ndarray:
    """The dense cluster of smoothed ratios: a threshold halfway between the means on either side, found by iteration."""
    level = np.log1p(smooth(ratios))
    threshold = (level.min() + level.max()) / 2
    for _ in range(rounds):
        high = level >= threshold
        if high.all() or not high.any():
            return np.ones(len(level), bool)
        fresh = (level[high].mean() + level[~high].mean()) / 2
        if abs(fresh - threshold) < 1e-9:
            break
        threshold = fresh
    return level >= threshold


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    if not parser.lines:
        return ""
    ratios = np.array([len(text) / max(1, tags) for _, text, tags, *_ in parser.lines])
    chosen_lines, own = dense(ratios), np.log1p(ratios)
    level = np.log1p(smooth(ratios))[chosen_lines].min()
    in_cluster = chosen_lines & (own >= level)
    lines = []  # without those that a name hints at and the ratio does not hold
    for (region, text, _, heading, hinted), chosen, by_itself in zip(parser.lines, chosen_lines.tolist(), in_cluster.tolist(), strict=True):
        good = heading or by_itself
        if not hinted or by_itself:
            lines.append((region, text, good))
            region.mass += len(text) * chosen
            region.good += len(text) * good
            region.size += len(text)
    used = set()
    for region in reversed(parser.regions):
        if region.size and region.parent is not None:
            up = region.parent
            up.mass, up.good, up.size = up.mass + region.mass, up.good + region.good, up.size + region.size
            used.add(id(region))
    for region in parser.regions:
        if id(region) in used:
            region.parent.below.append(region)
    at, total = parser.root, parser.root.mass
    best = at
    while True:
        articles = [x for x in at.below if x.article]
        if articles and sum(x.mass for x in articles) >= 0.5 * total:  # one article, or an unbroken run of them
            _mark(parser.regions, articles)
            return "\n\n".join(text for region, text, _ in lines if region.within)
        into = max(at.below, key=lambda x: x.mass, default=None)
        if into is None or into.mass < SHARE * total:
            break
        best = at = into
    # a chain of single containers may hold nothing more than a paragraph: without an article element keep the widest region with the same text
    while best.parent is not None and best.parent.mass == best.mass and best.parent.tag not in ("body", "html", ""):
        best = best.parent
    around, at = set(), best.parent
    while at is not None:
        around.add(id(at))
        at = at.parent
    # beside it: mostly good blocks, and what is good itself right in a container around it
    _mark(parser.regions, [best, *(x for x in parser.regions if id(x) not in around and 2 * x.good >= x.size > 0)])
    return "\n\n".join(text for region, text, good in lines if region.within or good and id(region) in around)


def _mark(regions: list[Region], roots: list[Region]) -> None:
    """Notes which regions lie in one of ``roots``."""
    for region in roots:
        region.within = True
    for region in regions:
        region.within = region.within or region.parent is not None and region.parent.within


def extract(df: DataFrame, id_cols: list[str], html_col: str = "html") -> DataFrame:
    """``(*id_cols, text)``, one row for each page."""
    kinds = dict(df.dtypes)

    def setup():
        return lambda *values: (*values[:-1], main_text(values[-1]))

    return map_rows(df, [*id_cols, html_col], ", ".join(f"`{c}` {kinds[c]}" for c in id_cols) + ", text string", setup)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"]).selectExpr("page_id", "url", "text", "cast(length(text) as bigint) as n_chars")
