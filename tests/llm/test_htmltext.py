import html
import random
import time

import pytest

from pagemend.llm import htmltext as H

LONG = "A sentence that is long enough to look like prose, with commas and such. "


def page(article, before="", after="", body="body"):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><{body}>{before}{article}{after}</{body}></html>'


NAV = '<nav><ul><li><a href="/a">Home page</a></li><li><a href="/b">About us all</a></li></ul></nav><div class="ad">Buy this now, it is the best thing ever made.</div>'
FOOT = '<aside>Read more of our stories</aside><div id="comments"><p>' + LONG * 3 + '</p></div><div class="cookie-notice">We use cookies</div><form><p>Sign up here</p></form><footer>&copy; site</footer>'


@pytest.mark.parametrize("article,want", [
    ("<article><h1>Title</h1><p>One &amp; two&nbsp;x.</p><p>Be.</p></article>", "Title\n\nOne & two x.\n\nBe."),
    ("<article><p><b>Un closed.<br><p>Next <i>one</i>\n  here.</p></article>", "Un closed.\n\nNext one here."),
    ("<main><p>a</p><div>b<p>c</p>d</div></main>", "a\n\nb\n\nc\n\nd"),
    ("<article><header>By me</header><p>Text.</p><footer>tags</footer><section class='comments'><p>first!</p></section></article>", "Text."),
    ("<article><p>x<script>1</script>y<!-- c -->z</p><p hidden>no</p><p style='display:none'>no</p><ul><li>i<li>j</ul><table><tr><td>k<td>l</table></article>", "xyz\n\ni\n\nj\n\nk\n\nl"),
    ("<article>&lt;p&gt; 5 &#60; 6 &eacute;&#x41;</article>", "<p> 5 < 6 éA"),
    ("<article></article>", ""),
])
def test_articles(article, want):
    assert H.main_text(article) == want
    if want:
        assert H.main_text(page(article, NAV, FOOT)) == want


def test_region_is_found_without_an_article_element():
    body = "".join(f"<p>{LONG * 2}{i}</p>" for i in range(6)) + "<p>Short.</p>"
    side = "<div><ul>" + "".join(f'<li><a href="/{i}">link {i}</a></li>' for i in range(20)) + "</ul></div>"
    out = H.main_text(page(f'<div id="story"><h1>Head</h1>{body}</div>', NAV + side, side + FOOT))
    assert out.split("\n\n") == ["Head", *[f"{LONG * 2}{i}".strip() for i in range(6)], "Short."]


def test_blocks_beside_the_region_are_kept_without_an_article_element():
    body = lambda n, at=0: "".join(f"<p>{LONG * 2}{i}</p>" for i in range(at, at + n))
    want = lambda n, at=0: [f"{LONG * 2}{i}" for i in range(at, at + n)]
    side = "<div><ul>" + "".join(f'<li><a href="/{i}">link {i}</a></li>' for i in range(20)) + "</ul></div>"
    assert H.main_text(f"<body><h1>T</h1><div>{body(17)}</div><div>{body(3, 17)}</div></body>").split("\n\n") == ["T", *want(20)]
    assert H.main_text(page(f"<h1>T</h1><div>{body(6)}</div>", NAV, FOOT)).split("\n\n") == ["T", *want(6)]
    assert H.main_text(page(f"<div><h1>T</h1></div><div>{body(17)}</div><div>{body(3, 17)}</div>", NAV + side, side + FOOT)).split("\n\n") == ["T", *want(20)]


def test_names_that_only_hold_such_a_word_are_kept_if_dense():
    odd = f"<article><p>{LONG}a</p><div class='social-history'><p>{LONG}b</p></div><p class='notice-of-birth'>{LONG}c</p><div class='related-work'>{LONG}d</div><label>e</label><div class='share-buttons'>Tweet</div></article>"
    assert H.main_text(odd).split("\n\n") == [f"{LONG}a", f"{LONG}b", f"{LONG}c", f"{LONG}d", "e"]
    assert [H.name_says(x) for x in ("comments-area", "site-header", "relatedPosts", "cookie_banner", "newsletter signup-form", "social-history", "work-related", "main-content", "story", "has-sidebar")] == [2, 2, 2, 2, 2, 1, 1, 0, 0, 0]


class Made:
    """A page of random make-up and the blocks that its article must give."""

    def __init__(self, seed):
        self.r = random.Random(seed)

    def words(self, lo, hi):
        return " ".join(self.r.choice(("wort", "and", "été", "niño", "a<b", "x&y", "is", "long", "über", '"q"')) for _ in range(self.r.randint(lo, hi)))

    def inline(self, text):
        """The text with character references, odd white space and inline elements."""
        parts = [html.escape(w) if self.r.random() < 0.7 else "".join(f"&#{ord(c)};" for c in w) for w in text.split(" ")]
        parts = [f"<{t}>{w}</{t}>" if (t := self.r.choice(("b", "i", "em", "", "", "", "", ""))) else w for w in parts]
        return self.r.choice((" ", "\n  ", " ")).join(parts)

    def aside(self):
        said = self.inline(self.words(3, 60))
        return self.r.choice((f"<nav><ul><li><a href='/'>{said}</a></li></ul></nav>", f"<div class='ad'>{said}</div>", f"<aside><p>{said}</p></aside>", f"<section id='comments'><p>{said}</p><div>{said}</div></section>", f"<div class='cookie-notice'>{said}</div>", f"<form><label>{said}</label><input></form>", f"<!-- {said.replace('--', '')} -->", "<script>var a = '</p>' < 2;</script>", f"<style>p {{}}</style><p hidden>{said}</p>"))

    def block(self, depth=0):
        """(html, expected blocks)"""
        style = self.r.random()
        if style < 0.1:
            return self.aside(), []
        if style < 0.2 and depth < 4:
            inner = [self.block(depth + 1) for _ in range(self.r.randint(1, 4))]
            return "<div class='part'>" + "".join(x for x, _ in inner) + "</div>", [b for _, bs in inner for b in bs]
        if style < 0.3:
            items = [self.words(1, 8) for _ in range(self.r.randint(1, 4))]
            return "<ul>" + "".join(f"<li>{self.inline(i)}" + self.r.choice(("", "</li>")) for i in items) + "</ul>", items
        said = self.words(1, 4) if self.r.random() < 0.2 else self.words(15, 60)
        return f"<{self.r.choice(('p', 'p', 'p', 'h2', 'blockquote'))}>{self.inline(said)}" + self.r.choice(("", "\n")), [said]


def test_made_pages_equal_what_they_were_made_of():
    for seed in range(150):
        m = Made(seed)
        parts = []
        for at, (text, blocks) in enumerate([m.block() for _ in range(m.r.randint(3, 12))]):
            tag = text[1:].split(">")[0]
            parts.append((text + (f"</{tag}>" if tag in ("h2", "blockquote") else "</p>" if tag == "p" and m.r.random() < 0.5 else ""), blocks))
        want = [b for _, blocks in parts for b in blocks]
        body = f"{m.aside()}<article>{''.join(t for t, _ in parts)}</article>{m.aside()}<footer>{m.words(1, 30).replace('<', '')}</footer>"
        if want:
            assert H.main_text(f"<html><head><title>T</title></head><body>{body}</body></html>").split("\n\n") == want, (seed, body)


def test_work_grows_with_the_page_and_not_with_its_depth():
    for made in ("<div><b>x</b> word ", "<ul><li>", "x</zz><p><div><b>"):
        took = []
        for n in (5_000, 40_000):
            began = time.process_time()
            H.main_text(made * n)
            took.append(time.process_time() - began)
        assert took[1] < 24 * took[0] + 0.5, (made, took)  # 64 times if it were quadratic


def test_nothing_and_junk():
    assert [H.main_text(x) for x in (None, "", "   ", "<", "<p", "</div></p>", "<script>x")] == ["", "", "", "<", "<p", "", ""]
    assert H.main_text("just words\n and more") == "just words and more"
    assert H.main_text("<article><p>" + "w " * 200_000 + "</p>") == ("w " * 200_000).strip()
    assert H.main_text("<div>" * 3000 + "deep") == "deep"


def test_query(spark, put):
    ddl = "page_id long, url string, html string, text string"
    rows = [(1, "u", page("<article><p>é one</p><p>two</p></article>"), "clash"), (2, None, None, None), (2, None, None, None), (None, "v", "<p>x</p>", "")]
    out = H.op6_main_text(spark, put(pages=(rows, ddl))).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in out) == [("1", "é one\n\ntwo", 10), ("2", "", 0), ("2", "", 0), ("None", "x", 1)]
    assert H.op6_main_text(spark, put(pages=([], ddl))).count() == 0
