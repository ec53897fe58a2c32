"""Minimum cuts against all labellings, pages against their known text."""

from __future__ import annotations

import itertools
import random
import time

from quernstone.llm import html_text as h


def test_minimum_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(500):
        n = rng.randint(1, 7)
        gain = [rng.choice([-1, 1]) * rng.random() * 2 for _ in range(n)]
        links = [(rng.randrange(n), rng.randrange(n), rng.random()) for _ in range(rng.randint(0, 9))]

        def cost(side, gain=gain, links=links):
            return sum(max(0, -g) if s else max(0, g) for g, s in zip(gain, side, strict=True)) + sum(c for i, j, c in links if side[i] != side[j])

        assert abs(cost(h.minimum_cut(gain, links)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-9


def test_generated_pages_of_another_seed():
    rng, weights = random.Random(77), h.fitted()
    pages = [h.generated(rng) for _ in range(200)]
    right = sum(h.main_text(p, weights) == " ".join(t.split()) for p, t in pages)
    assert right >= 190


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><div class=logo>Site</div></header><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site, please accept them all.</p></div>
<article><h1>A  title &amp; more</h1><p>First <b>para</b>graph&nbsp;here.<br>Next line.</p><div class="ad">Buy our things now, they are cheap.</div>
<p>Second one with <a href="/y">a link</a> in it &lt;ok&gt;.</p><form><p>Sign up for mail</p><button>Go</button></form></article>
<aside><h3>Related</h3><p>Another story that is not this one.</p></aside>
<section id="comments"><div class="comment"><p>I liked this article very much, thank you.</p></div></section>
<footer>&copy; 2020 Someone. All rights reserved.</footer></body></html>"""


def test_parts_of_a_page():
    text = "A title & more First paragraph here. Next line. Second one with a link in it <ok>."
    assert h.main_text(PAGE, h.fitted()) == text
    assert h.main_text(PAGE.replace("</footer></body></html>", ""), h.fitted()) == text


def test_custom_and_unclosed_elements():
    text = h.main_text(PAGE, h.fitted())
    for tag in ("<video-js id=v></video-js>", "<svg-icon></svg-icon>", "<button-group></button-group>", "<select-box></select-box>", "<title-bar></title-bar>", "<script-x></script-x>", "<svg_x>", "<button>", "<select>", "<object data=x>", "<canvas>", "<audio src=a>", "<video src=a>", "<svg><p>no</p></svg>", "<video/>", "<VIDEO>no</video >"):
        page = PAGE.replace("<button>Go</button>", "").replace("</h1>", "</h1>" + tag)
        assert h.main_text(page, h.fitted()) == text, tag
    for tag in ("script", "style", "textarea", "iframe", "noscript"):
        assert h.main_text(PAGE.replace("<br>Next", f"<{tag}>Next"), h.fitted()) == "A title & more First paragraph here."


THREE = ["First of three paragraphs, long enough to be read as such.", "A second one follows it here, with some more words.", "The last one ends the article, as the last ones do."]


def article(*inserted):
    """A page with three paragraphs and, after the first, what is inserted."""
    body = "".join(f"<p>{x}</p>" for x in THREE[:1]) + "".join(inserted) + "".join(f"<p>{x}</p>" for x in THREE[1:])
    return f"<html><body><nav><a href=/>Home</a></nav><article>{body}</article><footer><p>All rights reserved.</p><form><button>Go</button></form><svg></svg></footer></body></html>"


def test_faults_of_markup():
    for inserted in ("<p title=it's></p>", '<p class="x>', "<p class='x>", "<svg>", "<button>", "<form>", "<select>", "<nav>", "<!-- c > -->", "<!-->", "</nav>", "</p></form>", "<a b=\"x>y\" c>", "<p data-x='<b>no</b>'>", "<a b=\"1\"c=\"2\">", "<", "<1", "</>", "<?x?>"):
        text = h.main_text(article(inserted), h.fitted())
        assert text.replace("< ", "").replace("<1 ", "") == " ".join(THREE), inserted


def test_hints_of_all_elements():
    for inserted in ('<p class="advert">Buy these things now, they are cheap today.</p>', '<p class="cookie-notice">We use cookies on this site, accept them.', "<p hidden>Not to be seen by anyone who reads this.</p>", '<span class="ad">Cheap things here.</span>', '<b style="display: none">Not seen.</b>', '<div><em class="sponsored">Paid for.</em></div>', '<ul><li class="comment">I liked this very much, thank you.</li></ul>'):
        assert h.main_text(article(inserted), h.fitted()) == " ".join(THREE), inserted
    kept = "A text that its readers may share with others, as they like."
    assert h.main_text(article(f'<div class="share-text">{kept}</div>'), h.fitted()) == " ".join([THREE[0], kept, *THREE[1:]])
    split = article().replace("second one", 'second <span class="ad">buy it</span> one')
    assert h.main_text(split, h.fitted()) == " ".join(THREE)


def test_long_pages_take_linear_time():
    begun = time.process_time()
    for unit in ('<a "', "<a b=\"", "<a b='x>", "<!--", "<p ", "</nav>", "<div>", "<span class=ad>", "<svg>", "<button>", "&", "<", "<script>", '<a "x>'):
        h.main_text(unit * (1_000_000 // len(unit)) if unit in ('<a "', "&", "<") else unit * 20_000, h.fitted())
    assert time.process_time() - begun < 30
    n, rng = 4000, random.Random(3)
    begun = time.process_time()
    h.minimum_cut([rng.uniform(-0.6, 0.6) for _ in range(n)], [(i, i + 1, 0.5) for i in range(n - 1)] + [(i, i + 2, 0.5) for i in range(n - 2)])
    assert time.process_time() - begun < 5


def test_frames(spark):
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, None, PAGE, "x"), (3, None, PAGE, "x"), (None, "u", "<p", "x"), (5, "u", "<div>" * 3000 + "deep words in here." + "</div>" * 10, "x"), (6, "u", "just plain words without a tag.", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = h.extract(df).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id in (1, 2)] == ["", ""]
    assert h.extract(df.limit(0)).collect() == []
