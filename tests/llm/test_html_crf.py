import itertools
import time

import numpy as np
import pytest

from plumbline.llm import html_crf as H

PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var t="<p>no</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href="/a">Menu</a><li><a href="/b">Other</a></ul></nav><header><div>Site name</div></header>
<div class="ad">Buy now!</div><article><h1>Title &amp; more</h1><p><b>First  line<br>goes on&nbsp;here.</b><p>Second, with a <a href=#>link</a> in it.
<ul><li>one thing<li>another thing</ul><!-- no <p>x</p> --><p>Less &lt; more &eacute;.</p></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>Reader</p><p>I think, that this is a long and fine comment about it.</p></div></section>
<aside><p>Also, see these other pages that we made.</p></aside><form><label>Mail</label><button>Send</button></form>
<div class="cookie-notice"><p>We use cookies, as all do, on this site.</p></div><footer>&copy; us</footer></body></html>"""
TEXT = "Title & more\nFirst line goes on here.\nSecond, with a link in it.\none thing\nanother thing\nLess < more é."


LONG = "The mill stood by the river for two hundred years, until the flood of 1910 took its wheel."
NEXT = "Nobody rebuilt it, although the village asked for help twice, and the stones went into a barn."
#: Written by hand, apart from the layouts of the training pages: each with the text that is wanted.
BY_HAND = [
    (f"<body>{f'<p>{LONG}</p>' * 5}", "\n".join([LONG] * 5)),
    (f"<html><body><div class=wrap><div class=x1><h1>The mill</h1><p>{LONG}<p>{NEXT}</div></div></body></html>", f"The mill\n{LONG}\n{NEXT}"),
    (f"<div class='thread-body'><p>{LONG}</p><p>{NEXT}</p></div>", f"{LONG}\n{NEXT}"),
    (f"<article><p title='a > b'>{LONG}</p><img alt=\"x > y\"><p>{NEXT}</p></article>", f"{LONG}\n{NEXT}"),
    (
        f"<body><div id=hd><a href=/>Home</a> <a href=/b>Blog</a> <a href=/c>About us</a></div><div class=k9><h1>The mill</h1><p>{LONG}</p><p>{NEXT}</p><ul><li>one wheel<li>two stones</ul><p>{LONG}</p></div>"
        "<div class=k3>&copy; 2020 Friends of the mill</div></body>",
        f"The mill\n{LONG}\n{NEXT}\none wheel\ntwo stones\n{LONG}",
    ),
    (
        f"<body><table><tr><td class=left><a href=1>News</a><br><a href=2>Maps</a><br><a href=3>Contact</a></td><td><h2>The mill</h2><p>{LONG}</p><p>{NEXT}</p><p>{LONG}</p></td></tr></table></body>",
        f"The mill\n{LONG}\n{NEXT}\n{LONG}",
    ),
    (
        f"<body><header role=banner><h2>Mill news</h2></header><div id=bodyContent><h1>Mills</h1><p>{LONG}</p><pre>run --all &lt;file&gt;</pre><p>{NEXT}</p></div>"
        f"<div id=disqus class=comments-area><p>Anna</p><p>{LONG}</p></div><footer><p>Imprint</p></footer></body>",
        f"Mills\n{LONG}\nrun --all <file>\n{NEXT}",
    ),
    (
        f"<body><nav class=top><a href=/>Start</a></nav><div><div><div><p>{LONG}</p><aside>Read also: ten mills</aside><p>{NEXT}</p></div></div></div><div class='newsletter-box'><p>Get our mail each week, free of charge.</p></div></body>",
        f"{LONG}\n{NEXT}",
    ),
    (
        f"<body><div class=c-17><a href=/a>Older</a> &middot; <a href=/b>Newer</a></div><section class='q7'><h2>The mill</h2><div>{LONG}</div><div>{NEXT}</div><div>{LONG}</div></section>"
        "<div class='share-row'><a href=#>Tell a friend</a></div><div class='reader-comments'><ol><li>I lived there, and it was a fine place to be.</li></ol></div></body>",
        f"The mill\n{LONG}\n{NEXT}\n{LONG}",
    ),
]


def test_leaf_blocks():
    assert [b.text for b in H.leaf_blocks("<p>a<b>b</b><p>c<div>d</div>e<br>f</div><p x")] == ["ab", "c", "d", "e f"]
    assert [b.text for b in H.leaf_blocks("<!-- <p>x</p> <p>y")] == []
    assert H.leaf_blocks("<a href=#>ab</a>cd")[0].link_share == 0.5


def test_held_out_pages():
    field = H.default_field()
    wrong = total = 0
    for page, labels in H.labelled_pages(200, 99):
        got = field.decode(H.features(H.leaf_blocks(page)))
        wrong += sum(a != b for a, b in zip(got, labels))
        total += len(labels)
    assert wrong / total < 0.01
    assert field.extract(PAGE) == TEXT


@pytest.mark.parametrize("page, text", BY_HAND)
def test_pages_written_by_hand(page, text):
    assert H.default_field().extract(page) == text


def test_tags():
    texts = lambda page: [b.text for b in H.leaf_blocks(page)]
    assert texts("<p a = \"x>\" b='>'>one<p it's>two</p><p c=\"never closed>three") == ["one", "two", "three"]
    assert texts("<script a='>'>no</script x><title>no</title><titles>yes") == ["yes"]


def test_time_grows_with_the_page():
    field = H.default_field()
    for page in ("<div>a" * 100_000, "<p><table>" + "<div>a" * 100_000, "<b>" * 100_000 + "<p>x" * 100_000, "<p a=\"" * 100_000):
        start = time.monotonic()
        field.extract(page)
        assert time.monotonic() - start < 20


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(4)
    for _ in range(30):
        f = H.Field({"a": 0, "b": 1, "c": 2}, rng.normal(size=3), rng.normal(size=(2, 2)), rng.normal(size=2))
        found = [list(rng.choice(["a", "b", "c", "new"], 2)) for _ in range(6)]

        def worth(y):
            return f.start[y[0]] + sum(sum(f.weights.get(x, 0) for x in own) * k for own, k in zip(found, y)) + sum(f.steps[a][b] for a, b in itertools.pairwise(y))

        assert worth(f.decode(found)) == pytest.approx(max(map(worth, itertools.product([0, 1], repeat=6))))


def test_gradient():
    rng = np.random.default_rng(5)
    pages = [([rng.integers(0, 4, 3) for _ in range(n)], rng.integers(0, 2, n)) for n in (1, 3, 5)]
    at = rng.normal(size=10)
    _, grad = H.likelihood(at, pages, 4)
    for k in range(10):
        step = np.eye(10)[k] * 1e-5
        numeric = (H.likelihood(at + step, pages, 4)[0] - H.likelihood(at - step, pages, 4)[0]) / 2e-5
        assert numeric == pytest.approx(grad[k], abs=1e-5)


def test_pages(spark):
    rows = [(1, "u", PAGE, "clash"), (2, None, None, "x"), (3, "v", "", "x"), (4, "w", "<p", "x"), (1, "u", PAGE, "clash"), (None, "u", "<article><p>" + "word " * 100_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in H.extract_pages(spark, df).collect()), key=str)
    want = [(1, "u", TEXT), (1, "u", TEXT), (2, None, ""), (3, "v", ""), (4, "w", ""), (None, "u", ("word " * 100_000).strip())]
    assert got == sorted(((a, b, c, len(c)) for a, b, c in want), key=str)
    assert H.extract_pages(spark, df.limit(0)).count() == 0


def test_training_is_bounded(monkeypatch):
    monkeypatch.setattr(H, "MAX_TRAINING_PAGES", 3)
    with pytest.raises(ValueError):
        H.train(H.labelled_pages(5))
