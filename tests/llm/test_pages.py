"""Main text of pages laid out and labelled by hand, and how reading one grows."""

import time

from heddle.llm import html_tree

PAGES = [
    # A newspaper page with its parts as elements.
    (
        """<!doctype html><html><head><title>River news</title><style>.a{color:red}</style></head><body>
<header><a href="/">The Daily River</a><nav><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav></header>
<main><article><h1>Bridge opens after ten years</h1>
<p>The new bridge over the river opened on Monday morning, ten years after work on it began.</p>
<p>Some four thousand people crossed it in the first hour, the city said &ndash; more than had been expected.</p>
<blockquote>It is a good day for everyone who lives on the north bank, the mayor said.</blockquote>
<p>Buses will run across it from next week on.</p></article></main>
<aside class="related"><h3>Most read</h3><ul><li><a href="/1">Rain again</a></li><li><a href="/2">Cup final</a></li></ul></aside>
<footer><p>&copy; The Daily River. All rights reserved.</p></footer></body></html>""",
        "Bridge opens after ten years\nThe new bridge over the river opened on Monday morning, ten years after work on it began.\n"
        "Some four thousand people crossed it in the first hour, the city said – more than had been expected.\n"
        "It is a good day for everyone who lives on the north bank, the mayor said.\nBuses will run across it from next week on.",
    ),
    # A weblog of plain blocks with class names, comments below the post.
    (
        """<html><body><div id="wrapper"><div class="top-menu"><a href="/">Home</a> | <a href="/about">About</a></div>
<div class="cookie-consent">We use cookies. <button>Accept</button></div>
<div class="post-content"><h2>How I bake bread</h2><p>Take five hundred grams of flour and mix it with water, salt and a little yeast.
<p>Let the dough rest over night. Fold it in the morning, and bake it for forty minutes in a hot oven.
<ul><li>five hundred grams of flour<li>three hundred grams of water</ul></div>
<div class="share"><a href="#">Tweet</a> <a href="#">Mail</a></div>
<div id="comments"><h3>2 comments</h3><div class="comment"><p>Great recipe, thank you so much for it!</p></div><div class="comment"><p>Mine did not rise at all.</p></div></div>
<div class="footer">Powered by a small engine</div></div><script>var x = "<p>no</p>";</script></body></html>""",
        "How I bake bread\nTake five hundred grams of flour and mix it with water, salt and a little yeast.\n"
        "Let the dough rest over night. Fold it in the morning, and bake it for forty minutes in a hot oven.\nfive hundred grams of flour\nthree hundred grams of water",
    ),
    # A manual page with a formula, code and odd attributes.
    (
        """<body><nav class=breadcrumbs><a href=/docs>Docs</a> &gt; <a href=/docs/area>Area</a></nav>
<article><h1>Area of a circle</h1><p data-note=it's title="a > b">The area is <math><mi>A</mi> = <mi>p</mi> <mi>r</mi></math> times the radius once more.</p>
<pre>area(2)   # twelve and a half</pre><p>See the chapter on <a href="/spheres">spheres</a> for bodies.</p></article>
<form action=/q><p>Was this page of use to you?</p><button>Yes</button></form></body>""",
        "Area of a circle\nThe area is A = p r times the radius once more.\narea(2) # twelve and a half\nSee the chapter on spheres for bodies.",
    ),
]


def test_pages_labelled_by_hand():
    model = html_tree.trained()
    for source, text in PAGES:
        assert model.text(source) == text


def test_time_grows_with_the_length_only():
    n = 16_000
    begin = time.time()
    for source in ("<div>" * n + "</p>" * n, "<li><ul>" + "<div>" * n + "<li>a</li>" * n, "<! " * n, "<a href='" * n, "<p x=\"b' <" * n):
        html_tree.Page(source)
    assert time.time() - begin < 5


def test_marks_in_attributes_are_no_text():
    page = html_tree.Page("<p data-x=it's>one<p a='x>y' b=\"p > q\" c = d/e>two</p><b x=\"'>three</b> four")
    assert [t for _, t in page.runs] == ["one", "two", "three four"] or [t for _, t in page.runs] == ["one", "two three four"]
