"""Pages of any depth: cost follows the length, texts agree with a plain reading of the tree."""

import random
import time
from html.parser import HTMLParser

import pytest

from tidemark.llm import htmltext

# No element whose end tag may be implied: the plain reading counts start and end tags.
SHOWN = "div section b i span em blockquote ul ol dl h1 pre math".split()
HIDDEN = "svg annotation noframes script template".split()


class Plain(HTMLParser):
    """Brute force: every word that stands in no hidden element, in order."""

    def __init__(self):
        super().__init__()
        self.depth, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += bool(self.depth or tag in HIDDEN or "hidden" in dict(attrs))

    def handle_endtag(self, tag):
        self.depth -= bool(self.depth)

    def handle_data(self, data):
        self.words += [] if self.depth else data.split()


def tree(draw: random.Random, depth: int) -> str:
    out = []
    for _ in range(draw.randint(0, 4)):
        if depth and draw.random() < 0.6:
            name = draw.choice(SHOWN if draw.random() < 0.85 else HIDDEN)
            inner = "w1" if name in ("script", "noframes") else tree(draw, depth - 1)
            out.append(f"<{name}{' hidden' if draw.random() < 0.1 else ''}>{inner}</{name}>")
        else:
            out.append(draw.choice([" one ", " two\n", " &amp; ", " x&lt;y ", "\n\n"]))
    return "".join(out)


def test_words_as_in_a_plain_reading():
    draw = random.Random(7)
    for _ in range(1500):
        html = tree(draw, 5)
        plain = Plain()
        plain.feed(html)
        plain.close()
        # words of neighbouring inline elements may touch
        assert "".join(htmltext.render(html).split()) == "".join(plain.words)


def test_indent_and_prefixes():
    assert htmltext.render("<ol><li>a<ul><li>b<br>c<li><blockquote>d</blockquote></ul><li><br>e</ol>") == "1. a\n   - b\n     c\n   -   d\n2. \n   e"
    deep = htmltext.render("<ul><li>a" * 300).split("\n")
    assert len(deep) == 300 and deep[3] == "      - a" and deep[-1] == " " * htmltext.INDENT + "- a"


def test_tables_beyond_the_aligned_depth_keep_their_text():
    lines = htmltext.render("<table><tr><td>a<td>b<td>" * 40).split("\n")
    assert sum(line.count("a") for line in lines) == 40 and sum(line.count("b") for line in lines) == 40


def test_formulas_are_visible_drawings_are_not():
    assert htmltext.render("<p>so <math><mi>x</mi><annotation>tex</annotation></math> is<svg><text>no</text></svg>") == "so x is"
    assert htmltext.render("a<script>x</script>b<div hidden>y<p>z</div> c") == "ab c"


@pytest.mark.parametrize("unit", ["<div>", "<div>a", "<ul><li>", "<ul><li>a", "<table><tr><td>a", "<table><tr><td>a<td>", "<p><button>", "<blockquote>a", "<b><div>", "<dl><dd>a"])
def test_time_follows_the_length(unit):
    def seconds(n):
        start = time.process_time()
        htmltext.render(unit * n + "x" + "</b>" * n)
        return time.process_time() - start
    short = min(seconds(4000) for _ in range(2))
    assert seconds(32_000) < 8 * max(short, 0.05) * 3
