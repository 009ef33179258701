"""M2: dropped blocks go as wholes however they are nested; character references are decoded; no Python runs."""

import html as stdlib_html
import random
import re

import pytest
from pyspark.sql import functions as F

from sitelens.functions import html as H

CASES = [
    # nested and mismatched blocks
    ("<body><nav>a<nav>b</nav>c</nav>d", "d"),
    ("<body><header>a<nav>b</header>c</nav></header>d", "c\nd"),
    ("<body><header>a<div>b<header>c</header>d</div>e</header>f", "f"),
    ("<body><div><aside>a</div>b", "b"),  # the end of what is around ends the block
    ("<body><aside>a</div>b</aside>c", "c"),  # nothing is open around: ignored
    ("<body><div><form>a<div>b</div>c</div>d", "d"),
    ("<body><nav>a</footer>b</nav>c", "c"),
    ("<body><div class='x ad'>a<div>b</div>c</div>d", "d"),
    ('<body><div class="roads">kept</div><p class=ad>gone</p>kept', "kept\nkept"),
    ("<body>a<footer>never closed", "a"),
    ("<body></nav>a</header>b", "a\nb"),
    ("<body><div/>a</div><nav/>b</nav>c", "a\nc"),  # a slash closes nothing
    # raw texts and comments
    ("<body>a<script>if (a<b) x('</nav><p>')</script>b", "ab"),
    ("<body>a<!-- <nav> -->b<!-->c--> d", "ab d"),
    ("<body>a<style>p{}</STYLE >b<textarea><p>x</textarea>c", "abc"),
    ("<body>a<script>never closed <p>b", "a"),
    ('<body>a<a title="1 > 2" href=\'<nav>\'>b</a>c', "abc"),
    ("<body>1 < 2 and a<b", "1 < 2 and a"),
    # heads and bodies
    ("<head><title>t</title><body>a", "a"),
    ("<head><title>t</title><p>a", "a"),  # a head ends with the first tag that cannot stand in it
    ("<nav>x<body>a", "a"),
    ("<html>no body <p>b</html>", "no body\nb"),
    # references
    ("<body>&lt;p&gt; &amp;amp; &auml;&#228;&#xE4;&#XE4; &hearts; &notin; &CounterClockwiseContourIntegral;", "<p> &amp; ääää ♥ ∉ ∳"),
    ("<body>a&nbsp;b&#160;c&copy d&copy; &unknown; &; & &#; x&#128;y&#0;z&#xD800;&#1114112;", "a b c© d© &unknown; &; & &#; x€y�z��"),
    ("<body>&#128512; &#x1F600;", "😀 😀"),
    # lines
    ("<body> a <br> <br/> b<p>  </p><li>c</li> ", "a\nb\nc"),
    ("", ""), ("<body>", ""), ("plain", "plain"), (None, None),
]


@pytest.mark.parametrize("fold", [256, 3])
def test_cases(spark, fold, monkeypatch):
    monkeypatch.setattr(H, "FOLD_TOKENS", fold)
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, html string")
    got = {r.i: r.t for r in df.select("i", H.main_text("html").alias("t")).collect()}
    assert [(CASES[i][0], got[i]) for i in range(len(CASES))] == CASES


def tree(rng, depth=0):
    """(markup, visible text with a newline at each end of a block) of a random well-formed tree."""
    if depth > 4 or rng.random() < .25:
        t = rng.choice(["x", "y z", "a&amp;b", "ä", ""])
        return t, t.replace("&amp;", "&")
    name = rng.choice(["div", "p", "b", "span", "nav", "header", "footer", "aside", "form", "section", "li", "ad", "script", "noscript"])
    inside = [tree(rng, depth + 1) for _ in range(rng.randrange(4))]
    markup, shown = "".join(m for m, _ in inside), "".join(s for _, s in inside)
    if name == "ad":
        return f'<div id=1 class="big ad">{markup}</div>', "\n"
    if name == "script":
        return f"<script>{markup.replace('script', 'scr')}</script>", ""
    if name in H.DROPPED:
        return f"<{name}>{markup}</{name}>", "\n"
    return f"<{name}>{markup}</{name}>", f"\n{shown}\n" if name in H.BREAKS else shown


def test_random_trees(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        markup, shown = map("".join, zip(*[tree(rng) for _ in range(4)]))
        rows.append((i, "<body>" + markup, re.sub(r" *\n[ \n]*", "\n", shown).strip(" \n")))
    df = spark.createDataFrame(rows, "i int, html string, want string")
    bad = df.select("html", "want", H.main_text("html").alias("got")).filter("got <> want").collect()
    assert bad == []


def test_references_like_the_standard_library(spark):
    rng = random.Random(2)
    names = rng.sample(sorted(stdlib_html.entities.html5), 300)
    refs = ["&" + n for n in names if n.endswith(";")] + [f"&#{rng.randrange(1, 0x10FFFF)};" for _ in range(200)] \
        + [f"&#x{rng.randrange(1, 0x10FFFF):x};" for _ in range(100)]
    rows = [(i, f"<{r}>") for i, r in enumerate(refs)]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: r.d for r in df.select("i", H.decode_references(F.col("t")).alias("d")).collect()}
    for i, t in rows:
        want = stdlib_html.unescape(t).replace("\xa0", " ")
        assert got[i] == want or want == "<>", t  # the library drops controls and non-characters


def test_a_long_page_and_no_python(spark):
    page = "<body>" + "".join(f"<div><nav>n{i}</nav><p>t{i}</p></div>" for i in range(5000)) + "&amp;" * 5000
    df = spark.createDataFrame([(page,)], "html string").select(H.main_text("html").alias("t"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("EvalPython|InPandas|InArrow|ArrowEval", plan)
    lines = df.first().t.split("\n")
    assert lines[:3] == ["t0", "t1", "t2"] and len(lines) == 5001 and lines[-1] == "&" * 5000
