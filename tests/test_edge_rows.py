"""Golden edge rows (FIXTURES.md §4): expected values derived from the reference's semantics."""

from pyspark.sql import functions as F

from sitelens.functions import requests as RQ
from sitelens.functions import text as TX
from sitelens.functions import urls as U
from sitelens.operators import batches as B
from sitelens.operators import labels as L
from sitelens.operators import pages as P
from sitelens.operators import registry as R
from sitelens.sources import files as FS

NAMES_T = "array<struct<name:string,type:string,version:int>>"
FORMS_T = ("array<struct<type:string,version:int,descriptions:array<struct<languageCode:string,"
           "description:string>>>>")


def one(spark, col, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(col).collect()]


def test_primary_name(spark):
    rows = [(1, [("Old", "1", 2), ("Aux", "3", 1), ("Main", "1", 1)]),
            (2, [("Aux", "3", 1)]), (3, [("Past", None, 2)]), (4, [])]
    df = spark.createDataFrame(rows, f"id int, names {NAMES_T}").orderBy("id")
    assert [r[0] for r in df.select(R.primary_name("names")).collect()] == ["Main", "Aux", "Past", ""]


def test_company_form(spark):
    rows = [(1, [("16", 1, [("1", "Oy-fi"), ("3", "Limited")])]), (2, [("16", 1, [("1", "Oy-fi")])]),
            (3, [("16", 1, [("3", None)])]), (4, [])]
    df = spark.createDataFrame(rows, f"id int, forms {FORMS_T}").orderBy("id")
    assert [r[0] for r in df.select(R.company_form("forms")).collect()] == ["Limited", "16", None, None]


def test_homepage_normalise(spark):
    got = one(spark, U.normalise_homepage("w"), [(" www.a.fi ",), ("//a.fi",), ("  ",),
                                                 ("HTTP://A.FI:80/x#frag",), ("http://A.fi:80/p?utm_source=x&q=1",)],
              "w string")
    assert got == ["https://www.a.fi", "https://a.fi", None, "https://http://A.FI:80/x", "http://a.fi/p?q=1"]


def test_depth_and_safe_key(spark):
    assert one(spark, U.url_depth("u"), [("https://a.fi",), ("https://a.fi/x//y/",)], "u string") == [0, 2]
    assert one(spark, TX.safe_key("d"), [("ä.fi/x",)], "d string") == ["_.fi_x"]
    assert one(spark, TX.safe_key("d", 120, "site"), [("",)], "d string") == ["site"]


def test_dedupe_two_orders(spark):
    rows = [(1, "A", "n1", None, None, None), (2, "A", "n2", "a.fi", None, None),
            (3, "B", "n3", "b.fi", None, None), (4, "", "n4", "c.fi", None, None)]
    df = spark.createDataFrame(rows, "seq long, business_id string, name string, website string, "
                                     "company_form string, status string")
    search = R.has_website(R.dedupe_companies(df))
    assert sorted(r.business_id for r in search.collect()) == ["B"]
    bulk = R.manifest(df)
    assert sorted((r.business_id, r.seq) for r in bulk.collect()) == [("A", 2), ("B", 3)]


def test_accessible_urls(spark):
    rows = [("a.fi", "http://a.fi", " TRUE ", "  ", 1), ("b.fi", "http://b.fi", "true", "", 2)]
    df = spark.createDataFrame(rows, "domain string, homepage string, accessible string, final_url string, seq long")
    got = {r.domain: r.url for r in FS.accessible_urls(df).collect()}
    assert got == {"b.fi": "http://b.fi"}


def test_language_filter(spark):
    rows = [(1, "sv", "t", "x", None), (2, None, "t", "x", None), (3, "fi", "t", "x", None)]
    df = spark.createDataFrame(rows, "seq int, language string, title string, text string, error string")
    out = P.language_filter(df, ["fi", "en"]).orderBy("seq").collect()
    assert [r.error for r in out] == ["language_filtered", None, None]
    assert out[0].text is None and out[1].text == "x"


def test_junk_and_counts(spark):
    rows = [("Just a Moment...",), ("x" * 2001 + "just a moment",)]
    assert one(spark, TX.is_junk("t"), rows, "t string") == [True, False]
    lines = one(spark, TX.line_count("t"), [("",), ("a",), ("a\n",), ("a\nb",), ("\n",)], "t string")
    assert lines == [0, 1, 1, 2, 1]
    df = spark.createDataFrame([("äö",)], "t string")
    r = df.select(TX.byte_count("t"), TX.char_count("t")).first()
    assert (r[0], r[1]) == (4, 2)
    words = one(spark, TX.word_count("t"), [("",), (" a b　c ",), ("\x1cx\x1fy",)], "t string")
    assert words == [0, 3, 2]


def test_clean_text(spark):
    got = one(spark, TX.clean_text("t"), [("a<b>c<d",), ("x@y.z-",), ("a@b.-",), ("žÄÖ÷ 12",),
                                          ("see https://x.fi/a and www.b.fi now",)], "t string")
    assert got == ["a c d", "", "a b", "äö", "see and now"]


def test_chunk_rows(spark):
    assert one(spark, RQ.chunk_array("t", 7), [("aaa\nbbb\nccc",)], "t string") == [["aaa\nbbb", "ccc"]]
    assert one(spark, RQ.chunk_array("t", 4), [("abcdefghij",), ("ab\nabcdefgh\nx",), ("abcd\n",)], "t string") == [
        ["abcd", "efgh", "ij"], ["ab", "abcd", "efgh", "x"], ["abcd", ""]]


def test_max_tokens_and_limits(spark):
    assert one(spark, RQ.max_tokens_for_chars("c"), [(100,), (4001,), (12000,), (40000,)], "c int") == \
        [1024, 2000, 6000, 16384]
    df = spark.createDataFrame([("m-old", 0), ("m-old", 500), ("claude-sonnet-4-6", 500)], "m string, b int")
    got = df.select(RQ.thinking_type("m", "b"), RQ.thinking_budget("m", "b"), RQ.verdict_max_tokens("m", "b")).collect()
    assert [tuple(r) for r in got] == [(None, None, 1024), ("enabled", 1024, 2048), ("adaptive", None, 4096)]


def test_verdicts(spark):
    rows = [(1, "succeeded", '{"innovative": true,'), (2, "succeeded", '{"innovative": 1}'),
            (3, "expired", '{"innovative": true}'),
            (4, "succeeded", '{"innovative": false, "confidence": 0.9, "rationale": " a\\nb "}')]
    df = spark.createDataFrame(rows, "doc_id int, result_type string, body string")
    out = {r.doc_id: r for r in B.parse_verdicts(df).collect()}
    assert out[1].status == "parse_error" and out[1].innovative is None
    assert out[2].status == "ok" and out[2].innovative is True and out[2].confidence is None and out[2].rationale == ""
    assert out[3].status == "error"
    assert out[4].innovative is False and out[4].confidence == 0.9 and out[4].rationale == "a b"


def test_reassemble(spark):
    rows = [(1, 0, 2, "succeeded", "x"), (1, 1, 2, "succeeded", "y"),
            (2, 0, 2, "succeeded", "x"), (2, 1, 2, "errored", None),
            (3, 0, 2, "missing", None), (3, 1, 2, "succeeded", "y")]
    df = spark.createDataFrame(rows, "domain_id int, part int, n_parts int, result_type string, text string")
    out = {r.domain_id: r for r in B.reassemble(df).collect()}
    assert (out[1].status, out[1].translated) == ("ok", "x\ny")
    assert out[2].status == "error" and out[3].status == "error"


def test_format_duration(spark):
    got = one(spark, TX.format_duration("s"), [(59.0,), (3600.0,), (-5.0,), (3725.9,)], "s double")
    assert got == ["0:59", "1:00:00", "0:00", "1:02:05"]


def test_next_fit(spark):
    def plan(sizes, count, size):
        df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "ordinal long, size long")
        out = B.plan_batches(df, count, size).orderBy("ordinal").collect()
        return [r.batch_no for r in out]
    assert plan([5, 5, 5], 2, 100) == [0, 0, 1]
    assert plan([60, 60, 150], 100, 100) == [0, 1, 2]


def test_reachability_rules(spark):
    rows = [  # domain, attempt_no, ctx, method, http_status, error_kind
        ("a", 1, "secure", "HEAD", 405, None), ("a", 2, "secure", "GET", 200, None),
        ("b", 1, "secure", "HEAD", 404, None), ("c", 1, "secure", "HEAD", 503, None),
        ("d", 1, "secure", "HEAD", 403, None), ("d", 2, "secure", "GET", 403, None),
        ("e", 1, "secure", "HEAD", None, "dns_error"), ("e", 2, "relaxed", "HEAD", None, "dns_error"),
        ("f", 1, "secure", "HEAD", None, "timeout"), ("f", 2, "relaxed", "HEAD", 200, None)]
    df = spark.createDataFrame(rows, "domain string, attempt_no int, ctx string, method string, "
                                     "http_status int, error_kind string")
    out = {r.domain: (r.accessible, r.reason, r.tls) for r in P.reachability(df).collect()}
    assert out == {"a": (True, "ok", "ok"), "b": (True, "http_404", "ok"), "c": (False, "http_503", "ok"),
                   "d": (True, "http_403", "ok"), "e": (False, "dns_error", "n/a"),
                   "f": (True, "ok", "insecure-retry")}


def test_first_level_links(spark):
    html = ('<html><body><a href="/a">1</a><a href="/a/">2</a><a href="https://a.fi/">3</a>'
            '<a href="http://other.fi/x">4</a><a href="/f.pdf">5</a><a href="#x">6</a>'
            '<a href="mailto:q@a.fi">7</a><a href="/b/c">8</a></body></html>')
    pages = spark.createDataFrame([(1, "https://a.fi", "a.fi", html)], "seq long, url string, domain string, html string")
    links = P.first_level_links(P.homepages(pages), pages, max_subpages=25, max_depth=1).collect()
    assert [r.url for r in links] == ["https://a.fi/a"]


def test_footprint_and_evidence(spark):
    codes = spark.createDataFrame([(1, 1, d, 1 if d <= 3 else 0) for d in range(1, 11)],
                                  "doc_id int, label int, dim int, signalled int")
    assert L.footprint(codes, 3).first().predicted == 1
    assert L.footprint(codes, 4).first().predicted == 0
    ev = spark.createDataFrame([(1, "abc", "O-1d"), (2, "zzz", "O-1d"), (3, "abc", "O-2d")],
                               "doc_id int, quote string, dimension string")
    texts = spark.createDataFrame([(1, "xabcx"), (2, "xabcx"), (3, "abc")], "doc_id int, text string")
    ver = spark.createDataFrame([(1, "ok", True), (2, "ok", True), (3, "ok", False)],
                                "doc_id int, status string, innovative boolean")
    out = {r.doc_id: (r.quote_status, r.consistent) for r in L.evidence_check(ev, texts, ver).collect()}
    assert out == {1: ("valid", True), 2: ("hallucinated", True), 3: ("valid", False)}


def test_verdict_truthiness(spark):
    from sitelens.operators.batches import parse_verdicts
    bodies = {'{"innovative": true}': True, '{"innovative": false}': False, '{"innovative": "false"}': True,
              '{"innovative": ""}': False, '{"innovative": [1]}': True, '{"innovative": []}': False,
              '{"innovative": {}}': False, '{"innovative": {"a": 0}}': True, '{"innovative": 0}': False,
              '{"innovative": 2.5}': True, '{"innovative": null}': False, '{}': False}
    df = spark.createDataFrame(list(enumerate(bodies)), "doc_id int, body string").withColumn("result_type", F.lit("succeeded"))
    got = {r.doc_id: r.innovative for r in parse_verdicts(df).collect()}
    assert [got[i] for i in range(len(bodies))] == list(bodies.values())


def brute_language(train, texts):
    import math
    from collections import Counter

    from sitelens.operators import language as LG

    def grams(t):
        t = (t or "").strip().lower()
        return Counter((sum(ord(c) * f for c, f in zip(t[i:i + n], LG.FACTORS)) + LG.SIZE_FACTOR * n) % LG.BUCKETS
                       for n in (1, 2, 3) for i in range(len(t) - n + 1))

    counts = {}
    for lang, t in train:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(grams(t))
    counts = {k: v for k, v in counts.items() if v}
    seen = set().union(*counts.values())
    for t in texts:
        g = grams((t or "").strip()[:LG.SAMPLE_CHARS])
        score = {x: sum(n * math.log((c[b] + 1) / (sum(c.values()) + LG.BUCKETS)) for b, n in g.items()) for x, c in counts.items()}
        yield min(score, key=lambda x: (-score[x], x)) if seen & set(g) else None


def test_language_labels_equal_brute_force(spark):
    import random
    import re

    from sitelens.operators import language as LG
    rng = random.Random(4)
    vocabulary = {"en": "the cat and dog was here with", "fi": "kissa ja koira talo yö äiti", "xx": "日本 語 \U0001F600 ß"}
    train = [(x, " ".join(rng.choice(w.split()) for _ in range(40))) for x, w in vocabulary.items() for _ in range(5)]
    train += [(None, "qqq zzz"), ("en", None), ("zz", " "), ("en", "")]
    texts = ["The dog", "koira talo", "QQQ ZZZ", None, "", "  ", "ab", "日", "x" * 200 + " the cat", "the " * 3000 + "talo " * 3000, "the dog", "the dog"]
    texts += [" ".join(rng.choice(" ".join(vocabulary.values()).split()) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    model = LG.train(spark.createDataFrame(train, "lang string, text string"))
    out = LG.identify(spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id int, text string"), model)
    got = sorted((r.doc_id, r.lang_id or "") for r in out.collect())  # ids repeat, rows stay apart
    assert got == sorted((i // 2, x or "") for i, x in enumerate(brute_language(train, texts)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("EvalPython|InPandas|InArrow|ArrowEval", plan)
    none = LG.train(spark.createDataFrame([], "lang string, text string"))
    assert [r.lang_id for r in LG.identify(spark.createDataFrame([(1, "a")], "doc_id int, text string"), none).collect()] == [None]


def test_shared_folder_is_never_machine_local_on_a_cluster():
    import pytest

    from sitelens.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_html_attributes_in_any_quotes(spark):
    from sitelens.functions import html as H
    page = ("<html lang='fi'><body><a href='/a'>x</a><A class=k HREF = /b>y</A><a href=\"/c\">z</a>"
            "<div id=1 class='top ad big'>no</div><div class=\"adventure\">yes &auml;&amp;</div></body>")
    df = spark.createDataFrame([(page,)], "h string")
    r = df.select(H.language("h").alias("l"), H.links("h").alias("a"), H.main_text("h").alias("t")).first()
    assert r.l == "fi" and r.a == ["/a", "/b", "/c"] and r.t.split() == ["xyz", "yes", "ä&"]


def test_links_resolve_dot_segments(spark):
    from sitelens.functions import urls as U
    base = "http://h.fi/a/b/c?x"
    want = {"../d": "http://h.fi/a/d", "./e": "http://h.fi/a/b/e", "/x/../y?q=/../": "http://h.fi/y?q=/../", "../../../z": "http://h.fi/z",
            "..": "http://h.fi/a/", ".": "http://h.fi/a/b/", "f.html": "http://h.fi/a/b/f.html", "/.well": "http://h.fi/.well"}
    df = spark.createDataFrame([(k,) for k in want], "href string")
    got = {r.href: r.u for r in df.select("href", U.resolve_link(F.col("href"), F.lit(base)).alias("u")).collect()}
    assert got == want


def test_request_params_are_whole_bodies(spark):
    import json

    df = spark.createDataFrame([("m-old", 500, "a \"b\"\n}"), ("claude-sonnet-4-6", 500, "x"), ("m-old", 0, "é}")], "m string, b int, t string")
    p = RQ.request_params("m", RQ.verdict_max_tokens("m", "b"), "be kind", "t", RQ.verdict_output_config(),
                          RQ.thinking_type("m", "b"), RQ.thinking_budget("m", "b"))
    got = [json.loads(r.p) for r in df.select(p.alias("p")).collect()]
    assert [g.get("thinking") for g in got] == [{"type": "enabled", "budget_tokens": 1024}, {"type": "adaptive"}, None]
    assert [g["messages"] for g in got] == [[{"role": "user", "content": t}] for t in ("a \"b\"\n}", "x", "é}")]
    assert all(g["system"] == "be kind" and g["output_config"]["format"]["schema"] == RQ.VERDICT_SCHEMA for g in got)
    assert [g["max_tokens"] for g in got] == [2048, 4096, 1024]


def test_clean_text_equals_its_steps(spark):
    """The cleaning in one pass equals the steps of J1, and lengths are those of the cleaned text."""
    import random

    from sitelens.operators import corpus as C
    rng = random.Random(7)
    bits = list("abcàöøÿ÷ž @.-+_<>1,\n\t\r\x1c\x85\xa0 　 Aé") + ["https://x", "www.", "@b.c", "a@b", "http", "  ", " \U0001F600"]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randint(0, 60))),) for _ in range(4000)]
    rows += [(None,), ("",), (" " * 300,), ("a" + "\n" * 23 + "b ",), (" a" + "\n" * 22 + "b",), ("a@b.c-+x@e.f",)]
    df = spark.createDataFrame(rows, "t string")
    steps = F.lower("t")
    for pat, rep in TX.CLEAN_STEPS:
        steps = F.regexp_replace(steps, pat, rep)
    stripped = F.length(F.regexp_replace("t", f"^{TX.WS}+|{TX.WS}+$", ""))
    lengths = C.text_lengths(df, "t", "t").select(F.col("t").alias("k"), "Words_clean").distinct()
    got = df.join(lengths, F.col("t").eqNullSafe(F.col("k"))).select(
        TX.clean_text("t"), steps, "Words_clean", TX.word_count(steps), F.length(TX.trim_ws("t")), stripped,
        TX.is_short("t", 25), stripped < 25, TX.is_short("t", 1), stripped < 1).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r[0::2] == r[1::2]
    plan = df.select(TX.clean_text("t"), TX.language_label("t", F.lit("en")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2 * 4  # three guarded steps and one for all the others, and their names


def test_language_of_common_and_rare_substrings(spark):
    """A language is the same whether substrings are looked up whole or bucket by bucket."""
    import random

    from sitelens.operators import language as LG
    rng = random.Random(9)
    train = [(x, "".join(rng.choice(w) for _ in range(rng.randint(1, 400)))) for x, w in (("a", "abc d"), ("b", "abé e"), ("c", "日本b ")) for _ in range(8)]
    texts = ["", None, "q", "d", "日", "é\U0001F600"] + ["".join(rng.choice("abcdeé日本 q") for _ in range(rng.randint(1, 40))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = [x or "" for x in brute_language(train, texts)]
    for common in (0, 5, LG.COMMON):
        model = LG.train(spark.createDataFrame(train, "lang string, text string"), common=common)
        assert model.common.count() <= common
        got = {r.doc_id: r.lang_id or "" for r in LG.identify(docs, model).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_forest_rows_are_dealt_out_by_their_dense_size(spark, monkeypatch):
    """The forest holds dense rows: its partitions grow in number with documents times features."""
    from pyspark.ml.classification import RandomForestClassifier
    parts, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df: parts.append(df.rdd.getNumPartitions()) or fit(self, df))
    rows = spark.createDataFrame([(i, f"w{i % 7} x{i % 3} y", i % 2) for i in range(60)], "doc_id int, text string, label int").coalesce(1)
    L.train_forest(rows, vocab_size=50, min_df=1.0, trees=2)
    monkeypatch.setattr(L, "FOREST_CELLS", 500)
    model = L.train_forest(rows, vocab_size=50, min_df=1.0, trees=2)
    assert parts == [1, 6] and model.transform(rows).count() == 60 and set(model.stages[1].vocabulary) >= {"y", "w0"}
