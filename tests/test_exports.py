"""B1-B3, B5, B8 written and read again; sketches, predictors and observed steps against plain computation."""

import json
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from sitelens.operators import corpus as C
from sitelens.operators import labels as L
from sitelens.operators import pages as P
from sitelens.operators import registry as R
from sitelens.sources import exports as EX
from sitelens.sources import files as FS
from sitelens.streaming import resumable as S

COMPANY = "seq long, business_id string, name string, website string, company_form string, status string"


def small_site(spark):
    home = "<html lang=fi><title>Home</title><body><p>Welcome</p><a href=/a>a</a><a href=/gone>g</a></body>"
    pages = spark.createDataFrame([(1, "https://x.fi/", "x.fi", home), (2, "https://x.fi/a", "x.fi", "<html lang=en><body>A page</body>"),
                                   (3, "https://y.fi/", "y.fi", "  ")], "seq long, url string, domain string, html string")
    rows = [(i, f"{i}-1", f"n{i}", "https://x.fi" if i % 2 else "https://y.fi" if i % 4 else "https://z.fi", None, "ok") for i in range(1, 11)]
    companies = spark.createDataFrame(rows, COMPANY)
    return companies, EX.nested_sites(P.site_page_rows(pages), P.site_results(pages))


def test_company_documents(spark, tmp_path):
    companies, sites = small_site(spark)
    docs = EX.company_documents(R.company_site(companies), sites)
    EX.write_company_documents(docs, str(tmp_path / "nested"), {"companies_fetched": 10})
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "nested")).collect())
    assert json.loads(text.split(']} ')[0].rsplit("]}", 1)[0] + "]}")["summary"] == {"companies_fetched": 10}
    got = FS.read_json_records(spark, str(tmp_path / "nested"), EX.COMPANY_DOCUMENT).orderBy("seq").collect()
    assert [r.businessId for r in got] == [f"{i}-1" for i in range(1, 11)]
    x = got[0].site
    assert (x.main_page.title, x.subpage_count, x.error) == ("Home", 2, None) and x.main_page.text.startswith("Welcome")
    assert [(p.url, p.error) for p in x.subpages] == [("https://x.fi/a", None), ("https://x.fi/gone", "download_failed")]
    assert got[1].site.error == "homepage_unreachable" and got[3].site is None and got[0].shared_site is False and got[2].shared_site is True
    EX.write_company_table(docs, str(tmp_path / "flat"))
    flat = {r.businessId: (r.subpage_count, r.languages, r.site_error) for r in
            spark.read.option("header", True).csv(str(tmp_path / "flat")).collect()}
    assert flat["1-1"] == ("2", "en|fi", None) and flat["2-1"][2] == "homepage_unreachable" and flat["4-1"][0] == "0"


def test_site_documents_have_bounded_parts(spark, tmp_path):
    companies, sites = small_site(spark)
    EX.write_site_documents(EX.site_documents(R.manifest(companies), sites, companies=2), str(tmp_path / "sites"))
    got = spark.read.schema(EX.SITE_DOCUMENT).json(str(tmp_path / "sites")).orderBy("seq").collect()
    assert [(r.domain, r.part, r.n_parts) for r in got] == [("x.fi", 0, 3), ("x.fi", 1, 3), ("x.fi", 2, 3), ("y.fi", 0, 2), ("y.fi", 1, 2), ("z.fi", 0, 1)]
    assert [c.businessId for r in got if r.domain == "x.fi" for c in r.companies] == ["1-1", "3-1", "5-1", "7-1", "9-1"]
    assert got[0].main_page.title == "Home" and got[1].main_page is None and got[5].main_page is None


def test_manifest_document(spark, tmp_path):
    """B1: the manifest as {total_scanned, companies}."""
    companies, _ = small_site(spark)
    m = R.manifest(companies)
    out = m.select("seq", F.col("business_id").alias("businessId"), "name", "homepage", "domain")
    FS.write_json_document(out, str(tmp_path / "m"), member="companies", head={"total_scanned": 10})
    text = " ".join(r.value for r in spark.read.text(str(tmp_path / "m")).collect())
    assert text.startswith('{"total_scanned": 10, "companies": [')
    got = FS.read_manifest(spark, str(tmp_path / "m"), "json").collect()
    assert sorted((r.business_id, r.domain) for r in got) == sorted((r.business_id, r.domain) for r in m.collect())


def test_corpus_and_summary_table(spark, tmp_path):
    texts = spark.createDataFrame([("b.fi", "two"), ("a.fi", "one\nline"), ("c.fi", ""), ("d.fi", None)], "domain string, text string")
    EX.write_corpus(texts, str(tmp_path / "corpus"), rows_a_file=1)
    assert sorted(tuple(r) for r in EX.read_corpus(spark, str(tmp_path / "corpus")).collect()) == [("a.fi", "one\nline"), ("b.fi", "two")]
    docs = spark.createDataFrame([(1, "One two."), (2, "Three")], "doc_id int, text string")
    lines = [r.line for r in EX.summary_table(C.text_length_summary(C.text_lengths(docs))).orderBy("line_no").collect()]
    assert lines[0].split() == ["Variable", "Definition", "Mean", "Std", "Min", "Max"] and set(lines[1]) == {"-"}
    assert [x.split()[0] for x in lines[2:]] == list(EX.DEFINITIONS) and len({len(x) for x in lines}) == 1


def test_sketch_ranks_on_heavy_tails(spark):
    rng = random.Random(9)
    values = [int(math.exp(rng.gauss(6, 2.5))) for _ in range(60_000)] + [3] * 5000
    df = spark.createDataFrame([(i % 37, v) for i, v in enumerate(values)], "part int, chars long").repartition(8)
    sketches = C.length_sketches(df, ["part"])
    assert sketches.count() == 37 and max(len(r.sketch) for r in sketches.collect()) < 20_000
    got = C.merged_distribution(sketches, (0.01, 0.25, 0.5, 0.75, 0.99)).first()
    assert (got.files, got.min_chars, got.max_chars) == (len(values), min(values), max(values))
    values.sort()
    for q in (0.01, 0.25, 0.5, 0.75, 0.99):
        v = got[f"q{round(q * 100)}"]
        low, high = sum(x < v for x in values) / len(values), sum(x <= v for x in values) / len(values)
        assert low - 0.0165 <= q <= high + 0.0165
    one = C.merged_distribution(sketches.filter("part = 3"), (0.5,)).first()
    assert one.files == sum(1 for i in range(65_000) if i % 37 == 3)
    none = C.merged_distribution(C.length_sketches(df.limit(0), ["part"])).first()
    assert none.files in (None, 0) and none.q50 is None


def test_predictors_equal_plain_computation(spark):
    rng = random.Random(2)
    rows = [(i % 2 if i % 7 else None, " ".join(rng.choice("alpha beta Gamma delta eps".split() + (["sign"] if i % 2 else ["noise"]))
                                              for _ in range(rng.randint(0, 6)))) for i in range(120)] + [(1, None), (0, "")]
    df = spark.createDataFrame(rows, "label int, text string")
    used = [(y, set(re.split(r"[^\w]+", (t or "").lower())) - {""}) for y, t in rows if y is not None]
    p = sum(y == 1 for y, _ in used)
    q, want = len(used) - p, {}
    for term in set().union(*(t for _, t in used)):
        a, b = sum(term in t for y, t in used if y == 1), sum(term in t for y, t in used if y != 1)
        c, d, n = p - a, q - b, p + q
        cells = ((a, a + b, p), (b, a + b, q), (c, c + d, p), (d, c + d, q))
        want[term] = (a, b, n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * p * q) if c + d else 0.0,
                      sum(k / n * math.log(k * n / (r * s)) for k, r, s in cells if k))
    got = L.predictors(df, top=50).collect()
    assert [r.term for r in got] == sorted(want, key=lambda t: (-round(want[t][2], 6), t))
    for r in got:
        a, b, chi, info = want[r.term]
        assert (r.positive, r.negative) == (a, b) and abs(r.chi2 - chi) < 1e-5 and abs(r.mutual_info - info) < 1e-8
    assert got[0].term in ("sign", "noise") and len(L.predictors(df, top=3).collect()) == 3
    assert {r.chi2 for r in L.predictors(df.filter("label = 1")).collect()} == {0.0}
    assert L.predictors(df.limit(0)).collect() == []


def test_observed_steps_resume(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    counters = {"rows": F.count(F.lit(1)), "low": F.min("id")}
    spark.range(0, 30).coalesce(1).write.option("maxRecordsPerFile", 10).parquet(src)
    taken = []
    take = lambda step, c: taken.append((step, c["rows"]))
    S.observed_steps(spark, src, "id long", counters, ckpt, out, take)
    spark.range(30, 37).coalesce(1).write.mode("append").parquet(src)
    steps = S.observed_steps(spark, src, "id long", counters, ckpt, out, take).orderBy("step").collect()
    assert [(r.step, r["rows"]) for r in steps] == taken == [(0, 10), (1, 10), (2, 10), (3, 7)]
    assert sorted(r.low for r in steps) == [0, 10, 20, 30] and Counter(r.low for r in steps)[30] == 1
    assert spark.read.parquet(f"{out}/rows").count() == 37


def test_observed_steps_share_micro_batches(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    counters = {"rows": F.count(F.lit(1)), "low": F.min("id")}
    taken = []
    run = lambda: S.observed_steps(spark, src, "id long", counters, ckpt, out, lambda k, c: taken.append((k, c["rows"], c["low"])), 4)
    spark.range(0, 90).coalesce(1).write.option("maxRecordsPerFile", 10).parquet(src)
    run()
    spark.range(90, 105).coalesce(1).write.option("maxRecordsPerFile", 10).mode("append").parquet(src)
    steps = [tuple(r) for r in run().orderBy("step").collect()]
    assert steps == taken and [s[0] for s in steps] == list(range(11)) and sorted(s[2] for s in steps) == list(range(0, 105, 10))
    rows = spark.read.parquet(f"{out}/rows")
    assert rows.groupBy("step").agg(F.count("*"), F.min("id")).orderBy("step").collect() == steps
    assert [r.no for r in rows.select("no").distinct().orderBy("no").collect()] == [0, 1, 2, 3]  # not one a file
