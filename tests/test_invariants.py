"""Invariants and brute-force checks for the operators without an SQL oracle
(J8 chunking, G7/G8 numbering and batching, skew-safe ordinals), plus
idempotence of the resume algebra and batch = stream."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitelens.functions import requests as RQ
from sitelens.operators import batches as B
from sitelens.operators import pages as P
from sitelens.operators import registry as R
from sitelens.operators import resume as RS
from sitelens.operators.ordering import global_ordinal, key_ordinal, key_running_total
from sitelens.sources.tables import table


def chunks_by_rule(text, limit):
    """The rule read line by line: full cuts stand alone, other pieces share a chunk while they fit."""
    if len(text) <= limit:
        return [text]
    closed, shared = [], None
    for line in text.split("\n"):
        cuts = [line[k:k + limit] for k in range(0, max(1, len(line)), limit)]
        for k, piece in enumerate(cuts):
            if k < len(cuts) - 1:
                closed += ([] if shared is None else [shared]) + [piece]
                shared = None
            elif shared is not None and len(shared) + 1 + len(piece) <= limit:
                shared += "\n" + piece
            else:
                closed += [] if shared is None else [shared]
                shared = piece
    return closed + ([] if shared is None else [shared])


def test_chunks_match_the_rule(spark, sf_small):
    rnd = random.Random(7)
    texts = ["\n".join("".join(rnd.choice("ab cé") for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(1, 12)))
             for _ in range(300)] + ["", "\n", "\n" * 40, "x" * 50, "x" * 51, "x" * 25]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for n in (3, 17, 25):
        for r in RQ.chunked(df, "text", n).collect():
            chunks = list(r.chunks)
            assert chunks == chunks_by_rule(r.text, n)
            assert all(len(c) <= n for c in chunks)
            if all(len(p) <= n for p in r.text.split("\n")):
                assert "\n".join(chunks) == r.text  # no line was cut: exact reconstruction
    docs = table(spark, sf_small, "documents").select("doc_id", "text")
    for r in RQ.chunked(docs, "text", 3000).collect():
        assert list(r.chunks) == chunks_by_rule(r.text, 3000)


@pytest.fixture(scope="module")
def wide_rows(spark):
    """400,000 rows with a payload over 8 input partitions; one key holds a third of them."""
    i = F.col("id")
    return spark.range(0, 400_000, numPartitions=8).select(
        (i * 7919 % 400_009).alias("seq"), F.when(i % 3 == 0, 0).otherwise(i % 17).cast("int").alias("k"),
        F.md5(i.cast("string")).alias("h"), F.repeat(F.md5(i.cast("string")), 3).alias("payload"))


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_ordinals_equal_row_number_on_wide_rows(spark, wide_rows, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        seq = global_ordinal(wide_rows, ["seq"], "o")
        want = F.row_number().over(Window.orderBy("seq")) - 1
        assert seq.withColumn("w", want).filter("o <> w").count() == 0 and seq.count() == 400_000
        for order in ("seq", "h"):
            per_key = key_ordinal(wide_rows, "k", [order, "seq"], "o")
            want = F.row_number().over(Window.partitionBy("k").orderBy(order, "seq")) - 1
            assert per_key.withColumn("w", want).filter("o <> w").count() == 0
        plan = seq._jdf.queryExecution().toString()
        assert "rangepartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_key_ordinal_keeps_null_keys(spark):
    rows = [(None if i % 3 == 0 else i % 5, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, seq int")
    got = {(r.k, r.seq): r.o for r in key_ordinal(df, "k", "seq", "o", bucket=F.floor(F.col("seq") / 7)).collect()}
    w = Window.partitionBy("k").orderBy("seq")
    assert got == {(r.k, r.seq): r.o for r in df.select("k", "seq", (F.row_number().over(w) - 1).alias("o")).collect()}


def test_running_total_by_buckets(spark):
    rnd = random.Random(5)
    amounts = [rnd.randint(0, 4) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(amounts)), "seq int, n int")
    got = {r.seq: r.t for r in key_running_total(df, "seq", "n", "t", bucket=F.floor(F.col("seq") / 9)).collect()}
    assert [got[i] for i in range(500)] == [sum(amounts[:i]) for i in range(500)]


def serial_next_fit(sizes, max_count, max_size):
    out, batch, count, size = [], -1, 0, 0
    for s in sizes:
        if batch < 0 or count >= max_count or size + s > max_size:
            batch, count, size = batch + 1, 0, 0
        count, size = count + 1, size + s
        out.append(batch)
    return out


@pytest.mark.parametrize("max_count, max_size, block", [(37, 1000, 50), (37, 1000, 1 << 16), (5, 130, 1), (400, 20, 30)])
def test_batch_plan_equals_the_serial_fold(spark, max_count, max_size, block):
    rnd = random.Random(3)
    sizes = [rnd.randint(1, 150) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "ordinal long, size long").repartition(5)
    got = {r.ordinal: r.batch_no for r in B.plan_batches(df, max_count, max_size, block).collect()}
    assert [got[i] for i in range(2000)] == serial_next_fit(sizes, max_count, max_size)
    assert B.plan_batches(df.limit(0), max_count, max_size, block).count() == 0



def test_batch_plan_at_the_default_limits(spark):
    """Full batches never fall in step; no task of the composition holds more than two blocks' passages."""
    rnd = random.Random(5)
    n = 3 * B.BLOCK + 12_345
    sizes = [rnd.choice([100, 5000, 9000, 20_000]) for _ in range(n)]
    df = spark.createDataFrame(pd.DataFrame({"ordinal": range(n), "size": sizes}))
    got = {r.ordinal: r.batch_no for r in B.plan_batches(df).collect()}
    assert [got[i] for i in range(n)] == serial_next_fit(sizes, B.RQ.MAX_PER_BATCH, B.RQ.MAX_BYTES_PER_BATCH)
    counted = spark.createDataFrame(pd.DataFrame({"ordinal": range(n), "size": 1}))
    assert {(r.batch_no, r.n) for r in B.plan_batches(counted).groupBy("batch_no").agg(F.count("*").alias("n")).collect()} == \
        {(k, min(20_000, n - k * 20_000)) for k in range(-(-n // 20_000))}


def test_composed_passages(spark):
    left = pd.DataFrame({"block": 4, "entry": [40, 43], "leave": [50, 53]})
    right = pd.DataFrame({"block": 5, "entry": [50, 52, 53], "leave": [60, 61, 61]})
    got = B._composed(pd.concat([right, left]))
    assert got.values.tolist() == [[2, 40, 60], [2, 43, 61]]
    assert B._composed(left).values.tolist() == [[2, 40, 50], [2, 43, 53]]


def brute_registered(host, rules):
    labels = host.split(".")
    found = []
    for r in rules:
        exception, parts = r.startswith("!"), r.lstrip("!").split(".")
        if len(parts) <= len(labels) and all(p in ("*", x) for p, x in zip(parts[::-1], labels[::-1])):
            found.append((exception, len(parts)))
    if not found:
        return None
    exception, size = max(found)
    size -= exception
    return ".".join(labels[-size - 1:]) if len(labels) > size else None


def test_public_suffix_rules(spark):
    rnd = random.Random(6)
    names = ["a", "b", "uk", "co", "ck", "www", "jp", "kobe"]
    rules = ["uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kobe.jp", "!a.kobe.jp", "b.co.uk"]
    hosts = sorted({".".join(rnd.choice(names) for _ in range(rnd.randint(1, 5))) for _ in range(400)}) + ["10.0.0.1"]
    urls = spark.createDataFrame([(f"https://{h.upper()}:8080/x?{i}", h) for i, h in enumerate(hosts)], "url string, host string")
    listed = spark.createDataFrame([(r,) for r in ["// comment", "", " UK  comment", *rules[1:-1], ".b.co.uk"]], "suffix string")
    for r in R.registered_domain(urls, "url", listed).collect():
        assert r.registered_domain == (brute_registered(r.host, rules) or r.host.removeprefix("www.")), r.host


def test_links_and_companies_by_registered_domain(spark):
    rules = spark.createDataFrame([("fi",), ("co.uk",)], "suffix string")
    page = "<body><a href='http://shop.firma.fi/a'>x</a><a href='http://firma.fi/b'>y</a><a href='http://other.fi/c'>z</a></body>"
    pages = spark.createDataFrame([(1, "http://www.firma.fi/", "firma.fi", page)], "seq long, url string, domain string, html string")
    links = lambda s: sorted(r.url for r in P.first_level_links(P.homepages(pages), pages, suffixes=s).collect())
    assert links(rules) == ["http://firma.fi/b", "http://shop.firma.fi/a"] and links(None) == ["http://firma.fi/b"]
    rows = [(1, "1", "n", "http://shop.firma.fi", None, "r"), (2, "2", "m", "www.firma.fi", None, "r"), (3, "3", "k", "x.co.uk", None, "r")]
    c = spark.createDataFrame(rows, "seq long, business_id string, name string, website string, company_form string, status string")
    for made in (R.manifest(c, rules), R.company_site(c, suffixes=rules)):
        got = sorted((r.seq, r.domain, r.shared_site) for r in made.collect())
        assert got == [(1, "firma.fi", False), (2, "firma.fi", True), (3, "x.co.uk", False)]


def test_resume_idempotent(spark):
    todo = spark.createDataFrame([(f"d{i}", i) for i in range(50)], "domain string, seq long")
    done = spark.createDataFrame([("d1",), ("d2",)], "domain string")
    first = RS.not_done(todo, done)
    done2 = done.unionByName(first.select("domain"))
    assert RS.not_done(todo, done2).count() == 0
