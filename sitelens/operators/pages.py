"""Captured-page operators.

The reference fetches pages and probes hosts over the network; here pages and
probe attempts are tables, so every operator is DataFrame work keyed by
``domain``.  HTML is only touched by native regex expressions, and the wide
``html`` column is dropped before any shuffle (only ids, urls and short
strings are grouped).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import html as H
from sitelens.functions import urls as U
from sitelens.functions.bind import let
from sitelens.functions.text import contains_any, is_blank, is_junk
from sitelens.operators.ordering import first_per_key
from sitelens.operators.registry import registered_domain

MAX_SUBPAGES = 25
MAX_DEPTH = 0


def extract_pages(pages: DataFrame, key: str = "seq") -> DataFrame:
    """M2: title, language, main text; empty text -> ``error='extraction_failed'``."""
    x = pages.select(key, "url", "domain", H.title("html").alias("title"),
                     H.language("html").alias("language"), H.main_text("html").alias("text"))
    failed = F.coalesce(F.col("text"), F.lit("")) == ""
    return x.withColumn("error", F.when(failed, F.lit("extraction_failed")))


def language_filter(extracted: DataFrame, languages) -> DataFrame:
    """Drop a page only when a list is given, its language is known and not
    in the list: ``error='language_filtered'`` with null title and text."""
    if not languages:
        return extracted
    out = F.col("language").isNotNull() & ~F.col("language").isin(*languages)
    return (extracted
            .withColumn("title", F.when(out, F.lit(None).cast("string")).otherwise(F.col("title")))
            .withColumn("text", F.when(out, F.lit(None).cast("string")).otherwise(F.col("text")))
            .withColumn("error", F.when(out, F.lit("language_filtered")).otherwise(F.col("error"))))


# Fixed values of our D11 quality rule: markers of error and placeholder pages,
# looked up in the lower-cased title and text.
ERROR_PAGE_MARKERS = ("page not found", "404 not found", "service unavailable", "503 service",
                      "domain is for sale", "this domain may be for sale", "parked free",
                      "website coming soon", "under construction")


def quality_filter(extracted: DataFrame) -> DataFrame:
    """Keep pages that extracted, are not interstitials (D7) and are not
    error/parked placeholders (title and whole text are looked through)."""
    def keep(p):
        shown = F.lower(F.concat_ws(" ", p["title"], p["text"]))
        return (p["error"].isNull() & ~contains_any(shown, ERROR_PAGE_MARKERS)
                & ~is_junk(F.coalesce(p["text"], F.lit(""))))
    # bound once: the extracted text is not re-derived for every marker
    return extracted.filter(let(F.struct("title", "text", "error"), keep))


def homepages(pages: DataFrame) -> DataFrame:
    """G1: the first captured page per domain is the site's homepage."""
    return first_per_key(pages.select("domain", "seq", "url"), "domain", "seq")


def first_level_links(home: DataFrame, pages_html: DataFrame, max_subpages: int = MAX_SUBPAGES,
                      max_depth: int = MAX_DEPTH, suffixes: DataFrame | None = None) -> DataFrame:
    """M1 + D9 + C8 + G6: same-site links of each homepage in document order,
    resolved and cleaned, assets and the home page itself dropped, optional depth
    limit, canonical (no trailing ``/``) de-dup keeping the first stored form,
    first ``max_subpages``.  ``suffixes``: a link is on the same site if its registered
    domain by these public-suffix rules is the home page's (default: the host rule).

    All per-page work stays inside the page's own row group: the explode and the
    de-dup are keyed by (domain, canonical), the cap by domain over at most one
    page's links.
    """
    # only the links of a page go through the join, not its html
    h = home.join(pages_html.select("seq", H.links("html").alias("hrefs")), "seq")
    x = h.select("domain", F.col("url").alias("home_url"), F.posexplode("hrefs").alias("pos", "href"))
    # staged columns: each step is referenced several times by the next, so
    # Catalyst keeps them as separate projections instead of inlining copies
    x = x.withColumn("_res", U.resolve_link(F.col("href"), F.col("home_url"))).filter(F.col("_res").isNotNull())
    x = x.withColumn("link", U.clean_url(F.col("_res")))

    def keep(v):
        link, home = v["link"], v["home"]
        canon = U.canonical(link)
        ok = ~U.is_asset(link) & (canon != F.lit("")) & (canon != U.canonical(U.clean_url(home)))
        if suffixes is None:
            ok = ok & (U.site_key(link) == U.site_key(home))
        if max_depth and max_depth > 0:
            ok = ok & (U.url_depth(link) <= max_depth)
        return ok
    # one predicate over a bound (link, home) pair: the link expression is not copied per use
    x = x.filter(let(F.struct(F.col("link").alias("link"), F.col("home_url").alias("home")), keep))
    if suffixes is not None:
        x = registered_domain(registered_domain(x, "link", suffixes, "_site"), "home_url", suffixes, "_home_site")
        x = x.filter("_site = _home_site")
    x = x.withColumn("canon", U.canonical(F.col("link")))
    firsts = x.groupBy("domain", "canon").agg(F.min_by("link", "pos").alias("url"), F.min("pos").alias("pos"))
    capped = firsts.groupBy("domain").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("pos", "url"))), 1, max_subpages).alias("links"))
    return capped.select("domain", F.posexplode("links").alias("link_no", "l")).select(
        "domain", F.col("link_no").cast("int").alias("link_no"), F.col("l.url").alias("url"))


def site_page_rows(pages: DataFrame, languages=None, max_subpages: int = MAX_SUBPAGES,
                   max_depth: int = MAX_DEPTH) -> DataFrame:
    """M4: one row per page of a site's result: the homepage (``page_no`` 0) and
    its first-level subpages in link order, each with title, language, text and
    error (a link without a captured page: ``download_failed``; D6 applied to
    subpages only).

    Which pages belong to a site is decided on ids and urls; title and text join
    once at the end and go through no aggregate.
    """
    home = homepages(pages)
    links = first_level_links(home, pages, max_subpages, max_depth)
    # a captured page answers a link when its cleaned canonical url is equal
    captured = (pages.select(U.canonical(U.clean_url(F.col("url"))).alias("canon"), "seq")
                     .groupBy("canon").agg(F.min("seq").alias("seq")))
    subs = links.withColumn("canon", U.canonical(F.col("url"))).join(captured, "canon", "left").select(
        "domain", (F.col("link_no") + 1).alias("page_no"), "url", "seq")
    rows = home.select("domain", F.lit(0).alias("page_no"), "url", "seq").unionByName(subs)
    out = rows.join(extract_pages(pages.select("seq", "url", "domain", "html")).drop("url", "domain"), "seq", "left")
    out = out.withColumn("error", F.when(F.col("seq").isNull(), F.lit("download_failed")).otherwise(F.col("error")))
    if languages:
        sub = language_filter(out.filter("page_no > 0"), languages)
        out = out.filter("page_no = 0").unionByName(sub.select(*out.columns))
    return out.select("domain", "page_no", "url", "seq", "title", "language", "text", "error")


def site_results(pages: DataFrame, languages=None, max_subpages: int = MAX_SUBPAGES,
                 max_depth: int = MAX_DEPTH) -> DataFrame:
    """M4 + F14 + I3 + J15: one row per site: homepage, main page, subpage counts,
    sorted distinct languages joined with ``|``; a blank homepage capture is
    ``homepage_unreachable``.  The texts are in :func:`site_page_rows`."""
    rows = site_page_rows(pages, languages, max_subpages, max_depth).select(
        "domain", "page_no", "url", "seq", "title", "language", F.length("text").cast("bigint").alias("chars"), "error")
    main = F.struct("url", "seq", "title", "language", "chars", "error")
    g = rows.groupBy("domain").agg(
        F.max(F.when(F.col("page_no") == 0, main)).alias("m"),
        F.count_if(F.col("page_no") > 0).cast("int").alias("subpage_count"),
        F.count_if((F.col("page_no") > 0) & F.col("error").isNotNull()).cast("int").alias("failed_subpages"),
        F.array_join(F.array_sort(F.collect_set("language")), "|").alias("languages"))
    blank = pages.filter(is_blank("html")).select("seq", F.lit("homepage_unreachable").alias("_gone"))
    out = g.withColumn("seq", F.col("m.seq")).join(blank, "seq", "left")
    return out.select("domain", F.col("m.url").alias("homepage"), F.col("m.title").alias("main_title"),
                      F.col("m.language").alias("main_language"), F.col("m.chars").alias("main_chars"),
                      F.col("m.error").alias("main_error"), "subpage_count", "failed_subpages", "languages",
                      F.coalesce("_gone", F.lit("")).alias("site_error"))


# ---- M6 reachability from a probe log ------------------------------------------

DEFERRED_HEAD = (403, 405, 406, 501)


def failure_reason(kind: Column, message: Column | None = None) -> Column:
    """Reason taxonomy from an error kind and message."""
    msg = F.substring(F.coalesce(message, F.lit("")), 1, 40) if message is not None else F.lit("")
    return (F.when(kind.isin("timeout", "dns_error", "tls_error", "connection_error"), kind)
            .when(kind == "url_error", F.concat(F.lit("url_error:"), msg))
            .otherwise(F.concat(kind, F.lit(":"), msg)))


def reachability(probes: DataFrame, homepages_df: DataFrame | None = None) -> DataFrame:
    """M6: one verdict per domain from its attempts (HEAD, then GET when HEAD got
    403/405/406/501; one relaxed retry after an error).

    decisive = first attempt (by ``attempt_no``) with a status that is not a
    deferred HEAD: accessible = status < 500, reason ``ok`` below 400 else
    ``http_<status>``, tls ``ok`` (secure) or ``insecure-retry`` (relaxed).
    Without one the domain failed: reason of the first error, or of the last
    error when the first was a TLS error (quirk q2 kept); tls ``n/a``.
    ``message``, if the log has one, goes into the reasons that show it (J12).
    A single ``groupBy(domain)`` with partial ``min_by``/``max_by``.
    """
    st = F.col("http_status")
    decisive = st.isNotNull() & ~((F.col("method") == "HEAD") & st.isin(*DEFERRED_HEAD))
    err = F.col("error_kind").isNotNull()
    message = F.col("message") if "message" in probes.columns else F.lit(None).cast("string")
    p = probes.withColumn("_d", decisive).withColumn("_e", err).withColumn("_err", F.struct(F.col("error_kind").alias("k"), message.alias("m")))
    big = F.lit(1 << 30)
    g = p.groupBy("domain").agg(
        F.min_by(F.struct("http_status", "ctx"), F.when(F.col("_d"), F.col("attempt_no")).otherwise(big)
                 ).alias("dec"),
        F.max(F.col("_d").cast("int")).alias("has_dec"),
        F.min_by("_err", F.when(F.col("_e"), F.col("attempt_no")).otherwise(big)).alias("first_err"),
        F.max_by("_err", F.when(F.col("_e"), F.col("attempt_no")).otherwise(-big)).alias("last_err"))
    ok = F.col("has_dec") == 1
    status = F.when(ok, F.col("dec.http_status"))
    shown = F.when(F.col("first_err.k") == "tls_error", F.col("last_err")).otherwise(F.col("first_err"))
    kind = shown["k"]
    reason = (F.when(ok & (status < 400), F.lit("ok"))
              .when(ok, F.concat(F.lit("http_"), status.cast("string")))
              .when(kind.isNotNull(), failure_reason(kind, shown["m"]))
              .otherwise(F.lit("no_response")))
    tls = (F.when(ok & (F.col("dec.ctx") == "secure"), F.lit("ok")).when(ok, F.lit("insecure-retry"))
           .otherwise(F.lit("n/a")))
    out = g.select("domain", F.coalesce(ok & (status < 500), F.lit(False)).alias("accessible"),
                   status.cast("int").alias("status"), reason.alias("reason"), tls.alias("tls"))
    if homepages_df is not None:
        out = out.join(homepages_df.select("domain", F.col("url").alias("homepage")), "domain", "left")
        out = out.withColumn("final_url", F.when(F.col("status").isNotNull(), F.col("homepage")))
    return out


def scrape_index(pages: DataFrame, reach: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """M3 + D12: main-page text per reachable domain with its outcome.

    ``cached`` (domain, chars) marks domains whose text already exists: they
    are reported ``cached`` with the stored size (bytes, quirk q7) and not
    extracted again (E1).
    """
    home = homepages(pages)
    todo = reach.filter(F.col("accessible")).select("domain", F.coalesce("final_url", "homepage").alias("url"))
    if cached is not None:
        hit = todo.join(cached, "domain").select(
            "domain", "url", F.col("url").alias("final_url"), F.lit(True).alias("ok"),
            F.col("chars").cast("bigint").alias("chars"), F.lit("cached").alias("reason"))
        todo = todo.join(cached, "domain", "left_anti")
    # the text stays with its page: only its size goes through the join
    size = let(H.main_text("html"), lambda t: F.when(is_blank(t), F.lit(0)).otherwise(F.length(t)))
    ex = pages.select("seq", size.cast("bigint").alias("chars"))
    main = todo.join(home.select("domain", "seq", F.col("url").alias("final_url")), "domain").join(ex, "seq")
    empty = F.col("chars") == 0
    out = main.select("domain", "url", "final_url", (~empty).alias("ok"), "chars",
                      F.when(empty, F.lit("empty_extract")).otherwise(F.lit("ok")).alias("reason"))
    if cached is not None:
        out = out.unionByName(hit)
    return out
