"""Reports and run summaries.

Each summary is one aggregate over ids/flags; joins between stages are on
``domain`` and only carry narrow columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators.ordering import first_per_key, global_ordinal


def companies_accessible(manifest: DataFrame, reach: DataFrame) -> DataFrame:
    """Every manifest company with its domain verdict (true only when the
    domain's verdict is true)."""
    j = manifest.select("business_id", "domain").join(reach.select("domain", "accessible"), "domain", "left")
    return j.select("business_id", "domain", F.coalesce("accessible", F.lit(False)).alias("accessible"))


def accessibility_summary(manifest: DataFrame, reach: DataFrame) -> DataFrame:
    """companies, unique domains, checked this run, accessible domains (over
    all recorded verdicts), recorded, companies with an accessible site.

    Two aggregates: one over the companies (left-joined to their verdict), one
    over the recorded verdicts (flagged when the manifest has the domain); the
    second enters as a single scalar struct subquery.
    """
    rec = reach.select("domain", "accessible")
    listed = manifest.select("domain").distinct().withColumn("_listed", F.lit(True))
    r = rec.join(listed, "domain", "left").agg(
        F.count_if(F.col("_listed").isNotNull()).cast("bigint").alias("checked"),
        F.count_if(F.col("accessible")).cast("bigint").alias("acc"),
        F.count(F.lit(1)).cast("bigint").alias("recorded"))
    verdicts = r.select(F.struct("checked", "acc", "recorded")).scalar()
    m = manifest.select("domain").join(rec, "domain", "left").agg(
        F.count(F.lit(1)).cast("bigint").alias("companies_in_manifest"),
        F.countDistinct("domain").cast("bigint").alias("unique_domains"),
        F.count_if(F.coalesce(F.col("accessible"), F.lit(False))).cast("bigint").alias("companies_with_accessible_site"))
    return m.select("companies_in_manifest", "unique_domains",
                    verdicts.getField("checked").alias("domains_checked_this_run"),
                    verdicts.getField("acc").alias("domains_accessible"),
                    verdicts.getField("recorded").alias("domains_total_recorded"),
                    "companies_with_accessible_site")


def orphan_domains(scraped: DataFrame, manifest: DataFrame) -> DataFrame:
    """Successfully scraped domains that no company points to."""
    return scraped.filter("ok").select("domain").join(manifest.select("domain"), "domain", "left_anti")


def domain_funnel(manifest: DataFrame, reach: DataFrame, scraped: DataFrame) -> DataFrame:
    """company rows -> unique domains -> reachable -> attempted -> scraped,
    plus unreachable and reachable-not-scraped, with shares of unique domains."""
    u = manifest.select("domain").distinct()
    st = (u.join(reach.select("domain", "accessible"), "domain", "left")
           .join(scraped.select("domain", F.col("ok").alias("_ok"), F.lit(True).alias("_att")), "domain", "left"))
    reachable = F.coalesce(F.col("accessible"), F.lit(False))
    c = st.agg(F.count(F.lit(1)).cast("bigint").alias("uniq"),
               F.count_if(reachable).cast("bigint").alias("reachable"),
               F.count_if(F.coalesce(F.col("_att"), F.lit(False))).cast("bigint").alias("attempted"),
               F.count_if(F.coalesce(F.col("_ok"), F.lit(False))).cast("bigint").alias("scraped"))
    companies = manifest.select(F.count(F.lit(1)).cast("bigint")).scalar()
    stages = F.array(
        F.struct(F.lit("company_rows").alias("stage"), companies.alias("n")),
        F.struct(F.lit("unique_domains").alias("stage"), F.col("uniq").alias("n")),
        F.struct(F.lit("reachable").alias("stage"), F.col("reachable").alias("n")),
        F.struct(F.lit("attempted").alias("stage"), F.col("attempted").alias("n")),
        F.struct(F.lit("scraped_ok").alias("stage"), F.col("scraped").alias("n")),
        F.struct(F.lit("unreachable").alias("stage"), (F.col("uniq") - F.col("reachable")).alias("n")),
        F.struct(F.lit("reachable_not_scraped").alias("stage"),
                 (F.col("reachable") - F.col("scraped")).alias("n")))
    x = c.select("uniq", F.explode(stages).alias("s"))
    return x.select("s.stage", "s.n", F.round(F.try_divide(F.lit(100.0) * F.col("s.n"),
                                                           F.col("uniq").cast("double")), 2).alias("pct"))


def crawl_batch(manifest: DataFrame, offset: int, limit: int, existing: DataFrame | None = None) -> DataFrame:
    """M5 + H2 + E1: unique sites (first company per domain), ordered by first
    appearance, ``offset``/``limit`` window by row number (limit 0: all the rest,
    spread over tasks), existing outputs skipped unless overwritten."""
    sites = first_per_key(manifest.select("domain", "seq", "homepage", "business_id"), "domain", "seq")
    no = F.col("_no")
    batch = global_ordinal(sites, "seq", "_no").filter((no >= offset) & ((no < offset + limit) if limit else F.lit(True)))
    action = F.lit("crawl")
    if existing is not None:
        batch = batch.join(existing.select("domain", F.lit(True).alias("_exists")), "domain", "left")
        action = F.when(F.col("_exists"), F.lit("skipped")).otherwise(F.lit("crawl"))
    return batch.select("domain", "homepage", F.col("business_id").alias("first_business_id"),
                        action.alias("action"))


def crawl_summary(manifest: DataFrame, batch: DataFrame) -> DataFrame:
    """unique sites in total, in this batch, crawled, skipped, failed."""
    total = manifest.select(F.countDistinct("domain").cast("bigint")).scalar()
    return batch.agg(
        F.count(F.lit(1)).cast("bigint").alias("in_this_batch"),
        F.count_if(F.col("action") == "crawl").cast("bigint").alias("crawled"),
        F.count_if(F.col("action") == "skipped").cast("bigint").alias("skipped_existing"),
        F.count_if(F.col("action") == "failed").cast("bigint").alias("failed")).select(
        total.alias("unique_sites_total"), "in_this_batch", "crawled", "skipped_existing", "failed")


def normalised_reason(reason) -> "F.Column":
    """A browser ``ERR_*`` code when present, else the whole reason."""
    r = F.col(reason) if isinstance(reason, str) else reason
    code = F.regexp_extract(r, r"ERR_[A-Z0-9_]+", 0)
    return F.coalesce(F.nullif(code, F.lit("")), r)


def failure_breakdown(index: DataFrame) -> DataFrame:
    """failed scrape rows by normalised reason, most frequent first."""
    from sitelens.functions.text import text_true
    f = index.filter(~text_true("ok"))
    return (f.groupBy(normalised_reason("reason").alias("reason"))
             .agg(F.count(F.lit(1)).cast("bigint").alias("n")).orderBy(F.desc("n"), "reason"))
