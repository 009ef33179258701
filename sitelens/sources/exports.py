"""Nested exports (B2, B3), the text corpus (B5) and the formatted summary.

Everything is a row of a distributed table first; a document is written per part
file, never per row.  The pages of a site are bounded (the home page and at most
``max_subpages`` links), so a site is one nested value.  Its companies are not: a
site document takes at most :data:`COMPANIES` of them and a site with more has more
documents, so no row grows with the register.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators.ordering import key_ordinal
from sitelens.sources.files import write_json_document

#: Companies of one site document.
COMPANIES = 1000

#: What the summary's variables mean.
DEFINITIONS = {
    "Char_clean": "Number of characters after text cleaning",
    "Words_clean": "Number of words after text cleaning",
    "Tokens": "Numeric representations of characters",
}

PAGE = "STRUCT<url:STRING,title:STRING,language:STRING,text:STRING,error:STRING>"
SITE = f"homepage STRING, error STRING, main_page {PAGE}, subpages ARRAY<{PAGE}>, subpage_count INT"
COMPANY = "businessId:STRING,name:STRING,companyForm:STRING,status:STRING,homepage:STRING"
COMPANY_DOCUMENT = ("seq BIGINT, businessId STRING, name STRING, companyForm STRING, status STRING, homepage STRING, domain STRING, "
                    f"shared_site BOOLEAN, site STRUCT<{SITE}>")
SITE_DOCUMENT = f"seq BIGINT, domain STRING, part INT, n_parts INT, companies ARRAY<STRUCT<{COMPANY}>>, {SITE}"


def _company(name: Column | str = "business_id") -> Column:
    return F.struct(F.col("business_id").alias("businessId"), "name", F.col("company_form").alias("companyForm"), "status", "homepage")


def nested_sites(page_rows: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row a site from its page rows (``operators.pages.site_page_rows``): ``domain`` and the
    fields of a site.  ``errors``: (domain, site_error)."""
    page = F.struct("url", "title", "language", "text", "error")
    g = page_rows.groupBy("domain").agg(
        F.max(F.when(F.col("page_no") == 0, F.struct(F.col("url").alias("homepage"), page.alias("main_page")))).alias("m"),
        F.array_sort(F.collect_list(F.when(F.col("page_no") > 0, F.struct("page_no", page.alias("page"))))).alias("s"))
    out = g.select("domain", F.col("m.homepage").alias("homepage"), F.col("m.main_page").alias("main_page"),
                   F.col("s.page").alias("subpages"), F.size("s").alias("subpage_count"))
    if errors is None:
        out = out.withColumn("error", F.lit(None).cast("string"))
    else:
        out = out.join(errors.select("domain", F.nullif("site_error", F.lit("")).alias("error")), "domain", "left")
    return out.select("domain", "homepage", "error", "main_page", "subpages", "subpage_count")


def company_documents(company_sites: DataFrame, sites: DataFrame) -> DataFrame:
    """B2: every company in output order with its site nested (null if it was not visited)."""
    site = F.struct(*[c for c in sites.columns if c != "domain"])
    nested = sites.select(F.col("domain").alias("_domain"), site.alias("site"))
    out = company_sites.join(nested, F.col("domain") == F.col("_domain"), "left")
    return out.select("seq", F.col("business_id").alias("businessId"), "name", F.col("company_form").alias("companyForm"), "status",
                      "homepage", "domain", "shared_site", "site")


def write_company_documents(documents: DataFrame, path: str, summary: dict) -> None:
    """B2: ``{"summary": ..., "companies": [...]}``, one line a file, in order of ``seq``."""
    write_json_document(documents, path, member="companies", head={"summary": summary})


def write_company_table(documents: DataFrame, path: str) -> None:
    """B2's flat CSV: one line a company, the distinct languages of its site's pages joined with ``|``."""
    languages = F.array_distinct(F.concat(F.array("site.main_page.language"), F.coalesce("site.subpages.language", F.array().cast("array<string>"))))
    flat = documents.select(
        "businessId", "name", "companyForm", "homepage", "domain", F.coalesce("site.subpage_count", F.lit(0)).alias("subpage_count"),
        F.array_join(F.array_sort(F.filter(languages, lambda x: x.isNotNull())), "|").alias("languages"),
        F.coalesce("site.error", F.lit("")).alias("site_error"))
    flat.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def site_documents(manifest: DataFrame, sites: DataFrame, companies: int = COMPANIES) -> DataFrame:
    """The document of each site in order of first appearance: its companies (in register order,
    ``companies`` a document) and, in the first of its documents, its pages."""
    per = manifest.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    placed = key_ordinal(manifest.select("domain", "seq", "business_id", "name", "company_form", "status", "homepage"), "domain", "seq", "no")
    parts = placed.withColumn("part", F.floor(F.col("no") / companies).cast("int")).groupBy("domain", "part").agg(
        F.array_sort(F.collect_list(F.struct("no", _company().alias("c"))))["c"].alias("companies"))
    out = parts.join(per, "domain").select(
        "domain", "part", F.ceil(F.col("n") / companies).cast("int").alias("n_parts"), "companies", "first")
    fields = [c for c in sites.columns if c != "domain"]
    out = out.join(sites, "domain", "left")
    shown = [F.when(F.col("part") == 0, F.col(c)).alias(c) for c in fields]
    return out.select((F.col("first") * F.lit(1 << 20) + F.col("part")).alias("seq"), "domain", "part", "n_parts", "companies", *shown)


def write_site_documents(documents: DataFrame, path: str) -> None:
    """B3 as JSON lines, clustered by site."""
    documents.repartitionByRange("seq").sortWithinPartitions("seq").write.mode("overwrite").json(path)


def write_corpus(texts: DataFrame, path: str, rows_a_file: int = 50_000) -> None:
    """``(domain, text)`` of every non-empty text, clustered by domain."""
    kept = texts.filter(F.length("text") > 0).select("domain", "text")
    kept.repartitionByRange("domain").sortWithinPartitions("domain").write.mode("overwrite").option(
        "maxRecordsPerFile", rows_a_file).parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("domain STRING, text STRING").parquet(path)


def summary_table(summary: DataFrame) -> DataFrame:
    """``(line_no, line)`` of the table of text lengths: a header, a rule and a line a variable."""
    head = "%-12s %-42s %8s %8s %6s %8s" % ("Variable", "Definition", "Mean", "Std", "Min", "Max")
    names = F.array(*[F.lit(v) for v in DEFINITIONS])
    means = F.create_map(*[F.lit(x) for kv in DEFINITIONS.items() for x in kv])
    line = F.format_string("%-12s %-42s %8s %8s %6s %8s", "variable", means[F.col("variable")],
                           *[F.format_string("%.0f", F.coalesce(c, F.lit(float("nan")))) for c in ("mean", "std")],
                           F.col("min").cast("string"), F.col("max").cast("string"))
    rows = summary.select((F.array_position(names, F.col("variable")) + 1).cast("int").alias("line_no"), line.alias("line"))
    top = summary.sparkSession.createDataFrame([(0, head), (1, "-" * len(head))], "line_no int, line string")
    return top.unionByName(rows)
