"""Scale checks on physical plans: pruning and pushdown reach the scan, and no
operator funnels data through a single partition before its final aggregate."""

from sitelens.plans.catalog import QUERIES, load_all


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_column_pruning_and_pushdown(spark, sf_small):
    load_all()
    plan = _plan(QUERIES["junk_pages"](spark, sf_small))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
    plan = _plan(QUERIES["manifest"](spark, sf_small))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan  # html never read for the manifest


def _single_partition_inputs(plan: str):
    """The operator feeding each ``Exchange SinglePartition`` of a plan."""
    lines = plan.splitlines()
    return [lines[i + 1] if i + 1 < len(lines) else "" for i, ln in enumerate(lines)
            if "Exchange SinglePartition" in ln]


def test_single_partition_only_after_aggregation(spark, sf_small):
    """A single-partition exchange may only carry pre-aggregated rows (partial
    counts of a global aggregate, one count per partition for the ordinal
    offsets), never the rows themselves."""
    load_all()
    for key in ("manifest", "site_companies", "symbol_counts", "symbol_summary", "reachability", "work_list",
                "stratified_split", "request_ids", "tfidf", "reassemble", "language_breakdown"):
        plan = _plan(QUERIES[key](spark, sf_small))
        for feeder in _single_partition_inputs(plan):
            assert "HashAggregate" in feeder or "TakeOrderedAndProject" in feeder, (key, feeder)


def test_expensive_expressions_not_duplicated(spark, sf_small):
    """Filter pushdown must not copy URL/extraction regex chains into every
    predicate (they are bound once with ``functions.bind.let``)."""
    load_all()
    limits = {"first_level_links": 40, "site_result": 80, "quality_filter": 40, "manifest": 40}
    for key, limit in limits.items():
        plan = QUERIES[key](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace") <= limit, (key, plan.count("regexp_replace"))
