"""What the physical plans of typical queries must and must not hold."""

from conftest import DATA

from quillspark import catalogue


def plan(spark, name):
    return catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_top_k_does_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in plan(spark, "semantic_topk") and "TakeOrderedAndProject" in plan(spark, "pending_priority")


def test_filters_reach_the_scan(spark):
    p = plan(spark, "metric_range")
    assert "EqualTo(event_type,click)" in p and "GreaterThanOrEqual(ts" in p


def test_columns_are_pruned(spark):
    p = plan(spark, "language_distribution")
    assert "ReadSchema: struct<lang:string>" in p


def test_no_cartesian_products(spark):
    for name in ("symbol_containment_join", "neighbour_expand", "co_change", "query_context", "agent_selection"):
        assert "Cartesian" not in plan(spark, name), name


def test_texts_are_not_read_again_and_again(spark):
    """A score or a count is in the plan once, however often filters, sorts and results name it."""
    for name, most in (("token_estimate_model", 7), ("fulltext_topk", 2), ("query_context", 12), ("scoped_context", 3)):
        assert plan(spark, name).count("regexp_") <= most, name


def test_no_window_over_all_rows(spark):
    """Numbers and ranks over whole tables come from ranges; what windows without a key there are see few rows."""
    for name in ("surrogate_keys", "alert_eval", "before_after_delta", "metric_scalar_p99"):
        p = plan(spark, name)
        assert "Window [row_number" not in p and "Window [percentile" not in p, name
    assert "Window [row_number" not in plan(spark, "rrf_fusion") and "WindowGroupLimit" in plan(spark, "hybrid_context")


def test_snippets_meet_the_chunks_by_broadcast(spark):
    p = plan(spark, "query_context")
    assert "BroadcastHashJoin [file_id" in p and "TakeOrderedAndProject(limit=64" in p


def test_agents_are_ranked_once_for_each_set_of_needs(spark):
    p = plan(spark, "agent_selection")
    assert "BroadcastHashJoin [needs" in p


def test_source_files_are_dealt_to_all_cores(spark):
    """Parts are a file of short rows, which one task would parse alone."""
    from quillspark.plans.corpus import _source_files
    from quillspark.plans.registry import Tables

    assert _source_files(Tables(spark, DATA)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_provider_hits_make_no_term_table(spark, monkeypatch):
    """One search scans the texts; with the term table the provider's hits are the same."""
    from quillspark.operators import context, terms
    from quillspark.plans import retrieval as plans
    from quillspark.plans.registry import Tables

    t, made, given = Tables(spark, DATA), [], terms.build_terms
    monkeypatch.setattr(terms, "_KNOWN", {})
    monkeypatch.setattr(terms, "build_terms", lambda chunks: made.append(1) or given(chunks))
    scanned = plans.provider_hits(t).filter("provider = 'full_text'").collect()
    assert scanned and not made
    assert context.gathered(plans._corpus(t, indexed=True), plans._asked(t), ("full_text",)).collect() == scanned and made
