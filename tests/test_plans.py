"""Physical-plan properties the scale design relies on (read from explain, not executed)."""

import re

import __spark_entry__ as E

from .conftest import SF_CHECK

Q = E.queries()


def plan(spark, name):
    return Q[name](spark, SF_CHECK)._jdf.queryExecution().executedPlan().toString()


def test_sft_window_one_shuffle_and_pruned_scan(spark):
    p = plan(spark, "sft_window_w5")
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1
    assert "hashpartitioning(conv_id" in p
    assert "SortMergeJoin" not in p and "BroadcastNestedLoopJoin" not in p


def test_event_filter_pushed_and_columns_pruned(spark):
    p = plan(spark, "grid_coverage")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,purchase\)", p)
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert scans and all("props" not in s and "value" not in s for s in scans)


def test_documents_text_not_read_when_unused(spark):
    p = plan(spark, "quality_filter")
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert all("text" not in s for s in scans)


def test_templates_broadcast_not_shuffled(spark):
    p = plan(spark, "judge_scores")
    assert "BroadcastNestedLoopJoin" in p and "BroadcastExchange" in p
    assert "MapInPandas" in p


def test_split_single_partition_only_on_bucket_table(spark):
    from convspark.operators.split import split_ids
    from convspark.sources.tables import turns
    p = split_ids(turns(spark, SF_CHECK).select("conv_id"), materialize=False) \
        ._jdf.queryExecution().executedPlan().toString()
    # the only single-partition step is the running count over <= 65,536 hash buckets
    assert p.count("SinglePartition") == 1
    assert "BroadcastExchange" in p


def test_median_is_partially_aggregated(spark):
    p = plan(spark, "token_stats")
    assert re.search(r"partial_(median|percentile)", p)


def test_model_workers_get_prompts_only(spark):
    """The transcript stays in the JVM and the prompt does not come back; batches are bound by bytes."""
    p = plan(spark, "judge_scores")
    calls = [x for x in p.splitlines() if "MapInPandas" in x]
    assert calls and all("transcript" not in x and x.count("prompt#") == 1 for x in calls)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_clean_text_is_not_cut_into_characters(spark):
    p = plan(spark, "clean_unicode")
    # the translation table appears once, for texts that stay in the JVM, and nothing looks up single characters of a split text
    assert "split(" not in p and p.count("translate(") <= 4
