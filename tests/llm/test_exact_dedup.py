from collections import defaultdict

from convspark.llm.exact_dedup import exact_dedup, mark_duplicates

from .helpers import doc, docs_of

ROWS = [doc(1, "same"), doc(2, "same"), doc(3, "Same"), doc(4, None), doc(5, ""), doc(6, "same"),
        doc(7, "x" * 300 + "a"), doc(8, "x" * 300 + "b"), doc(9, "x" * 300 + "a"), doc(10, "y" * 200_000),
        doc(11, "y" * 200_000), doc(12, "only"), doc(12, "only"), doc(None, "same"), doc(None, "null id")]


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for r in rows:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r[0], keep, len(ids), r[0] == keep))
    return sorted(out, key=str)


def marked(df, **kw):
    return sorted(((r["doc_id"], r["__keep_id"], r["__group_size"], r["__kept"])
                   for r in mark_duplicates(df, **kw).collect()), key=str)


def test_marks_equal_brute_force(spark):
    assert marked(docs_of(spark, ROWS)) == brute(ROWS)


def test_full_filter_only_costs_work(spark):
    """One word of the bit set: nearly every key collides, the result is the same."""
    assert marked(docs_of(spark, ROWS), filter_words=1, prefix_chars=2) == brute(ROWS)


def test_stage_keeps_columns_and_rows(spark):
    df = docs_of(spark, ROWS)
    out = exact_dedup(df)
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(
        str(r[0]) for r in brute(ROWS) if r[3])


def test_filter_agrees_with_the_marks_however_rough(spark):
    df = docs_of(spark, ROWS + [doc(i, "hot") for i in range(100, 160)])
    for kw in ({}, {"filter_words": 1, "prefix_chars": 2}):
        want = [str(r["doc_id"]) for r in mark_duplicates(df, **kw).where("__kept").collect()]
        assert sorted(str(r["doc_id"]) for r in exact_dedup(df, **kw).collect()) == sorted(want)


def test_unique_texts_pass_without_a_shuffle_and_copies_spread_by_id(spark):
    plan = exact_dedup(docs_of(spark, ROWS))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("LeftSemi") == 1
    semi = next(line for line in plan.splitlines() if "LeftSemi" in line)
    assert "__full" in semi and "<=>" in semi


def test_empty(spark):
    df = docs_of(spark, [])
    assert exact_dedup(df).collect() == [] and exact_dedup(df).columns == df.columns


def test_text_not_shuffled(spark):
    plan = mark_duplicates(docs_of(spark, ROWS).select("doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
