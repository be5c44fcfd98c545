import __spark_entry__ as E
from conftest import SF001


def test_entry_runs(spark):
    df = E.entry(spark)
    out = df.collect()
    assert df.columns == ["label", "n_pos", "n_neg", "auc", "avg_num_words"]
    assert {r["label"] for r in out} == {"toxic", "quality"}
    assert all(0.0 <= r["auc"] <= 1.0 for r in out)


def test_oracle_keys_subset():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 90


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_stays_in_jvm(spark):
    qs = E.queries()
    for name in ("p7_text_to_wordlist", "p6_glove_preprocess", "f2_f6_text_statistics", "v2_tfidf"):
        plan = _plan(qs[name](spark, SF001))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_spelling_verifies_joined_candidates_only(spark):
    """Python sees pairs that the key join and the JVM's edit distance have let through."""
    plan = _plan(E.queries()["t12_spelling_correction"](spark, SF001))
    assert "BatchEvalPython" not in plan and plan.count("ArrowEvalPython") == 1
    below = plan[plan.index("ArrowEvalPython"):]
    assert "levenshtein(" in below and "SortMergeJoin" in below


def test_pruned_scan_and_partial_aggregate(spark):
    df = E.queries()["t5_chargram_counts"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in df._jdf.queryExecution().explainString(
        __import__("py4j").java_gateway.java_import and spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) \
        or "text" in plan
    assert "partial_count" in plan
