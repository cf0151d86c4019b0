"""Summaries, pages, profiles, exports and text helpers on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import combos, context, evaluate, export, profile, summary
from plumbline.plans import inputs as I
from plumbline.plans.run import NoCore, revalidate, run_dataset
from plumbline.rules.dwc import REGISTRY

DDL = "test_id string, test_type string, status string, result string, comment string, actedUpon string, consulted string, count int"


@pytest.fixture(scope="module")
def unique(spark):
    return spark.createDataFrame([
        ("VALIDATION_A", "Validation", "RUN_HAS_RESULT", "COMPLIANT", "", "dwc:countryCode=US", "", 2),
        ("VALIDATION_A", "Validation", "RUN_HAS_RESULT", "NOT_COMPLIANT", "", "dwc:countryCode=ZZ", "", 1),
        ("AMENDMENT_B", "Amendment", "AMENDED", "dwc:eventDate=2023-01-01", "", "dwc:eventDate=01/01/2023", "", 2),
    ], DDL)


def test_summary(unique):
    s = summary.summary_with_top(unique, 3).first()
    assert (s["number_of_records_in_dataset"], s["no_of_tests_run"], s["no_of_tests_results"]) == (3, 2, 5)
    assert (s["no_of_non_compliant_validations"], s["no_of_amendments"], s["no_of_filled_in"]) == (1, 2, 0)
    assert s["list_of_all_columns_tested"] == ["dwc:countryCode", "dwc:eventDate"]
    assert [t["test_id"] for t in s["top_non_compliant_validations"]] == ["VALIDATION_A"] and s["top_issues"] == []


def test_no_results_give_zeros(spark):
    empty = evaluate.empty_results(spark)
    s = summary.summary_with_top(empty).first()
    assert s["no_of_tests_results"] == 0 and s["no_of_tests_run"] == 0 and s["list_of_all_columns_tested"] == [] and s["top_issues"] == []
    assert summary.dataset_size(empty).first()[0] == 0
    assert {r["number"] for r in summary.summary_cards(empty).collect()} == {0}
    assert summary.attention_matrix(context.join_context(empty, I.context(spark))).count() == 0


def test_count_defaults(spark):
    rows = spark.createDataFrame([("V_X", "Validation", "RUN_HAS_RESULT", "NOT_COMPLIANT", "c", "a=1", "a=1", None)], DDL)
    assert summary.dataset_size(rows).first()[0] == 0
    assert summary.ranked_tests(rows).first()["total"] == 1
    assert summary.top_combos(rows).first()["combo"] == "a=1"
    assert export.flagged_wide(rows, "V_X").first().asDict() == {"a": "1", "Records flagged": 1}
    declared = rows.withColumns({"actedUpon": F.lit("a=1|b=2"), "actedUpon_cols": F.lit("a"), "consulted_cols": F.lit("c")})
    assert export.flagged_wide(declared, "V_X").first().asDict() == {"a": "1", "c": "", "Records flagged": 1}


def test_texts_with_separators(spark):
    df = spark.createDataFrame([(" k = 'v=1' |bare|z=", " x=1 | x=1|y", "x=1|q=2")], "r string, a string, c string")
    row = df.select(X.parse_pairs(F.col("r")).alias("p"), X.combo_text(F.col("a"), F.col("c")).alias("combo"),
                    X.combo_text(F.lit(None).cast("string"), F.lit("")).alias("none"), X.test_kind(F.lit("A_b_")).alias("kind"),
                    X.change_text(F.lit("f=ö|g=2"), F.lit("f=Ö")).alias("change")).first()
    assert [tuple(p) for p in row["p"]] == [("k", "v=1"), ("z", "")]
    assert row["combo"] == "x=1 · y · q=2" and row["none"] == "N/A" and row["kind"] == "B"
    assert row["change"] == "f amended from Ö → ö; g → 2"


def test_combinations_keep_blanks_and_add_up(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("b", "x"), (None, "x")], "`dwc:k` string, v string")
    got = {(r["dwc:k"], r["v"]): r["count"] for r in combos.unique_combos(df, ["dwc:k", "v"]).collect()}
    assert got == {("a", ""): 2, ("b", "x"): 1, ("", "x"): 1}
    nan = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1.5,)], "n double")
    assert {r["n"]: r["count"] for r in combos.unique_combos(nan, ["n"]).collect()} == {"": 3, "1.5": 1}
    every = combos.unique_combos_all(df, [["dwc:k"], ["v"], ["v", "dwc:k"], ["dwc:k", "v"]])
    assert {r["set_id"]: r["n"] for r in every.groupBy("set_id").agg(F.sum("count").alias("n")).collect()} == {0: 4, 1: 4, 2: 4}


def test_many_columns_are_split_into_batches(spark):
    names = [f"c{i}" for i in range(130)]
    df = spark.createDataFrame([tuple("x" if i % 2 else "y" for i in range(130))] * 3, ", ".join(f"{n} string" for n in names))
    out = combos.unique_combos_all(df, [[n] for n in names])
    assert out.agg(F.count("*"), F.sum("count"), F.count_distinct("set_id")).first()[:] == (130, 390, 130)


def test_profile_and_snapshot(spark):
    df = spark.createDataFrame([(i, "v" * 60 if i % 2 else None, float(i % 3)) for i in range(24)], "k int, s string, f double")
    rows = profile.profile(df).orderBy(*profile.profile_order()).collect()
    assert [r["column"] for r in rows][0] == "s" and rows[0]["value"] == "v" * 50 + "..." and rows[0]["nulls"] == 12
    parts = [(r["part"], r["value"]) for r in rows if r["column"] == "k"]
    assert [p for p, _ in parts] == ["bottom"] * 2 + ["top"] * 5
    assert profile.snapshot(df.limit(7), ["k"]).count() == 7
    snap = profile.snapshot(df, ["k"]).collect()
    assert sorted(r["position"] for r in snap) == [-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]
    assert {r["k"] for r in snap if r["position"] == -1} == {"23"}
    wide = spark.createDataFrame([tuple(range(14))], ", ".join(f"c{i} int" for i in range(14)))
    assert profile.snapshot(wide, ["c0"]).columns == ["position", *[f"c{i}" for i in range(5)], "...", *[f"c{i}" for i in range(9, 14)]]


def test_null_only_column_is_profiled(spark):
    row = profile.profile(spark.createDataFrame([(None,), (None,)], "x string")).first()
    assert (row["distinct"], row["nulls"], row["total"], row["value"]) == (0, 2, 2, None)


def test_union_orders_columns_and_fills_text(spark):
    a = spark.createDataFrame([("t", "x", 1)], "test_id string, `dwc:b` string, count int")
    b = spark.createDataFrame([("u", "y", 2, "z")], "test_id string, `dwc:a` string, count int, extra string")
    out = evaluate.union_results([a, b])
    assert out.columns == ["test_id", "count", "dwc:a", "dwc:b", "extra"]
    assert out.filter("test_id = 't'").first()["dwc:a"] == ""


def test_observation(spark, occurrences):
    run = evaluate.run_tests(occurrences, REGISTRY.select("VALIDATION_COUNTRY_NOTEMPTY"))
    watched, seen = evaluate.observe_run(run.results)
    watched.collect()
    assert seen.get["rows"] == 5 and seen.get["unmet"] == 0


def test_whole_run(spark, tmp_path):
    df = spark.createDataFrame([("1", "sp.", None), ("2", "Species", "x"), ("3", "sp.", "y")], "`dwc:taxonID` string, `dwc:taxonRank` string, `dwc:other` string")
    rules = REGISTRY.select("AMENDMENT_TAXONRANK_STANDARDIZED", "VALIDATION_TAXONRANK_STANDARD")
    report = run_dataset(df, rules, str(tmp_path), "r")
    assert report.core == "taxon" and report.results.count() == 4
    assert {r[0] for r in report.amended.select("`dwc:taxonRank`").collect()} == {"species"}
    assert report.summary.first()["no_of_amendments"] == 3 and report.curated.count() == 4
    again = revalidate(report, rules).results
    assert again.filter("result = 'NOT_COMPLIANT' or status = 'AMENDED'").count() == 0
    run_dataset(df, rules, str(tmp_path), "r")  # a repeated run replaces its artifacts
    assert spark.read.parquet(str(tmp_path / "results")).count() == 4
    with pytest.raises(NoCore):
        run_dataset(df.drop("dwc:taxonID"), rules, str(tmp_path), "r2")


def test_pages_after_a_key(spark, tmp_path):
    rows = [(i % 7, f"n{i:03d}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "`dwc:a` int, b string, v int")
    stored = summary.store_pages(df, str(tmp_path / "pages"), ["dwc:a", "b"])
    want, after, got = sorted(rows), None, []
    for _ in range(7):
        part = [tuple(r) for r in summary.page_after(stored, ["dwc:a", "b"], 10, after).collect()]
        got += part
        after = part[-1][:2] if part else after
    assert got == want
    plan = summary.page_after(stored, ["dwc:a", "b"], 10, (3, "n010"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(`dwc:a`,3)" in plan


def test_summary_of_each_run_takes_two_shuffles(spark, unique):
    runs = unique.withColumn("run_id", F.lit("a")).unionByName(unique.where("count > 1").withColumn("run_id", F.lit("b"))).unionByName(
        unique.withColumn("test_id", F.lit(None).cast("string")).withColumn("run_id", F.lit("c")))
    records = spark.createDataFrame([("a", 7), ("b", 8), ("c", 9), ("d", 1)], "run_id string, n long")
    got = summary.run_summary(runs, keys=["run_id"], records=records)
    for run, n in (("a", 7), ("b", 8), ("c", 9), ("d", 1)):
        want = summary.run_summary(runs.where(F.col("run_id") == run).drop("run_id"), n_records=n)
        assert got.where(F.col("run_id") == run).drop("run_id").select(*want.columns).collect() == want.collect()
        sized = summary.run_summary(runs.where(F.col("run_id") == run).drop("run_id"))
        assert sized.drop("number_of_records_in_dataset").collect() == want.drop("number_of_records_in_dataset").collect()
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("collect_list(") <= 2
