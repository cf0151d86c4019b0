from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.operators import amend
from plumbline.operators.evaluate import run_tests
from plumbline.rules import base as B
from plumbline.rules.registry import Registry

KEYS = ["dwc:countryCode", "dwc:decimalLatitude", "dwc:decimalLongitude"]


def results_of(spark, rows):
    """Rows (code, lat, lon, count, test, status, result) as a wide result table."""
    full = [(*r, "Amendment", "", f"dwc:countryCode={r[0]}", f"dwc:decimalLatitude={r[1]}|dwc:decimalLongitude={r[2]}", KEYS[0], "|".join(KEYS[1:])) for r in rows]
    ddl = ", ".join(f"`{k}` string" for k in KEYS) + (", count int, test_id string, status string, result string, test_type string, "
                                                     "comment string, actedUpon string, consulted string, actedUpon_cols string, consulted_cols string")
    return spark.createDataFrame(full, ddl)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([("1", "US", "40.0", "-74.0"), ("2", "US", "40.0", "-78.0"), ("3", "US", "40.0", "-78.0"), ("4", None, "1", "2")],
                                 "`dwc:occurrenceID` string, " + ", ".join(f"`{k}` string" for k in KEYS))


def codes(df):
    return {r["dwc:occurrenceID"]: r["dwc:countryCode"] for r in df.collect()}


def test_only_the_matching_rows_change(spark, table):
    res = results_of(spark, [("US", "40.0", "-74.0", 1, "A", "NOT_AMENDED", ""), ("US", "40.0", "-78.0", 2, "A", "AMENDED", "dwc:countryCode=CAN")])
    assert codes(amend.apply_amendments(table, res)) == {"1": "US", "2": "CAN", "3": "CAN", "4": None}
    m = amend.amend_metrics(table, res).first()
    assert (m["updates"], m["rows_touched"], m["not_found"]) == (2, 2, [])


def test_blanks_match_unless_strict(spark, table):
    res = results_of(spark, [("", "1", "2", 1, "A", "FILLED_IN", "dwc:countryCode=X|dwc:nothing=1")])
    assert codes(amend.apply_amendments(table, res))["4"] == "X"
    assert codes(amend.apply_amendments(table, res, strict_blank_mismatch=True))["4"] is None
    m = amend.amend_metrics(table, res).first()
    assert (m["updates"], m["rows_touched"], m["not_found"]) == (1, 1, ["dwc:nothing"])


def test_later_test_wins_and_originals_are_matched(spark, table):
    res = results_of(spark, [("US", "40.0", "-74.0", 1, "B", "AMENDED", "dwc:countryCode=second"),
                             ("US", "40.0", "-74.0", 1, "A", "AMENDED", "dwc:countryCode=first|dwc:decimalLatitude='9'"),
                             ("first", "40.0", "-74.0", 1, "C", "AMENDED", "dwc:countryCode=never")])
    out = {r["dwc:occurrenceID"]: r for r in amend.apply_amendments(table, res).collect()}
    assert (out["1"]["dwc:countryCode"], out["1"]["dwc:decimalLatitude"]) == ("second", "9")


def test_nothing_to_do(spark, table):
    res = results_of(spark, [("US", "40.0", "-74.0", 1, "A", "NOT_AMENDED", "")])
    assert amend.apply_amendments(table, res).collect() == table.collect()
    assert amend.amend_metrics(table, res).first()["updates"] == 0


RULES = Registry()
RULES.rule("AMENDMENT_A", "Amendment", acted=["a"])(B.standardize("a", lambda v: B.lookup_literal(v["a"], {"x": "X", "hot": "HOT"}), lambda v: v["a"] == "X"))
RULES.rule("AMENDMENT_B", "Amendment", acted=["b"], consulted=["a"])(B.fill_from({"b": lambda v: F.upper(v["a"])}, ["a"]))
RULES.rule("AMENDMENT_C", "Amendment", acted=["a", "c"])(B.standardize("c", lambda v: F.when(v["a"] == "hot", F.lit("cc")), lambda v: v["c"] == "cc"))


def skewed(spark):
    """Two thirds of the rows hold one key."""
    kind = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 == 0, "x").otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    return spark.range(3000).select(F.col("id").cast("string").alias("id"), kind.alias("a"), F.when(F.col("id") % 4 == 0, "b").alias("b"),
                                    (F.col("id") % 2).cast("string").alias("c"))


@pytest.mark.parametrize(("share", "limit"), [(0.001, 0), (0.2, 0), (0.0, 0), (0.2, amend.BROADCAST_LIMIT)])
def test_hot_keys_change_like_any_other(spark, monkeypatch, share, limit):
    """The path for hot combinations, the plain join, the broadcast and the inline form give the same table."""
    df = skewed(spark)
    stored = run_tests(df, RULES).results
    monkeypatch.setattr(amend, "HOT_SHARE", share)
    monkeypatch.setattr(amend, "BROADCAST_LIMIT", limit)
    hot = sorted(map(tuple, amend.apply_amendments(df, stored).collect()))
    inline = sorted(map(tuple, amend.amend_inline(df, RULES).collect()))
    assert hot == inline and len(hot) == 3000
    assert sum(r[1] == "HOT" for r in hot) == 2000 and sum(r[3] == "cc" for r in hot) == 2000


def test_applying_twice_is_applying_once(spark):
    df = skewed(spark)
    stored = run_tests(df, RULES.select("AMENDMENT_A")).results
    once = amend.apply_amendments(df, stored)
    assert sorted(map(tuple, amend.apply_amendments(once, stored).collect())) == sorted(map(tuple, once.collect()))
