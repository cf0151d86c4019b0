"""Expected outcomes of the rule pack."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.operators.evaluate import evaluate, evaluate_requests, run_tests
from plumbline.rules import base as B
from plumbline.rules.adapters import pandas_rule
from plumbline.rules.dwc import REGISTRY
from plumbline.rules.registry import Registry

OK, BAD = ("RUN_HAS_RESULT", "COMPLIANT"), ("RUN_HAS_RESULT", "NOT_COMPLIANT")
SAME, UNMET = ("NOT_AMENDED", ""), ("INTERNAL_PREREQUISITES_NOT_MET", "")

# Expected (status, result) per test for the five records; None marks an outcome that depends
# on which reference tables are at hand.
EXPECTED = {
    "AMENDMENT_BASISOFRECORD_STANDARDIZED": [SAME] * 5,
    "AMENDMENT_COORDINATES_TRANSPOSED": [SAME] * 5,
    "AMENDMENT_COUNTRYCODE_FROM_COORDINATES": [UNMET] * 5,
    "AMENDMENT_COUNTRYCODE_STANDARDIZED": [SAME] * 5,
    "AMENDMENT_EVENTDATE_STANDARDIZED": [SAME] * 5,
    "EVENT_DATE_PRECISON_JULIAN_YEAR_OR_BETTER": [OK] * 5,
    "EVENT_DATE_YEAR_INCOMPLETE": [OK] * 5,
    "VALIDATION_BASISOFRECORD_NOTEMPTY": [OK] * 5,
    "VALIDATION_BASISOFRECORD_STANDARD": [OK] * 4 + [BAD],
    "VALIDATION_COORDINATESCOUNTRYCODE_CONSISTENT": [OK, None, OK, None, UNMET],
    "VALIDATION_COORDINATESTERRESTRIALMARINE_CONSISTENT": [OK, UNMET, OK, UNMET, UNMET],
    "VALIDATION_COORDINATES_NOTZERO": [OK] * 5,
    "VALIDATION_COUNTRYCODE_NOTEMPTY": [OK] * 5,
    "VALIDATION_COUNTRYCODE_STANDARD": [OK] * 5,
    "VALIDATION_COUNTRYCOUNTRYCODE_CONSISTENT": [None, OK, OK, None, BAD],
    "VALIDATION_COUNTRY_FOUND": [OK] * 4 + [BAD],
    "VALIDATION_COUNTRY_NOTEMPTY": [OK] * 5,
    "VALIDATION_DECIMALLATITUDE_INRANGE": [OK] * 4 + [BAD],
    "VALIDATION_DECIMALLATITUDE_NOTEMPTY": [OK] * 5,
    "VALIDATION_DECIMALLONGITUDE_INRANGE": [OK] * 4 + [BAD],
    "VALIDATION_DECIMALLONGITUDE_NOTEMPTY": [OK] * 5,
    "VALIDATION_EVENTDATE_INRANGE": [OK] * 5,
    "VALIDATION_EVENTDATE_NOTEMPTY": [OK] * 5,
    "VALIDATION_EVENTDATE_STANDARD": [OK] * 5,
    "VALIDATION_OCCURRENCEID_NOTEMPTY": [OK] * 5,
    "VALIDATION_OCCURRENCEID_STANDARD": [BAD] * 5,
    "VALIDATION_SCIENTIFICNAME_FOUND": [BAD] * 5,
    "VALIDATION_SCIENTIFICNAME_NOTEMPTY": [OK] * 5,
}


def test_five_records_against_expected_outcomes(spark, refs, occurrences):
    run = run_tests(occurrences, REGISTRY, refs)
    assert run.failed.count() == 0
    rows = run.results.collect()
    data = [r.asDict() for r in occurrences.collect()]
    checked = 0
    for test_id, wanted in EXPECTED.items():
        mine = [r for r in rows if r["test_id"] == test_id]
        assert sum(r["count"] for r in mine) == 5, test_id
        for record, expected in zip(data, wanted):
            hit = [r for r in mine if all(record[k] == v for k, v in r["values"].items())]
            assert len(hit) == 1, (test_id, record)
            if expected is not None:
                assert (hit[0]["status"], hit[0]["result"]) == expected, (test_id, record)
                checked += 1
    assert checked == 136


def answer(spark, refs, test_id, rule=None, **values):
    r = rule or REGISTRY[test_id]
    ddl = ", ".join(f"`{c}` string" for c in r.columns) + ", count bigint"
    row = [values.get(c.removeprefix("dwc:")) for c in r.columns]
    out = evaluate(spark.createDataFrame([(*row, 1)], ddl), r, refs).first()
    return out["status"], out["result"]


CASES = [
    ("AMENDMENT_EVENTDATE_STANDARDIZED", {"eventDate": "8 May 1880"}, ("AMENDED", "dwc:eventDate=1880-05-08")),
    ("AMENDMENT_EVENTDATE_STANDARDIZED", {"eventDate": "25/12/2001"}, ("AMENDED", "dwc:eventDate=2001-12-25")),
    ("AMENDMENT_EVENTDATE_STANDARDIZED", {"eventDate": "01/02/03"}, ("AMBIGUOUS", "")),
    ("AMENDMENT_EVENTDATE_STANDARDIZED", {"eventDate": "May 8, 1880"}, ("AMENDED", "dwc:eventDate=1880-05-08")),
    ("AMENDMENT_EVENTDATE_STANDARDIZED", {"eventDate": "soon"}, SAME),
    ("AMENDMENT_EVENTDATE_STANDARDIZED", {"eventDate": None}, UNMET),
    ("AMENDMENT_MINDEPTHMAXDEPTH_FROM_VERBATIM", {"verbatimDepth": "10 feet"},
     ("FILLED_IN", "dwc:minimumDepthInMeters=3.048|dwc:maximumDepthInMeters=3.048")),
    ("AMENDMENT_MINDEPTHMAXDEPTH_FROM_VERBATIM", {"verbatimDepth": "10-20 m"},
     ("FILLED_IN", "dwc:minimumDepthInMeters=10|dwc:maximumDepthInMeters=20")),
    ("AMENDMENT_COORDINATES_DECIMAL", {"decimalLatitude": "40°26'46\"N", "decimalLongitude": "79°58'56\"W"},
     ("AMENDED", "dwc:decimalLatitude=40.446|dwc:decimalLongitude=-79.982")),
    ("AMENDMENT_COORDINATES_DECIMAL", {"decimalLatitude": "40.4", "decimalLongitude": "79°58'56\"W"}, SAME),
    ("AMENDMENT_MINDEPTHMAXDEPTH_FROM_VERBATIM", {"verbatimDepth": "deep"}, SAME),
    ("AMENDMENT_COORDINATES_FROM_VERBATIM", {"verbatimLatitude": "north", "verbatimLongitude": "1", "verbatimSRS": "x"}, SAME),
    ("AMENDMENT_COORDINATES_FROM_VERBATIM",
     {"verbatimLatitude": "-41.0526", "verbatimLongitude": "-71.5311", "verbatimSRS": "EPSG:4326"},
     ("FILLED_IN", "dwc:decimalLatitude=-41.0526|dwc:decimalLongitude=-71.5311|dwc:geodeticDatum=EPSG:4326")),
    ("AMENDMENT_COUNTRYCODE_STANDARDIZED", {"countryCode": "United States"}, ("AMENDED", "dwc:countryCode=US")),
    ("AMENDMENT_COUNTRYCODE_STANDARDIZED", {"countryCode": "usa"}, ("AMENDED", "dwc:countryCode=US")),
    ("AMENDMENT_COUNTRYCODE_STANDARDIZED", {"countryCode": "us"}, ("AMENDED", "dwc:countryCode=US")),
    ("AMENDMENT_COUNTRYCODE_STANDARDIZED", {"countryCode": "Q"}, SAME),
    ("AMENDMENT_SCIENTIFICNAME_CORRECTED", {"scientificName": "homo sapiens"}, ("AMENDED", "dwc:scientificName=Homo sapiens")),
    ("AMENDMENT_SCIENTIFICNAME_CORRECTED", {"scientificName": "Canis lupus Linnaeus, 1758"}, SAME),
    ("AMENDMENT_TAXONRANK_STANDARDIZED", {"taxonRank": "sp."}, ("AMENDED", "dwc:taxonRank=species")),
    ("AMENDMENT_TAXONRANK_STANDARDIZED", {"taxonRank": "Species"}, ("AMENDED", "dwc:taxonRank=species")),
    ("AMENDMENT_BASISOFRECORD_STANDARDIZED", {"basisOfRecord": "human observation"}, ("AMENDED", "dwc:basisOfRecord=HumanObservation")),
    ("AMENDMENT_COUNTRYCODE_FROM_COORDINATES", {"decimalLatitude": "48.8", "decimalLongitude": "2.3"}, ("FILLED_IN", "dwc:countryCode=FR")),
    ("AMENDMENT_COUNTRYCODE_FROM_COORDINATES", {"decimalLatitude": "0", "decimalLongitude": "0"}, SAME),
    ("AMENDMENT_COORDINATES_TRANSPOSED", {"decimalLatitude": "2.3", "decimalLongitude": "48.8", "countryCode": "FR"},
     ("AMENDED", "dwc:decimalLatitude=48.8|dwc:decimalLongitude=2.3")),
    ("AMENDMENT_COORDINATES_TRANSPOSED", {"decimalLatitude": "25.5", "decimalLongitude": "135.9", "countryCode": "AU"},
     ("AMENDED", "dwc:decimalLatitude=-25.5|dwc:decimalLongitude=135.9")),
    ("VALIDATION_COORDINATES_IN_COUNTRY", {"decimalLatitude": "40.7128", "decimalLongitude": "-74.0060", "countryCode": "CA"}, BAD),
    ("VALIDATION_COORDINATESTERRESTRIALMARINE_CONSISTENT",
     {"decimalLatitude": "0", "decimalLongitude": "-30", "scientificName": "Delphinus delphis"}, OK),
    ("VALIDATION_COORDINATESTERRESTRIALMARINE_CONSISTENT",
     {"decimalLatitude": "48", "decimalLongitude": "2", "scientificName": "Delphinus delphis"}, BAD),
    ("VALIDATION_COORDINATES_NOTZERO", {"decimalLatitude": "0.0", "decimalLongitude": "0"}, BAD),
    ("VALIDATION_COUNTRYCODE_STANDARD", {"countryCode": "us"}, BAD),
    ("VALIDATION_COUNTRYCODE_NOTEMPTY", {"countryCode": "  "}, BAD),
    ("VALIDATION_DECIMALLATITUDE_VALID", {"decimalLatitude": "95.5"}, BAD),
    ("VALIDATION_DECIMALLONGITUDE_VALID", {"decimalLongitude": "-120.5"}, OK),
    ("VALIDATION_DECIMALLATITUDE_INRANGE", {"decimalLatitude": "NaN"}, UNMET),
    ("VALIDATION_EVENTDATE_STANDARD", {"eventDate": "2023-02-30"}, BAD),
    ("VALIDATION_EVENTDATE_STANDARD", {"eventDate": "2023-02-01/03-04"}, OK),
    ("VALIDATION_EVENTDATE_STANDARD", {"eventDate": "2023-05-02/2023-05-01"}, BAD),
    ("VALIDATION_EVENTDATE_STANDARD", {"eventDate": "2023-060"}, OK),
    ("VALIDATION_EVENTDATE_INRANGE", {"eventDate": "1500"}, BAD),
    ("VALIDATION_EVENTDATE_INRANGE", {"eventDate": "01/02/03"}, UNMET),
    ("EVENT_DATE_PRECISON_JULIAN_YEAR_OR_BETTER", {"eventDate": "2019-01-01/2020-06-01"}, BAD),
    ("EVENT_DATE_YEAR_INCOMPLETE", {"eventDate": "2020"}, BAD),
    ("EVENT_DATE_YEAR_INCOMPLETE", {"eventDate": "2021"}, OK),
    ("ISSUE_EVENTDATE_AMBIGUOUS", {"eventDate": "01/02/03"}, ("RUN_HAS_RESULT", "POTENTIAL_ISSUE")),
    ("ISSUE_EVENTDATE_AMBIGUOUS", {"eventDate": "2001-01-02"}, ("RUN_HAS_RESULT", "NOT_ISSUE")),
    ("VALIDATION_EVENT_CONSISTENT", {"eventDate": "2021-03-04", "year": "2021", "month": "3", "day": "4"}, OK),
    ("VALIDATION_EVENT_CONSISTENT", {"eventDate": "2021-03-04", "year": "2020"}, BAD),
    ("VALIDATION_EVENT_CONSISTENT", {"eventDate": "2021-03", "month": "3", "day": "4"}, OK),
    ("VALIDATION_MINDEPTH_LESSTHAN_MAXDEPTH", {"minimumDepthInMeters": "10", "maximumDepthInMeters": "5"}, BAD),
    ("VALIDATION_MINELEVATION_LESSTHAN_MAXELEVATION", {"minimumElevationInMeters": "1", "maximumElevationInMeters": "5"}, OK),
    ("VALIDATION_MAXELEVATION_INRANGE", {"maximumElevationInMeters": "9999"}, BAD),
    ("VALIDATION_LICENSE_STANDARD", {"license": "https://creativecommons.org/licenses/by/4.0/"}, OK),
    ("VALIDATION_LICENSE_STANDARD", {"license": "all mine"}, BAD),
    ("VALIDATION_OCCURRENCEID_STANDARD", {"occurrenceID": "urn:catalog:x:1"}, OK),
    ("VALIDATION_OCCURRENCEID_STANDARD", {"occurrenceID": "https://example.org/o/1"}, OK),
    ("VALIDATION_OCCURRENCEID_STANDARD", {"occurrenceID": "123e4567-e89b-12d3-a456-426614174000"}, OK),
    ("VALIDATION_SCIENTIFICNAME_FOUND", {"scientificName": "Homo sapiens Linnaeus, 1758"}, OK),
    ("VALIDATION_SCIENTIFICNAME_FOUND", {"scientificName": "Rubus idaeus"}, OK),
    ("VALIDATION_PHYLUM_FOUND", {"phylum": "Tracheophyta"}, OK),
    ("VALIDATION_PHYLUM_FOUND", {"phylum": "Nonsense"}, BAD),
    ("VALIDATION_SCIENTIFICNAME_FORMAT", {"scientificName": "Homo sapiens"}, OK),
    ("VALIDATION_TAXONRANK_VALID", {"taxonRank": "invalid_rank"}, BAD),
    ("ISSUE_COORDINATES_WITHOUT_UNCERTAINTY", {"decimalLatitude": "1", "decimalLongitude": "2"}, ("RUN_HAS_RESULT", "POTENTIAL_ISSUE")),
]


def test_single_cases(spark, refs):
    """All cases through the request list, one job for all of them."""
    requests = spark.createDataFrame(
        [(i, t, {f"dwc:{k}": v for k, v in values.items()}) for i, (t, values, _) in enumerate(CASES)],
        "seq int, id string, params map<string,string>")
    got = {r["seq"]: (r["status"], r["result"]) for r in evaluate_requests(requests, REGISTRY, refs).collect()}
    wrong = [(CASES[i], got[i]) for i in range(len(CASES)) if got[i] != CASES[i][2]]
    assert not wrong


def test_options(spark, refs):
    assert answer(spark, refs, "", REGISTRY["AMENDMENT_EVENTDATE_STANDARDIZED"].with_params(day_first=True),
                  eventDate="01/02/2003") == ("AMENDED", "dwc:eventDate=2003-02-01")
    assert answer(spark, refs, "", REGISTRY["VALIDATION_COUNTRYCODE_STANDARD"].with_params(user_assigned=False), countryCode="ZZ") == BAD
    assert answer(spark, refs, "", REGISTRY["VALIDATION_EVENTDATE_INRANGE"].with_params(latestValidDate="2020-12-31"), eventDate="2021") == BAD
    # Ten metres of latitude are about 0.00009 degrees: just outside the box, inside the buffer.
    near = {"decimalLatitude": "42.0", "decimalLongitude": "8.01", "countryCode": "FR"}
    r = REGISTRY["VALIDATION_COORDINATES_IN_COUNTRY"]
    assert answer(spark, refs, "", r, **near) == BAD
    assert answer(spark, refs, "", r.with_params(spatialBufferInMeters=3000.0), **near) == OK


def test_requests_keep_order_and_isolate_errors(spark, refs):
    guid = REGISTRY["VALIDATION_COUNTRY_NOTEMPTY"].guid
    requests = spark.createDataFrame(
        [(0, "VALIDATION_COUNTRY_NOTEMPTY", {"dwc:country": "USA"}), (1, "UNKNOWN_TEST_ID", {}), (2, "", {}), (3, None, None),
         (4, guid, {"dwc:country": ""}), (5, "VALIDATION_COUNTRY_FOUND", {"dwc:country": "Canada"})],
        "seq int, id string, params map<string,string>")
    out = evaluate_requests(requests, REGISTRY, ordered=True).collect()
    assert [r["seq"] for r in out] == list(range(6))
    assert out[0]["result"] == "COMPLIANT" and out[4]["result"] == "NOT_COMPLIANT"
    assert [r["status"] for r in out[1:4]] == ["INTERNAL_PREREQUISITES_NOT_MET"] * 3
    assert "unknown test" in out[1]["comment"].lower() and "missing id" in out[2]["comment"].lower()
    assert out[5]["status"] == "EXTERNAL_PREREQUISITES_NOT_MET"  # no country table given


def test_missing_references_are_reported_not_fatal(occurrences):
    run = run_tests(occurrences, REGISTRY)
    failed = {r["test_id"]: r["reason"] for r in run.failed.collect()}
    assert "VALIDATION_COUNTRY_FOUND" in failed and "iso" in failed["VALIDATION_COUNTRY_FOUND"]
    assert run.results.filter("test_id = 'VALIDATION_COUNTRY_NOTEMPTY'").agg(F.sum("count")).first()[0] == 5


def test_user_rule_in_batches(spark):
    registry = Registry()

    def check(a, b):
        if a == "boom":
            raise ValueError("no good")
        return "RUN_HAS_RESULT", "COMPLIANT" if a == b else "NOT_COMPLIANT", ""

    registry.rule("VALIDATION_SAME", acted=["a", "b"])(pandas_rule(check, ["a", "b"]))
    df = spark.createDataFrame([("x", "x"), ("x", "y"), ("boom", "y"), ("x", "x")], "a string, b string")
    out = {r["actedUpon"]: (r["status"], r["result"], r["count"], r["comment"]) for r in run_tests(df, registry).results.collect()}
    assert out["a=x|b=x"] == ("RUN_HAS_RESULT", "COMPLIANT", 2, "")
    assert out["a=x|b=y"][1] == "NOT_COMPLIANT"
    assert out["a=boom|b=y"][0] == "INTERNAL_PREREQUISITES_NOT_MET" and "no good" in out["a=boom|b=y"][3]


@pytest.mark.parametrize("single_pass", [False, True])
def test_modes_agree(occurrences, refs, single_pass):
    key = ["test_id", "status", "result", "actedUpon", "consulted", "count"]
    a = run_tests(occurrences, REGISTRY, refs, single_pass=single_pass).results.select(*key).collect()
    b = run_tests(occurrences.repartition(3), REGISTRY, refs).results.select(*key).collect()
    assert sorted(a) == sorted(b) and a


def test_parameters_of_a_request(spark):
    from plumbline.operators.evaluate import batch_summary
    rows = [(0, "VALIDATION_EVENTDATE_INRANGE", {"dwc:eventDate": "2000-01-01", "bdq:latestValidDate": "1990-12-31"}),
            (1, "VALIDATION_EVENTDATE_INRANGE", {"dwc:eventDate": "2000-01-01", "latestValidDate": "junk"}),
            (2, "VALIDATION_EVENTDATE_INRANGE", {"dwc:eventDate": "2000-01-01"}), (3, None, {})]
    out = evaluate_requests(spark.createDataFrame(rows, "seq int, id string, params map<string,string>"), REGISTRY)
    got = {r["seq"]: (r["status"], r["result"], r["comment"]) for r in out.collect()}
    assert {k: v[1] for k, v in got.items()} == {0: "NOT_COMPLIANT", 1: "", 2: "COMPLIANT", 3: ""}
    assert got[1][0] == "INTERNAL_PREREQUISITES_NOT_MET" and got[1][2] == "Parameter latestValidDate is no date: junk"
    ids = spark.createDataFrame([(None, "x"), ("A", "x")], "id string, status string")
    assert not batch_summary(ids).first()["homogeneous"]


def test_two_digit_years_are_ambiguous(spark):
    df = spark.createDataFrame([("31/12/98",), ("31/12/1998",)], "d string")
    from plumbline.functions.dates import ambiguous_date, standard_date
    out = df.select("d", standard_date(F.col("d")).alias("s"), ambiguous_date(F.col("d")).alias("a")).collect()
    assert {r["d"]: (r["s"], r["a"]) for r in out} == {"31/12/98": (None, True), "31/12/1998": ("1998-12-31", False)}


def test_user_rule_answers_are_checked(spark):
    from plumbline.rules.adapters import pandas_rule
    from plumbline.rules.registry import Inputs, column_source
    for answer in (None, ("COMPLIANT",), ("a", "b", "c", "d"), "abc", ("", "", "")):
        bound = pandas_rule(lambda v, answer=answer: answer, ["a"])(Inputs(column_source(), {}))
        got = spark.createDataFrame([("x",)], "a string").select(bound.alias("r")).first()["r"]
        assert got["status"] == "INTERNAL_PREREQUISITES_NOT_MET" and "must return" in got["comment"]


def test_parameters_take_defaults_and_are_checked(spark, refs):
    near = {"dwc:decimalLatitude": "42.0", "dwc:decimalLongitude": "8.01", "dwc:countryCode": "FR"}  # some 800 m outside the box
    buffers = {0: {}, 1: {"spatialBufferInMeters": "0"}, 2: {"bdq:spatialBufferInMeters": "5000"}, 3: {"spatialBufferInMeters": "-1"}, 4: {"spatialBufferInMeters": "wide"},
               5: {"spatialBufferInMeters": " "}, 6: {"spatialBufferInMeters": "100"}, 7: {"spatialBufferInMeters": "NaN"}, 8: {"spatialBufferInMeters": "1e7"}}
    rows = [(i, "VALIDATION_COORDINATES_IN_COUNTRY", near | b) for i, b in buffers.items()]
    out = evaluate_requests(spark.createDataFrame(rows, "seq int, id string, params map<string,string>"), REGISTRY, refs).collect()
    got = {r["seq"]: r["result"] or r["status"] for r in out}
    wrong = "INTERNAL_PREREQUISITES_NOT_MET"
    assert got == {0: "COMPLIANT", 1: "NOT_COMPLIANT", 2: "COMPLIANT", 3: wrong, 4: wrong, 5: "COMPLIANT", 6: "NOT_COMPLIANT", 7: wrong, 8: "COMPLIANT"}
    rule = REGISTRY["VALIDATION_EVENTDATE_INRANGE"].with_params(earliestValidDate="junk")
    assert answer(spark, refs, "", rule, eventDate="2000-01-01") == UNMET


def test_rules_that_raise_are_left_out(spark, tmp_path):
    from plumbline.operators.isolate import reason_of, run_stored, write_isolated
    registry = Registry()
    for i in range(5):
        registry.rule(f"VALIDATION_OK{i}", acted=["a"])(B.not_empty("a"))
    registry.rule("VALIDATION_CAST", acted=["a"])(lambda v: B.verdict(v["a"].cast("int") > 0, "y", "n"))
    registry.rule("VALIDATION_DIVIDE", acted=["a", "b"])(lambda v: B.verdict(F.lit(1) / (F.length(v["b"]) - 1) > 0, "y", "n"))
    df = spark.createDataFrame([("p", "x"), ("2", "yy"), ("3", "z")], "a string, b string")
    run = run_stored(df, registry, str(tmp_path / "r"))
    assert {r["test_id"]: r["reason"].split("]")[0] for r in run.failed.collect()} == {"VALIDATION_CAST": "[CAST_INVALID_INPUT", "VALIDATION_DIVIDE": "[DIVIDE_BY_ZERO"}
    counts = {r["test_id"]: r["n"] for r in run.results.groupBy("test_id").agg(F.sum("count").alias("n")).collect()}
    assert counts == {f"VALIDATION_OK{i}": 3 for i in range(5)} and len(run.rules) == 5
    again = run_stored(df.where("a = '2'"), registry.select("VALIDATION_CAST"), str(tmp_path / "r"))  # the folder is replaced
    assert again.failed.count() == 0 and again.results.count() == 1
    none = run_stored(df, registry.select("VALIDATION_CAST"), str(tmp_path / "r"))
    assert none.results.count() == 0 and none.failed.count() == 1

    def lost(some):
        raise PySparkException("Job aborted: ExecutorLostFailure (executor 3 exited)")
    with pytest.raises(PySparkException):  # a fault of the cluster is no rule's fault
        write_isolated(spark, registry.select("VALIDATION_CAST"), lost, str(tmp_path / "x"))
    assert reason_of(ValueError("plain words\nmore")) == "plain words"


def test_failing_rules_do_not_read_the_input_again(spark, tmp_path):
    from plumbline.operators import isolate
    from plumbline.plans.queries_rules import _with_raising
    taken = spark.sparkContext.accumulator(0)

    def seen(text):
        taken.add(1)
        return text

    names = ["dwc:country", "dwc:countryCode", "dwc:basisOfRecord", "dwc:taxonRank"]
    rows = spark.createDataFrame([("NATION_1", "N1", "1-URGENT", "R"), ("", "", "2-HIGH", "A"), ("NATION_2", None, "9", "R")], ", ".join(f"`{n}` string" for n in names))
    rows = rows.withColumn("dwc:taxonRank", F.udf(seen, "string")("dwc:taxonRank"))
    run = isolate.run_stored(rows, _with_raising(), str(tmp_path / "out"), single_pass=True)
    assert taken.value == 3
    counts = {r.test_id: r.records for r in run.results.groupBy("test_id").agg(F.sum("count").alias("records")).collect()}
    assert len(counts) == 5 and set(counts.values()) == {3}
    assert {r.test_id for r in run.failed.collect()} == {"VALIDATION_COUNTRY_NUMBER", "VALIDATION_RANK_SHARE", "VALIDATION_BASIS_PART"}


def test_points_are_read_from_stored_combinations(spark, refs):
    taken = spark.sparkContext.accumulator(0)

    def seen(text):
        taken.add(1)
        return text

    names = ["dwc:decimalLatitude", "dwc:decimalLongitude", "dwc:countryCode"]
    rows = spark.createDataFrame([("40.5", "-100", "US"), ("40.5", "-100", "US"), ("0", "0", "US"), ("x", None, "US")], ", ".join(f"`{n}` string" for n in names))
    rows = rows.withColumn(names[0], F.udf(seen, "string")(names[0]))
    run = run_tests(rows, REGISTRY.select("VALIDATION_COORDINATESCOUNTRYCODE_CONSISTENT"), refs)
    assert sorted((r["count"], r.result) for r in run.results.collect()) == [(1, ""), (1, "NOT_COMPLIANT"), (2, "COMPLIANT")]
    assert taken.value == 4  # the rows are not counted again for each part of the answer
