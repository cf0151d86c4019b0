"""The driver tables as inputs: a Darwin-Core-shaped view, a rule set for it, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.names import RESULT_COLUMNS
from plumbline.operators.catalogue import context_of
from plumbline.operators.evaluate import run_tests
from plumbline.rules import base as B
from plumbline.rules.dwc import REGISTRY as DWC
from plumbline.rules.registry import Inputs, Registry, catalogue_of

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Registered driver queries and, where SQL can say the same, their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn
        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the occurrence view --------------------------------------------------------------------------------

def occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as occurrence records. Coordinates go through decimals so that their text is exact; two
    fields hold blanks."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = (
        li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
    )
    text = {
        "dwc:occurrenceID": F.concat(F.lit("urn:li:"), "l_orderkey", F.lit(":"), "l_linenumber"),
        "dwc:eventDate": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "dwc:country": F.when(F.col("n_nationkey") % 7 != 0, F.col("n_name")),
        "dwc:countryCode": F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("N"), "n_nationkey")),
        "dwc:decimalLatitude": (F.col("c_acctbal") / 50).cast("decimal(12,5)").cast("string"),
        "dwc:decimalLongitude": (F.col("o_totalprice") / 1000).cast("decimal(12,5)").cast("string"),
        "dwc:basisOfRecord": F.col("o_orderpriority"),
        "dwc:taxonRank": F.col("l_returnflag"),
    }
    return joined.select(*[e.alias(n) for n, e in text.items()])


OCC_SQL = """occ AS (
  SELECT 'urn:li:' || l_orderkey || ':' || l_linenumber AS "dwc:occurrenceID",
         strftime(o_orderdate, '%Y-%m-%d') AS "dwc:eventDate",
         CASE WHEN n_nationkey % 7 <> 0 THEN n_name ELSE '' END AS "dwc:country",
         CASE WHEN n_nationkey % 5 <> 0 THEN 'N' || n_nationkey ELSE '' END AS "dwc:countryCode",
         CAST(CAST(c_acctbal / 50 AS DECIMAL(12,5)) AS VARCHAR) AS "dwc:decimalLatitude",
         CAST(CAST(o_totalprice / 1000 AS DECIMAL(12,5)) AS VARCHAR) AS "dwc:decimalLongitude",
         o_orderpriority AS "dwc:basisOfRecord", l_returnflag AS "dwc:taxonRank"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey)"""

# --- the rules run over it ------------------------------------------------------------------------------

OCC_RULES = Registry()
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
FLAGS = {"A": "accepted", "R": "returned"}
LATEST = "1999-12-31"

OCC_RULES.rule("VALIDATION_COUNTRY_NOTEMPTY", acted=["dwc:country"], consulted=["dwc:countryCode"],
               ie_class="dcterms:Location", usecases=("Record-Management", "Spatial-Temporal_Patterns"),
               description="Is there a country?")(B.not_empty("dwc:country"))
OCC_RULES.add(DWC["VALIDATION_DECIMALLATITUDE_INRANGE"])
OCC_RULES.rule("VALIDATION_BASISOFRECORD_STANDARD", acted=["dwc:basisOfRecord"], ie_class="dwc:Record-level",
               usecases=("Record-Management",), description="Is the basis listed?")(
    B.in_vocabulary("dwc:basisOfRecord", PRIORITIES))
OCC_RULES.add(DWC["VALIDATION_EVENTDATE_INRANGE"].with_params(latestValidDate=LATEST))
OCC_RULES.rule("AMENDMENT_TAXONRANK_STANDARDIZED", "Amendment", acted=["dwc:taxonRank"], ie_class="dwc:Taxon",
               usecases=("Taxon-Management",), description="Propose the long flag.")(
    B.standardize("dwc:taxonRank", lambda v: B.lookup_literal(v["dwc:taxonRank"], FLAGS), lambda v: v["dwc:taxonRank"] == "N"))
OCC_RULES.rule("VALIDATION_TAXONRANK_STANDARD", acted=["dwc:taxonRank"], ie_class="dwc:Taxon", usecases=("Taxon-Management",),
               description="Is the flag listed?")(B.in_vocabulary("dwc:taxonRank", ["N"]))
OCC_RULES.rule("AMENDMENT_COUNTRYCODE_FROM_COUNTRY", "Amendment", acted=["dwc:countryCode"], consulted=["dwc:country"],
               ie_class="dcterms:Location", usecases=("Spatial-Temporal_Patterns",), description="Fill the code from the country.")(
    B.fill_from({"dwc:countryCode": lambda v: F.concat(F.lit("X"), F.substring_index(v["dwc:country"], "_", -1))}, ["dwc:country"]))


@OCC_RULES.rule("ISSUE_EVENTDATE_YEARSTART", "Issue", acted=["dwc:eventDate"], ie_class="dwc:Event",
                usecases=("Spatial-Temporal_Patterns",))
def year_start(v: Inputs):
    """Does the date fall on the first of January?"""
    return B.issue(v["dwc:eventDate"].endswith("-01-01"), "First day of a year.", "Not the first day of a year.")


# Left out of the context catalogue, so that a result without context exists.
NO_CONTEXT = "ISSUE_EVENTDATE_YEARSTART"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of the eight tests; one pass over the join, since producing its rows is the dear part."""
    return run_tests(occ(spark, sf_dir), OCC_RULES, single_pass=True).results


def context(spark: SparkSession) -> DataFrame:
    return context_of(catalogue_of(spark, [r for r in OCC_RULES if r.id != NO_CONTEXT]))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pairs_sql(cols) -> str:
    return " || '|' || ".join(f"{_quote(c + '=')} || \"{c}\"" for c in cols) or "''"


def result_sql(rule_id: str, status: str, result: str, comment: str, rules: Registry = OCC_RULES, source: str = "occ") -> str:
    """One test as a grouped SELECT; status, result and comment are SQL expressions over the group columns."""
    r = rules[rule_id]
    keys = ", ".join(f'"{c}"' for c in r.columns)
    return (
        f"SELECT {_quote(r.id)} AS test_id, {_quote(r.type)} AS test_type, {status} AS status, {result} AS result, "
        f"{comment} AS comment, {_pairs_sql(r.acted)} AS \"actedUpon\", {_pairs_sql(r.consulted)} AS consulted, "
        f"{_quote('|'.join(r.acted))} AS \"actedUpon_cols\", {_quote('|'.join(r.consulted))} AS consulted_cols, "
        f"count(*) AS count FROM {source} GROUP BY {keys}")


HAS = "'RUN_HAS_RESULT'"


def verdict_sql(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 'COMPLIANT' ELSE 'NOT_COMPLIANT' END"


def when_sql(cond: str, yes: str, no: str) -> str:
    return f"CASE WHEN {cond} THEN {_quote(yes)} ELSE {_quote(no)} END"


_LAT = "TRY_CAST(\"dwc:decimalLatitude\" AS DOUBLE) BETWEEN -90 AND 90"
_BASIS = "\"dwc:basisOfRecord\" IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"
_DATE = f"\"dwc:eventDate\" BETWEEN '1582-11-15' AND '{LATEST}'"
_FLAG = "\"dwc:taxonRank\" IN ('A', 'R')"
_LONG = "CASE \"dwc:taxonRank\" WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' END"
_BLANK_CODE, _BLANK_COUNTRY = "\"dwc:countryCode\" = ''", "\"dwc:country\" = ''"
_FILL = f"({_BLANK_CODE} AND NOT {_BLANK_COUNTRY})"

RESULTS_SQL = OCC_SQL + ",\nresults AS (\n" + "\nUNION ALL ".join([
    result_sql("VALIDATION_COUNTRY_NOTEMPTY", HAS, verdict_sql(f"NOT {_BLANK_COUNTRY}"),
               when_sql(f"NOT {_BLANK_COUNTRY}", "dwc:country contains a value.", "dwc:country is empty.")),
    result_sql("VALIDATION_DECIMALLATITUDE_INRANGE", HAS, verdict_sql(_LAT),
               when_sql(_LAT, "dwc:decimalLatitude is between -90 and 90 inclusive.", "dwc:decimalLatitude is outside the range -90 to 90.")),
    result_sql("VALIDATION_BASISOFRECORD_STANDARD", HAS, verdict_sql(_BASIS),
               f"CASE WHEN {_BASIS} THEN 'dwc:basisOfRecord is a listed term.' "
               f"ELSE 'dwc:basisOfRecord [' || \"dwc:basisOfRecord\" || '] is not a listed term.' END"),
    result_sql("VALIDATION_EVENTDATE_INRANGE", HAS, verdict_sql(_DATE),
               when_sql(_DATE, "eventDate lies within the valid range.", "eventDate lies outside the valid range.")),
    result_sql("AMENDMENT_TAXONRANK_STANDARDIZED", f"CASE WHEN {_FLAG} THEN 'AMENDED' ELSE 'NOT_AMENDED' END",
               f"CASE WHEN {_FLAG} THEN 'dwc:taxonRank=' || {_LONG} ELSE '' END",
               when_sql(_FLAG, "dwc:taxonRank standardised.", "dwc:taxonRank already has a standard value.")),
    result_sql("VALIDATION_TAXONRANK_STANDARD", HAS, verdict_sql("\"dwc:taxonRank\" = 'N'"),
               "CASE WHEN \"dwc:taxonRank\" = 'N' THEN 'dwc:taxonRank is a listed term.' "
               "ELSE 'dwc:taxonRank [' || \"dwc:taxonRank\" || '] is not a listed term.' END"),
    result_sql("AMENDMENT_COUNTRYCODE_FROM_COUNTRY",
               f"CASE WHEN {_FILL} THEN 'FILLED_IN' ELSE 'INTERNAL_PREREQUISITES_NOT_MET' END",
               f"CASE WHEN {_FILL} THEN 'dwc:countryCode=X' || split_part(\"dwc:country\", '_', 2) ELSE '' END",
               f"CASE WHEN NOT {_BLANK_CODE} THEN 'Not altering existing values of dwc:countryCode.' "
               f"WHEN {_BLANK_COUNTRY} THEN 'dwc:country is empty.' ELSE 'Filled in from dwc:country.' END"),
    result_sql("ISSUE_EVENTDATE_YEARSTART", HAS,
               "CASE WHEN \"dwc:eventDate\" LIKE '%-01-01' THEN 'POTENTIAL_ISSUE' ELSE 'NOT_ISSUE' END",
               when_sql("\"dwc:eventDate\" LIKE '%-01-01'", "First day of a year.", "Not the first day of a year.")),
]) + ")"

CONTEXT_SQL = "context AS (SELECT * FROM (VALUES\n  " + ",\n  ".join(
    "(" + ", ".join(_quote(x) for x in (r.id, r.description, r.notes, r.type, r.ie_class, ",".join(r.acted),
                                        ",".join(r.consulted), ",".join(r.usecases))) + ")"
    for r in OCC_RULES if r.id != NO_CONTEXT
) + ") AS v(test_id, description, notes, type, ie_class, ie_acted_upon, ie_consulted, usecases))"

BASE = ", ".join(f'"{c}"' for c in RESULT_COLUMNS)


def with_results(body: str) -> str:
    return f"WITH {RESULTS_SQL}\n{body}"


def with_context(body: str) -> str:
    """Results, catalogue and their join as ``joined``."""
    fills = {"description": "No description available", "notes": "No notes available", "ie_class": "Unknown",
             "ie_acted_upon": "", "ie_consulted": "", "type": "", "usecases": ""}
    filled = ", ".join(f"coalesce(c.{k}, {_quote(v)}) AS {k}" for k, v in fills.items())
    return (f"WITH {RESULTS_SQL},\n{CONTEXT_SQL},\njoined AS (SELECT r.*, {filled} "
            f"FROM results r LEFT JOIN context c USING (test_id))\n{body}")


def flat(df: DataFrame) -> DataFrame:
    """Result rows without the typed maps."""
    return df.select(*RESULT_COLUMNS)
