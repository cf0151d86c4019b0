"""Driver queries over the rule pack: outcomes per test, status and result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import evaluate, isolate
from plumbline.operators.evaluate import run_tests
from plumbline.operators.lookups import References
from plumbline.plans import inputs as I
from plumbline.plans.inputs import Book, table
from plumbline.plans.queries_reference import _backbone, _in_sql, _shapes
from plumbline.rules import base as B
from plumbline.rules.dwc import POINT_VARIANTS, REGISTRY
from plumbline.rules.registry import Registry
from plumbline.session import checkpoint_dir

BOOK = Book()
query = BOOK.query

_OK, _BAD, _UNMET, _SAME = ("RUN_HAS_RESULT", "COMPLIANT"), ("RUN_HAS_RESULT", "NOT_COMPLIANT"), ("INTERNAL_PREREQUISITES_NOT_MET", ""), ("NOT_AMENDED", "")


def _outcomes(df: DataFrame, ids: list[str], refs: References | None = None, **params) -> DataFrame:
    """Rows and combinations per (test, status, result); packed changes are kept in full."""
    rules = [REGISTRY[i].with_params(**params) if params else REGISTRY[i] for i in ids]
    run = run_tests(df, rules, refs)
    return run.results.groupBy("test_id", "status", "result").agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("combos"))


def _case(*branches: tuple[str, tuple[str, str]], default: tuple[str, str]) -> tuple[str, str]:
    """Status and result expressions; results that start with ``=`` are SQL, others are literals."""
    def text(x: str) -> str:
        return x[1:] if x.startswith("=") else "'" + x + "'"
    status = "CASE " + " ".join(f"WHEN {c} THEN {text(o[0])}" for c, o in branches) + f" ELSE {text(default[0])} END"
    result = "CASE " + " ".join(f"WHEN {c} THEN {text(o[1])}" for c, o in branches) + f" ELSE {text(default[1])} END"
    return status, result


def _sql(prefix: str, source: str, tests: dict[str, tuple[list[str], tuple[str, str]]]) -> str:
    parts = []
    for name, (keys, (status, result)) in tests.items():
        cols = ", ".join(f'"{k}"' for k in keys)
        parts.append(f"SELECT '{name}' AS test_id, status, result, CAST(sum(n) AS BIGINT) AS count, count(*) AS combos FROM ("
                     f"SELECT {status} AS status, {result} AS result, n FROM (SELECT {cols}, count(*) AS n FROM {source} GROUP BY ALL)) GROUP BY 2, 3")
    return prefix + "\nUNION ALL ".join(parts)


# --- countries --------------------------------------------------------------------------------------------------

_CODE, _COUNTRY, _LAT, _LON = "dwc:countryCode", "dwc:country", "dwc:decimalLatitude", "dwc:decimalLongitude"


def _places(spark, d) -> DataFrame:
    """Codes in several spellings: as they are, in lower case, three letters, the name, unknown and blank."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 6
    key = F.col("n_nationkey")
    code = (F.when(k == 0, F.concat(F.lit("N"), key)).when(k == 1, F.concat(F.lit("n"), key)).when(k == 2, F.concat(F.lit("NT"), key))
            .when(k == 3, F.col("n_name")).when(k == 4, F.lit("ZZ")))
    country = F.when(F.col("c_custkey") % 5 != 0, F.col("n_name"))
    return c.select(code.alias(_CODE), country.alias(_COUNTRY))


_PLACES = """p AS (SELECT CASE c_custkey % 6 WHEN 0 THEN 'N' || n_nationkey WHEN 1 THEN 'n' || n_nationkey WHEN 2 THEN 'NT' || n_nationkey WHEN 3 THEN n_name WHEN 4 THEN 'ZZ' ELSE '' END AS "dwc:countryCode",
  CASE WHEN c_custkey % 5 <> 0 THEN n_name ELSE '' END AS "dwc:country" FROM customer JOIN nation ON c_nationkey = n_nationkey),
iso AS (SELECT 'N' || n_nationkey AS a2, 'NT' || n_nationkey AS a3, n_name AS name FROM nation WHERE n_nationkey % 4 <> 3)"""


def _iso_table(spark, d) -> DataFrame:
    n = table(spark, d, "nation").filter("n_nationkey % 4 <> 3")
    return n.select(F.concat(F.lit("N"), "n_nationkey").alias("alpha2"), F.concat(F.lit("NT"), "n_nationkey").alias("alpha3"), F.col("n_name").alias("name"))


_C, _N = f'"{_CODE}"', f'"{_COUNTRY}"'
_KNOWN = f"{_C} IN (SELECT a2 FROM iso)"
_TARGET = (f"coalesce((SELECT a2 FROM iso WHERE a2 = upper({_C})), (SELECT a2 FROM iso WHERE a3 = upper({_C})), (SELECT a2 FROM iso WHERE lower(name) = lower({_C})))")


@query("rules_country", _sql(f"WITH {_PLACES}\n", "p", {
    "VALIDATION_COUNTRYCODE_NOTEMPTY": ([_CODE], _case((f"{_C} = ''", _BAD), default=_OK)),
    "VALIDATION_COUNTRYCODE_STANDARD": ([_CODE], _case((f"{_C} = ''", _UNMET), (f"{_KNOWN} OR {_C} = 'ZZ'", _OK), default=_BAD)),
    "VALIDATION_COUNTRY_FOUND": ([_COUNTRY], _case((f"{_N} = ''", _UNMET), (f"{_N} IN (SELECT name FROM iso)", _OK), default=_BAD)),
    "VALIDATION_COUNTRYCOUNTRYCODE_CONSISTENT": ([_COUNTRY, _CODE], _case(
        (f"{_N} = '' OR {_C} = ''", _UNMET), (f"coalesce((SELECT a2 FROM iso WHERE name = {_N}) = {_C}, FALSE)", _OK), default=_BAD)),
    "AMENDMENT_COUNTRYCODE_STANDARDIZED": ([_CODE], _case(
        (f"{_C} = ''", _UNMET), (_KNOWN, _SAME), (f"{_TARGET} IS NOT NULL", ("AMENDED", f"='dwc:countryCode=' || {_TARGET}")), default=_SAME)),
}))
def _(spark, d):
    return _outcomes(_places(spark, d), ["VALIDATION_COUNTRYCODE_NOTEMPTY", "VALIDATION_COUNTRYCODE_STANDARD", "VALIDATION_COUNTRY_FOUND",
                                         "VALIDATION_COUNTRYCOUNTRYCODE_CONSISTENT", "AMENDMENT_COUNTRYCODE_STANDARDIZED"], References(iso=_iso_table(spark, d)))


# --- coordinates ------------------------------------------------------------------------------------------------

def _located(spark, d) -> DataFrame:
    """Orders at their customer's latitude, with the nation's code or none, some of them with swapped fields."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    lat = (F.col("c_acctbal") / 200).cast("decimal(12,5)").cast("string")
    lon = (F.col("o_totalprice") / 3000).cast("decimal(12,5)").cast("string")
    swap = F.col("o_orderkey") % 2 == 1
    return j.select(F.when(swap, lon).otherwise(lat).alias(_LAT), F.when(swap, lat).otherwise(lon).alias(_LON),
                    F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("N"), F.col("o_orderkey") % 25)).alias(_CODE),
                    F.element_at(F.array(F.lit("fish"), F.lit("fox"), F.lit("seal")), (F.col("c_nationkey") % 3 + 1).cast("int")).alias("dwc:scientificName"))


_LOCATED = f"""loc AS (SELECT CASE WHEN o_orderkey % 2 = 1 THEN b ELSE a END AS "{_LAT}", CASE WHEN o_orderkey % 2 = 1 THEN a ELSE b END AS "{_LON}",
  CASE WHEN o_orderkey % 3 <> 0 THEN 'N' || (o_orderkey % 25) ELSE '' END AS "{_CODE}", (['fish', 'fox', 'seal'])[c_nationkey % 3 + 1] AS "dwc:scientificName"
  FROM (SELECT *, CAST(CAST(c_acctbal / 200 AS DECIMAL(12,5)) AS VARCHAR) AS a, CAST(CAST(o_totalprice / 3000 AS DECIMAL(12,5)) AS VARCHAR) AS b
    FROM orders JOIN customer ON o_custkey = c_custkey))"""
_X, _Y = f'CAST("{_LON}" AS DOUBLE)', f'CAST("{_LAT}" AS DOUBLE)'


def _hit(swap: bool, flip_lat: bool, flip_lon: bool, who: str) -> str:
    """SQL: does the variant of the point lie in the nation(s) chosen by ``who``?"""
    a, b = (_X, _Y) if swap else (_Y, _X)
    a, b = (f"(-{a})" if flip_lat else a), (f"(-{b})" if flip_lon else b)
    inner = _in_sql("lat", "lon")
    return f"EXISTS (SELECT 1 FROM nation, (SELECT {a} AS lat, {b} AS lon) WHERE {who} AND {inner})"


_MINE = f"'N' || n_nationkey = {_C}"
_HERE = _hit(*POINT_VARIANTS[0], _MINE)
_FIRST = f"(SELECT 'N' || min(n_nationkey) FROM nation, (SELECT {_Y} AS lat, {_X} AS lon) WHERE {_in_sql('lat', 'lon')})"
_NOCODE = f"{_C} = ''"


def _moved(i: int) -> str:
    swap, flip_lat, flip_lon = POINT_VARIANTS[i]
    a, b = (f'"{_LON}"', f'"{_LAT}"') if swap else (f'"{_LAT}"', f'"{_LON}"')
    def neg(x: str) -> str:
        return f"CASE WHEN {x} LIKE '-%' THEN {x}[2:] ELSE '-' || {x} END"
    a, b = (neg(a) if flip_lat else a), (neg(b) if flip_lon else b)
    return f"='{_LAT}=' || ({a}) || '|{_LON}=' || ({b})"


@query("rules_coordinates", _sql(f"WITH {_LOCATED}\n", "loc", {
    "VALIDATION_COORDINATES_NOTZERO": ([_LAT, _LON], _case((f"{_X} = 0 AND {_Y} = 0", _BAD), default=_OK)),
    "VALIDATION_DECIMALLONGITUDE_INRANGE": ([_LON], _case((f"{_X} BETWEEN -180 AND 180", _OK), default=_BAD)),
    "VALIDATION_COORDINATESCOUNTRYCODE_CONSISTENT": ([_LAT, _LON, _CODE], _case((_NOCODE, _UNMET), (_HERE, _OK), default=_BAD)),
    "AMENDMENT_COUNTRYCODE_FROM_COORDINATES": ([_CODE, _LAT, _LON], _case(
        (f"{_C} <> ''", _UNMET), (f"{_FIRST} IS NOT NULL", ("FILLED_IN", f"='dwc:countryCode=' || {_FIRST}")), default=_SAME)),
    "AMENDMENT_COORDINATES_TRANSPOSED": ([_LAT, _LON, _CODE], _case(
        (_NOCODE, _UNMET), (_HERE, _SAME), *[(_hit(*POINT_VARIANTS[i], _MINE), ("AMENDED", _moved(i))) for i in range(1, 8)], default=_SAME)),
    "VALIDATION_COORDINATESTERRESTRIALMARINE_CONSISTENT": ([_LAT, _LON, "dwc:scientificName"], _case(
        ("\"dwc:scientificName\" = 'seal'", _UNMET), (f"({_FIRST} IS NULL) = (\"dwc:scientificName\" = 'fish')", _OK), default=_BAD)),
}))
def _(spark, d):
    n = table(spark, d, "nation")
    iso = n.select(F.concat(F.lit("N"), "n_nationkey").alias("alpha2"), F.lit("").alias("alpha3"), F.col("n_name").alias("name"))
    shapes = _shapes(spark, d).withColumn("iso_a2", F.concat(F.lit("N"), "poly_id"))
    # Nation names stand in for taxa only to derive the habitat table from a driver table.
    habitat = n.select(F.when(F.col("n_nationkey") % 2 == 0, "fish").otherwise("fox").alias("name"),
                       F.when(F.col("n_nationkey") % 2 == 0, "marine").otherwise("terrestrial").alias("habitat")).distinct()
    path = f"{checkpoint_dir(spark)}/located-{uuid.uuid4().hex}"
    _located(spark, d).write.parquet(path)  # joined and put into text once, then read once per key set
    return _outcomes(spark.read.parquet(path), [
        "VALIDATION_COORDINATES_NOTZERO", "VALIDATION_DECIMALLONGITUDE_INRANGE", "VALIDATION_COORDINATESCOUNTRYCODE_CONSISTENT",
        "AMENDMENT_COUNTRYCODE_FROM_COORDINATES", "AMENDMENT_COORDINATES_TRANSPOSED", "VALIDATION_COORDINATESTERRESTRIALMARINE_CONSISTENT",
    ], References(iso=iso, boundaries=shapes, habitat=habitat))


# --- dates --------------------------------------------------------------------------------------------------------

_DATE = "dwc:eventDate"
_DATED = """dt AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y') ELSE '' END AS "dwc:eventDate",
  CAST(year(o_orderdate) AS VARCHAR) AS "dwc:year", CAST(month(o_orderdate) AS VARCHAR) AS "dwc:month", CASE WHEN o_orderkey % 8 = 0 THEN '31' ELSE CAST(day(o_orderdate) AS VARCHAR) END AS "dwc:day" FROM orders)"""
_D = f'"{_DATE}"'
_SLASH, _YEAR, _EMPTY = f"{_D} LIKE '%/%'", f"length({_D}) = 4", f"{_D} = ''"
_CLEAR = f"(CAST({_D}[1:2] AS INT) > 12 OR {_D}[1:2] = {_D}[4:5])"
_ISO = f"{_D}[7:10] || '-' || {_D}[4:5] || '-' || {_D}[1:2]"


@query("rules_dates", _sql(f"WITH {_DATED}\n", "dt", {
    "VALIDATION_EVENTDATE_NOTEMPTY": ([_DATE], _case((_EMPTY, _BAD), default=_OK)),
    "VALIDATION_EVENTDATE_STANDARD": ([_DATE], _case((_EMPTY, _UNMET), (_SLASH, _BAD), default=_OK)),
    "ISSUE_EVENTDATE_AMBIGUOUS": ([_DATE], _case((_EMPTY, _UNMET), (f"{_SLASH} AND NOT {_CLEAR}", ("RUN_HAS_RESULT", "POTENTIAL_ISSUE")), default=("RUN_HAS_RESULT", "NOT_ISSUE"))),
    "EVENT_DATE_PRECISON_JULIAN_YEAR_OR_BETTER": ([_DATE], _case((f"{_EMPTY} OR {_SLASH}", _UNMET), (f"{_YEAR} AND CAST({_D} AS INT) % 4 = 0", _BAD), default=_OK)),
    "AMENDMENT_EVENTDATE_STANDARDIZED": ([_DATE], _case((_EMPTY, _UNMET), (f"{_SLASH} AND {_CLEAR}", ("AMENDED", f"='dwc:eventDate=' || {_ISO}")), (_SLASH, ("AMBIGUOUS", "")), default=_SAME)),
    "VALIDATION_EVENT_CONSISTENT": ([_DATE, "dwc:year", "dwc:month", "dwc:day"], _case(
        (f"{_EMPTY} OR {_SLASH}", _UNMET), (f"NOT {_YEAR} AND CAST({_D}[9:10] AS INT) <> CAST(\"dwc:day\" AS INT)", _BAD), default=_OK)),
}))
def _(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 2, F.date_format("o_orderdate", "yyyy"))
    df = o.select(text.alias(_DATE), F.year("o_orderdate").alias("dwc:year"), F.month("o_orderdate").alias("dwc:month"),
                  F.when(F.col("o_orderkey") % 8 == 0, 31).otherwise(F.dayofmonth("o_orderdate")).alias("dwc:day"))
    return _outcomes(df, ["VALIDATION_EVENTDATE_NOTEMPTY", "VALIDATION_EVENTDATE_STANDARD", "ISSUE_EVENTDATE_AMBIGUOUS", "EVENT_DATE_PRECISON_JULIAN_YEAR_OR_BETTER",
                          "AMENDMENT_EVENTDATE_STANDARDIZED", "VALIDATION_EVENT_CONSISTENT"])


# --- names, identifiers, measures -----------------------------------------------------------------------------------

_TAXA = """tx AS (SELECT CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name[1]) || p_name[2:] WHEN 2 THEN p_name || ' x9' ELSE '' END AS "dwc:scientificName",
  CASE WHEN p_size % 3 = 0 THEN 'NOPE' ELSE p_type END AS "dwc:phylum", (['sp.', 'Species', 'species', 'what', ''])[p_size % 5 + 1] AS "dwc:taxonRank" FROM part)"""
_NAME, _RANK = '"dwc:scientificName"', '"dwc:taxonRank"'
_CAPITAL = f"upper({_NAME}[1]) || {_NAME}[2:]"


@query("rules_taxon", _sql(f"WITH {_TAXA}\n", "tx", {
    "VALIDATION_SCIENTIFICNAME_FOUND": (["dwc:scientificName"], _case((f"{_NAME} = ''", _UNMET), (f"lower({_NAME}) IN (SELECT lower(p_name) FROM part)", _OK), default=_BAD)),
    "VALIDATION_SCIENTIFICNAME_FORMAT": (["dwc:scientificName"], _case((f"{_NAME} = ''", _UNMET), (f"regexp_matches({_NAME}, '^[A-Z][a-z]+ [a-z]+')", _OK), default=_BAD)),
    "AMENDMENT_SCIENTIFICNAME_CORRECTED": (["dwc:scientificName"], _case(
        (f"{_NAME} = ''", _UNMET), (f"regexp_full_match({_NAME}, '[a-z]+ [a-z]+')", ("AMENDED", f"='dwc:scientificName=' || {_CAPITAL}")), default=_SAME)),
    "VALIDATION_PHYLUM_FOUND": (["dwc:phylum"], _case(("\"dwc:phylum\" = 'NOPE'", _BAD), default=_OK)),
    "VALIDATION_TAXONRANK_STANDARD": (["dwc:taxonRank"], _case((f"{_RANK} = ''", _UNMET), (f"{_RANK} = 'species'", _OK), default=_BAD)),
    "AMENDMENT_TAXONRANK_STANDARDIZED": (["dwc:taxonRank"], _case(
        (f"{_RANK} = ''", _UNMET), (f"{_RANK} IN ('sp.', 'Species')", ("AMENDED", "dwc:taxonRank=species")), default=_SAME)),
}))
def _(spark, d):
    p, k, name = table(spark, d, "part"), F.col("p_size") % 4, F.col("p_name")
    text = F.when(k == 0, name).when(k == 1, F.concat(F.upper(F.substring(name, 1, 1)), F.substr(name, F.lit(2)))).when(k == 2, F.concat(name, F.lit(" x9")))
    ranks = F.array(*[F.lit(x) for x in ("sp.", "Species", "species", "what", "")])
    df = p.select(text.alias("dwc:scientificName"), F.when(F.col("p_size") % 3 == 0, "NOPE").otherwise(F.col("p_type")).alias("dwc:phylum"),
                  F.element_at(ranks, (F.col("p_size") % 5 + 1).cast("int")).alias("dwc:taxonRank"))
    return _outcomes(df, ["VALIDATION_SCIENTIFICNAME_FOUND", "VALIDATION_SCIENTIFICNAME_FORMAT", "AMENDMENT_SCIENTIFICNAME_CORRECTED", "VALIDATION_PHYLUM_FOUND",
                          "VALIDATION_TAXONRANK_STANDARD", "AMENDMENT_TAXONRANK_STANDARDIZED"], References(backbone=_backbone(spark, d)))


_LOW, _HIGH, _VERB = "dwc:minimumDepthInMeters", "dwc:maximumDepthInMeters", "dwc:verbatimDepth"
_MIN, _MAX = "dwc:minimumElevationInMeters", "dwc:maximumElevationInMeters"
_UNC, _LIC, _ID = "dwc:coordinateUncertaintyInMeters", "dwc:license", "dwc:occurrenceID"
_MEASURES = f"""ms AS (SELECT CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS "{_LOW}", CASE WHEN p_size % 3 = 0 THEN '20' ELSE '' END AS "{_HIGH}",
  CASE WHEN p_size % 5 = 0 THEN 'deep' ELSE p_size || ' m' END AS "{_VERB}", CAST(p_size * 400 AS VARCHAR) AS "{_MIN}", CAST(9000 - p_size AS VARCHAR) AS "{_MAX}",
  CAST(p_size AS VARCHAR) AS "{_LAT}", '1' AS "{_LON}", CASE WHEN p_size % 2 = 0 THEN '10' ELSE '' END AS "{_UNC}",
  (['CC0', 'https://creativecommons.org/licenses/by/4.0/', 'mine', ''])[p_size % 4 + 1] AS "{_LIC}",
  (['', 'urn:x1:' || p_brand, 'https://example.org/o/' || p_partkey, 'plain'])[p_partkey % 4 + 1] AS "{_ID}" FROM part)"""


def _num(c: str) -> str:
    return f'TRY_CAST("{c}" AS DOUBLE)'


@query("rules_measures", _sql(f"WITH {_MEASURES}\n", "ms", {
    "VALIDATION_MINDEPTH_LESSTHAN_MAXDEPTH": ([_LOW, _HIGH], _case((f'"{_LOW}" = \'\'', _UNMET), (f"{_num(_LOW)} <= {_num(_HIGH)}", _OK), default=_BAD)),
    "VALIDATION_MINELEVATION_LESSTHAN_MAXELEVATION": ([_MIN, _MAX], _case((f"{_num(_MIN)} <= {_num(_MAX)}", _OK), default=_BAD)),
    "VALIDATION_MINELEVATION_INRANGE": ([_MIN], _case((f"{_num(_MIN)} BETWEEN -430 AND 8850", _OK), default=_BAD)),
    "VALIDATION_MAXELEVATION_INRANGE": ([_MAX], _case((f"{_num(_MAX)} BETWEEN -430 AND 8850", _OK), default=_BAD)),
    "AMENDMENT_MINDEPTHMAXDEPTH_FROM_VERBATIM": ([_LOW, _HIGH, _VERB], _case(
        (f'"{_LOW}" <> \'\'', _UNMET), (f'"{_VERB}" = \'deep\'', _SAME),
        default=("FILLED_IN", f"='{_LOW}=' || split_part(\"{_VERB}\", ' ', 1) || '|{_HIGH}=' || split_part(\"{_VERB}\", ' ', 1)"))),
    "ISSUE_COORDINATES_WITHOUT_UNCERTAINTY": ([_LAT, _LON, _UNC], _case((f'"{_UNC}" = \'\'', ("RUN_HAS_RESULT", "POTENTIAL_ISSUE")), default=("RUN_HAS_RESULT", "NOT_ISSUE"))),
    "VALIDATION_LICENSE_NOTEMPTY": ([_LIC], _case((f'"{_LIC}" = \'\'', _BAD), default=_OK)),
    "VALIDATION_LICENSE_STANDARD": ([_LIC], _case((f'"{_LIC}" = \'\'', _UNMET), (f'"{_LIC}" = \'mine\'', _BAD), default=_OK)),
    "VALIDATION_OCCURRENCEID_NOTEMPTY": ([_ID], _case((f'"{_ID}" = \'\'', _BAD), default=_OK)),
    "VALIDATION_OCCURRENCEID_STANDARD": ([_ID], _case((f'"{_ID}" = \'\'', _UNMET), (f'"{_ID}" = \'plain\'', _BAD), default=_OK)),
}))
def _(spark, d):
    p, size = table(spark, d, "part"), F.col("p_size")
    third = size % 3 == 0
    licenses = F.array(*[F.lit(x) for x in ("CC0", "https://creativecommons.org/licenses/by/4.0/", "mine", "")])
    ids = F.array(F.lit(""), F.concat(F.lit("urn:x1:"), "p_brand"), F.concat(F.lit("https://example.org/o/"), "p_partkey"), F.lit("plain"))
    df = p.select(
        F.when(third, size).alias(_LOW), F.when(third, 20).alias(_HIGH), F.when(size % 5 == 0, "deep").otherwise(F.concat(size, F.lit(" m"))).alias(_VERB),
        (size * 400).alias(_MIN), (9000 - size).alias(_MAX), size.alias(_LAT), F.lit("1").alias(_LON), F.when(size % 2 == 0, "10").alias(_UNC),
        F.element_at(licenses, (size % 4 + 1).cast("int")).alias(_LIC), F.element_at(ids, (F.col("p_partkey") % 4 + 1).cast("int")).alias(_ID))
    return _outcomes(df, ["VALIDATION_MINDEPTH_LESSTHAN_MAXDEPTH", "VALIDATION_MINELEVATION_LESSTHAN_MAXELEVATION", "VALIDATION_MINELEVATION_INRANGE",
                          "VALIDATION_MAXELEVATION_INRANGE", "AMENDMENT_MINDEPTHMAXDEPTH_FROM_VERBATIM", "ISSUE_COORDINATES_WITHOUT_UNCERTAINTY",
                          "VALIDATION_LICENSE_NOTEMPTY", "VALIDATION_LICENSE_STANDARD", "VALIDATION_OCCURRENCEID_NOTEMPTY", "VALIDATION_OCCURRENCEID_STANDARD"])


# --- records: presence, terms, ranges, degrees ---------------------------------------------------------------------

_BASIS, _NAME = "dwc:basisOfRecord", "dwc:scientificName"
_VERBATIM = ["dwc:verbatimLatitude", "dwc:verbatimLongitude", "dwc:verbatimSRS"]
_RECORDS = f"""rec AS (SELECT (['HumanObservation', 'human observation', 'PRESERVED_SPECIMEN', 'nothing', ''])[c_custkey % 5 + 1] AS "{_BASIS}",
  (['45.5', '95.5', '', 'x'])[c_custkey % 4 + 1] AS "{_LAT}", (['-120.5', '181', '  '])[c_custkey % 3 + 1] AS "{_LON}",
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS "{_NAME}" FROM customer)"""


def _blank_sql(c: str) -> str:
    return f"trim(\"{c}\") = ''"


def _range_sql(c: str, limit: int) -> tuple[str, str]:
    n = f'TRY_CAST(trim("{c}") AS DOUBLE)'
    return _case((f"{n} IS NULL", _UNMET), (f"{n} BETWEEN -{limit} AND {limit}", _OK), default=_BAD)


@query("rules_records", _sql(f"WITH {_RECORDS}\n", "rec", {
    "VALIDATION_BASISOFRECORD_NOTEMPTY": ([_BASIS], _case((_blank_sql(_BASIS), _BAD), default=_OK)),
    "VALIDATION_BASISOFRECORD_STANDARD": ([_BASIS], _case((_blank_sql(_BASIS), _UNMET), (f"\"{_BASIS}\" = 'HumanObservation'", _OK), default=_BAD)),
    "AMENDMENT_BASISOFRECORD_STANDARDIZED": ([_BASIS], _case(
        (_blank_sql(_BASIS), _UNMET), (f"\"{_BASIS}\" = 'human observation'", ("AMENDED", f"{_BASIS}=HumanObservation")),
        (f"\"{_BASIS}\" = 'PRESERVED_SPECIMEN'", ("AMENDED", f"{_BASIS}=PreservedSpecimen")), default=_SAME)),
    "VALIDATION_DECIMALLATITUDE_NOTEMPTY": ([_LAT], _case((_blank_sql(_LAT), _BAD), default=_OK)),
    "VALIDATION_DECIMALLONGITUDE_NOTEMPTY": ([_LON], _case((_blank_sql(_LON), _BAD), default=_OK)),
    "VALIDATION_DECIMALLATITUDE_VALID": ([_LAT], _range_sql(_LAT, 90)),
    "VALIDATION_DECIMALLONGITUDE_VALID": ([_LON], _range_sql(_LON, 180)),
    "VALIDATION_SCIENTIFICNAME_NOTEMPTY": ([_NAME], _case((_blank_sql(_NAME), _BAD), default=_OK)),
}))
def _(spark, d):
    k = F.col("c_custkey")

    def of(*texts: str):
        return F.element_at(F.array(*[F.lit(t) for t in texts]), (k % len(texts) + 1).cast("int"))

    rows = table(spark, d, "customer").select(
        of("HumanObservation", "human observation", "PRESERVED_SPECIMEN", "nothing", "").alias(_BASIS), of("45.5", "95.5", "", "x").alias(_LAT),
        of("-120.5", "181", "  ").alias(_LON), F.when(k % 7 != 0, F.col("c_mktsegment")).alias(_NAME))
    return _outcomes(rows, ["VALIDATION_BASISOFRECORD_NOTEMPTY", "VALIDATION_BASISOFRECORD_STANDARD", "AMENDMENT_BASISOFRECORD_STANDARDIZED",
                            "VALIDATION_DECIMALLATITUDE_NOTEMPTY", "VALIDATION_DECIMALLONGITUDE_NOTEMPTY", "VALIDATION_DECIMALLATITUDE_VALID",
                            "VALIDATION_DECIMALLONGITUDE_VALID", "VALIDATION_SCIENTIFICNAME_NOTEMPTY"])


_DEGREES = f"""deg AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN '12.25' ELSE (c_custkey % 90) || '°30''0"N' END AS "{_LAT}",
  CASE WHEN c_custkey % 4 = 1 THEN '7' ELSE (c_custkey % 170) || '°15''0"W' END AS "{_LON}", '' AS "dwc:geodeticDatum",
  (c_custkey % 90) || '°30''0"S' AS "{_VERBATIM[0]}", CASE WHEN c_custkey % 5 = 0 THEN 'east' ELSE ' ' || (c_custkey % 170) || '.5' END AS "{_VERBATIM[1]}",
  CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'EPSG:4326' END AS "{_VERBATIM[2]}" FROM customer)"""
_WHOLE = """regexp_extract("{}", '^ ?([0-9]+)', 1)"""


@query("rules_degrees", _sql(f"WITH {_DEGREES}\n", "deg", {
    "AMENDMENT_COORDINATES_DECIMAL": ([_LAT, _LON], _case(
        (f"\"{_LAT}\" = ''", _UNMET), (f"\"{_LAT}\" = '12.25'", _SAME),
        default=("AMENDED", f"='{_LAT}=' || {_WHOLE.format(_LAT)} || '.5|{_LON}=-' || {_WHOLE.format(_LON)} || '.25'"))),
}) + "\nUNION ALL " + _sql("", f"(SELECT '' AS \"{_LAT}\", '' AS \"{_LON}\", * EXCLUDE (\"{_LAT}\", \"{_LON}\") FROM deg)", {
    "AMENDMENT_COORDINATES_FROM_VERBATIM": ([_LAT, _LON, "dwc:geodeticDatum", *_VERBATIM], _case(
        (f"\"{_VERBATIM[2]}\" = ''", _UNMET), (f"\"{_VERBATIM[1]}\" = 'east'", _SAME),
        default=("FILLED_IN", f"='{_LAT}=-' || {_WHOLE.format(_VERBATIM[0])} || '.5|{_LON}=' || trim(\"{_VERBATIM[1]}\") || '|dwc:geodeticDatum=EPSG:4326'"))),
}))
def _(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        F.when(k % 4 == 1, "12.25").when(k % 4 > 1, F.format_string("%d°30'0\"N", k % 90)).alias(_LAT),
        F.when(k % 4 == 1, "7").otherwise(F.format_string("%d°15'0\"W", k % 170)).alias(_LON), F.lit("").alias("dwc:geodeticDatum"),
        F.format_string("%d°30'0\"S", k % 90).alias(_VERBATIM[0]), F.when(k % 5 == 0, "east").otherwise(F.format_string(" %d.5", k % 170)).alias(_VERBATIM[1]),
        F.when(k % 6 == 0, "").otherwise("EPSG:4326").alias(_VERBATIM[2]))
    own = _outcomes(rows, ["AMENDMENT_COORDINATES_DECIMAL"])
    return own.unionByName(_outcomes(rows.withColumns({_LAT: F.lit(""), _LON: F.lit("")}), ["AMENDMENT_COORDINATES_FROM_VERBATIM"]))


# --- requests with parameters, rules that raise --------------------------------------------------------------------

_BUFFERED = "VALIDATION_COORDINATES_IN_COUNTRY"
_ASKED_SQL = """asked AS (SELECT o_orderkey AS seq, o_orderkey % 25 AS n, c_acctbal / 50 AS lat, o_totalprice / 1000 AS lon,
  CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 2 THEN 200000 WHEN 3 THEN 1000 * (o_orderkey % 7) ELSE 3000 END AS buffer,
  o_orderkey % 5 = 4 AS junk FROM orders JOIN customer ON o_custkey = c_custkey)"""
_FAR_SQL = ("sqrt(pow(greatest(n * 7 - lon, 0, lon - n * 7 - 6) * cos(radians(lat)) * 111195.0, 2) + pow(greatest(-20 - lat, 0, lat - 60) * 111195.0, 2))")


def _buffered(spark, d):
    """Orders as requests about a point and a country: no buffer, the published default, wide ones, one by order, and junk."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    k = F.col("o_orderkey") % 5
    buffer = F.when(k == 0, "0").when(k == 2, "200000").when(k == 3, (1000 * (F.col("o_orderkey") % 7)).cast("string")).when(k == 4, "near").otherwise(" ")
    params = F.create_map(F.lit(_LAT), (F.col("c_acctbal") / 50).cast("string"), F.lit(_LON), (F.col("o_totalprice") / 1000).cast("string"),
                          F.lit(_CODE), F.concat(F.lit("N"), F.col("o_orderkey") % 25), F.lit("bdq:spatialBufferInMeters"), buffer)
    requests = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("seq"), F.lit(_BUFFERED).alias("id"), params.alias("params"))
    n = table(spark, d, "nation")
    iso = n.select(F.concat(F.lit("N"), "n_nationkey").alias("alpha2"), F.lit("").alias("alpha3"), F.col("n_name").alias("name"))
    shapes = _shapes(spark, d, boxes=True).withColumn("iso_a2", F.concat(F.lit("N"), "poly_id"))
    return evaluate.evaluate_requests(requests, REGISTRY.select(_BUFFERED), References(iso=iso, boundaries=shapes))


@query("requests_with_buffer", f"""WITH {_ASKED_SQL} SELECT seq, CASE WHEN {_FAR_SQL} <= buffer THEN 'COMPLIANT' ELSE 'NOT_COMPLIANT' END AS result
FROM asked WHERE NOT junk""")
def _(spark, d):
    return _buffered(spark, d).where("seq % 5 <> 4").select("seq", "result")


@query("evaluate_requests_bad_params", f"""WITH {_ASKED_SQL} SELECT seq, '{_BUFFERED}' AS test_id, 'INTERNAL_PREREQUISITES_NOT_MET' AS status, '' AS result,
  'Parameter spatialBufferInMeters is no number: near' AS comment FROM asked WHERE junk
UNION ALL SELECT event_id, 'VALIDATION_EVENTDATE_INRANGE', CASE WHEN event_id % 3 = 2 THEN 'RUN_HAS_RESULT' ELSE 'INTERNAL_PREREQUISITES_NOT_MET' END,
  CASE WHEN event_id % 3 = 2 THEN 'COMPLIANT' ELSE '' END,
  CASE event_id % 3 WHEN 0 THEN 'Parameter earliestValidDate is no date: junk' WHEN 1 THEN 'Parameter latestValidDate is no date: 2024-13-45'
    ELSE 'eventDate lies within the valid range.' END FROM events""")
def _(spark, d):
    k = F.col("event_id") % 3
    params = F.create_map(F.lit("dwc:eventDate"), F.date_format("ts", "yyyy-MM-dd"), F.lit("earliestValidDate"), F.when(k == 0, "junk").otherwise(""),
                          F.lit("bdq:latestValidDate"), F.when(k == 1, "2024-13-45"))
    dated = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.lit("VALIDATION_EVENTDATE_INRANGE").alias("id"), params.alias("params"))
    answers = evaluate.evaluate_requests(dated, REGISTRY.select("VALIDATION_EVENTDATE_INRANGE"))
    columns = ["seq", "test_id", "status", "result", "comment"]
    return _buffered(spark, d).where("seq % 5 = 4").select(*columns).unionByName(answers.select(*columns))


def _with_raising():
    """The rules of the occurrence view and three that raise in a task: on some values, on one value, on all."""
    rules = Registry()
    for r in I.OCC_RULES:
        rules.add(r)
    rules.rule("VALIDATION_COUNTRY_NUMBER", acted=["dwc:country"], consulted=["dwc:countryCode"])(
        lambda v: B.verdict(v["dwc:country"].cast("int") > 0, "It is.", "It is not."))
    rules.rule("VALIDATION_RANK_SHARE", acted=["dwc:taxonRank"])(
        lambda v: B.verdict(F.lit(1) / F.when(v["dwc:taxonRank"] == "R", 0).otherwise(1) > 0, "It is.", "It is not."))
    rules.rule("VALIDATION_BASIS_PART", acted=["dwc:basisOfRecord"])(
        lambda v: B.verdict(F.element_at(F.split(v["dwc:basisOfRecord"], "-"), 5) == "x", "It is.", "It is not."))
    return rules


@query("failed_tests", I.with_results("""SELECT test_id, sum(count)::BIGINT AS records, '' AS reason FROM results GROUP BY test_id
UNION ALL SELECT * FROM (VALUES ('VALIDATION_COUNTRY_NUMBER', 0::BIGINT, 'CAST_INVALID_INPUT'), ('VALIDATION_RANK_SHARE', 0::BIGINT, 'DIVIDE_BY_ZERO'),
  ('VALIDATION_BASIS_PART', 0::BIGINT, 'INVALID_ARRAY_INDEX_IN_ELEMENT_AT')) AS f(test_id, records, reason)"""))
def _(spark, d):
    run = isolate.run_stored(I.occ(spark, d), _with_raising(), f"{checkpoint_dir(spark)}/failed-{uuid.uuid4().hex}", single_pass=True)
    answered = run.results.groupBy("test_id").agg(F.sum("count").alias("records")).withColumn("reason", F.lit(""))
    failed = run.failed.select("test_id", F.lit(0).cast("bigint").alias("records"), F.regexp_extract("reason", r"^\[([A-Z_]+)", 1).alias("reason"))
    return answered.unionByName(failed)
