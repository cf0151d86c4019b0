"""Driver queries over combinations, evaluation, catalogue and amendments."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import names as N
from plumbline.functions import text as X
from plumbline.functions.dates import duration_days, has_leap_day, iso_interval, standard_date
from plumbline.operators import amend, catalogue, combos, evaluate
from plumbline.plans import inputs as I
from plumbline.plans.inputs import Book, table
from plumbline.rules import base as B
from plumbline.rules.adapters import pandas_rule
from plumbline.rules.dwc import REGISTRY as DWC
from plumbline.rules.registry import Registry
from plumbline.session import checkpoint_dir, cut
from plumbline.sources.sinks import write_run

BOOK = Book()
query = BOOK.query


# --- combinations -----------------------------------------------------------------------------------------

@query("unique_combos", "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return combos.unique_combos(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


_SETS = [["l_returnflag"], ["l_returnflag", "l_linestatus"], ["l_linenumber", "l_linestatus"]]
_SETS_SQL = """
SELECT 0 AS set_id, l_returnflag, NULL AS l_linestatus, NULL AS l_linenumber, count(*) AS count FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 1, l_returnflag, l_linestatus, NULL, count(*) FROM lineitem GROUP BY l_returnflag, l_linestatus
UNION ALL SELECT 2, NULL, l_linestatus, CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY l_linestatus, l_linenumber"""


@query("unique_combos_all", _SETS_SQL)
def _(spark, d):
    return combos.unique_combos_all(table(spark, d, "lineitem"), _SETS)


@query("unique_combos_per_set", _SETS_SQL)
def _(spark, d):
    return combos.unique_combos_all(table(spark, d, "lineitem"), _SETS, single_pass=False)


@query("row_results_rollup", """SELECT event_type AS test_id, CASE WHEN value >= 50 THEN 'COMPLIANT' ELSE 'NOT_COMPLIANT' END AS result,
  'user=' || (user_id % 20) AS "actedUpon", count(*) AS count FROM events GROUP BY 1, 2, 3""")
def _(spark, d):
    e = table(spark, d, "events")
    rows = e.select("event_id", F.col("event_type").alias("test_id"),
                    F.when(F.col("value") >= 50, N.COMPLIANT).otherwise(N.NOT_COMPLIANT).alias("result"),
                    F.concat(F.lit("user="), (F.col("user_id") % 20).cast("string")).alias("actedUpon"))
    return combos.rollup_row_results(rows, "event_id")


@query("blank_to_empty", """SELECT CASE WHEN event_type IN ('error', 'null') THEN '' ELSE event_type END AS event_type,
  CAST(user_id AS VARCHAR) AS user_id, count(*) AS count FROM events GROUP BY 1, 2""")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"))
    return X.blank_to_empty(e, tokens=["null"]).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("count"))


# --- rule family ------------------------------------------------------------------------------------------

GENERIC = Registry()
GENERIC.rule("VALIDATION_EVENTTYPE_NOTEMPTY", acted=["event_type"])(B.not_empty("event_type"))
GENERIC.rule("VALIDATION_PRIORITY_STANDARD", acted=["o_orderpriority"])(B.in_vocabulary("o_orderpriority", I.PRIORITIES))
GENERIC.rule("VALIDATION_LINE_LESSTHAN_QUANTITY", acted=["l_linenumber", "l_quantity"])(B.less_than("l_linenumber", "l_quantity"))
GENERIC.rule("VALIDATION_NAME_FORMAT", acted=["p_name"])(B.matches("p_name", "^[a-m]+ [a-z]+$", "a known shape"))
GENERIC.rule("VALIDATION_STATUS_CONSISTENT", acted=["l_returnflag", "l_linestatus"])(
    B.consistent("l_returnflag", "l_linestatus", lambda v: B.lookup_literal(v["l_returnflag"], {"A": "F", "R": "F", "N": "O"})))
GENERIC.rule("AMENDMENT_TYPE_STANDARDIZED", "Amendment", acted=["p_type"])(
    B.standardize("p_type", lambda v: F.initcap(F.lower(v["p_type"])), lambda v: v["p_type"] == "ECONOMY"))
GENERIC.rule("AMENDMENT_EVENTTYPE_FROM_BUCKET", "Amendment", acted=["event_type"], consulted=["bucket"])(
    B.fill_from({"event_type": lambda v: F.when(v["bucket"] != "3", F.concat(F.lit("b"), v["bucket"]))}, ["bucket"]))


def _eval(df: DataFrame, rule_id: str, rules: Registry = GENERIC) -> DataFrame:
    return I.flat(evaluate.evaluate(combos.unique_combos(df, rules[rule_id].columns), rules[rule_id]))


def _eval_sql(rule_id, status, result, comment, source, rules=GENERIC):
    return I.result_sql(rule_id, status, result, comment, rules, source)


_EVENTS = "(SELECT *, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS et FROM events)"


@query("eval_not_empty", _eval_sql(
    "VALIDATION_EVENTTYPE_NOTEMPTY", I.HAS, I.verdict_sql("event_type <> ''"),
    I.when_sql("event_type <> ''", "event_type contains a value.", "event_type is empty."),
    "(SELECT CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS event_type FROM events)"))
def _(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"))
    return _eval(e, "VALIDATION_EVENTTYPE_NOTEMPTY")


@query("eval_in_range", f"WITH {I.OCC_SQL}\n" + _eval_sql(
    "VALIDATION_DECIMALLATITUDE_INRANGE", I.HAS, I.verdict_sql(I._LAT),
    I.when_sql(I._LAT, "dwc:decimalLatitude is between -90 and 90 inclusive.", "dwc:decimalLatitude is outside the range -90 to 90."), "occ", DWC))
def _(spark, d):
    return _eval(I.occ(spark, d), "VALIDATION_DECIMALLATITUDE_INRANGE", DWC)


_PRIO = "o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"


@query("eval_in_vocabulary", _eval_sql(
    "VALIDATION_PRIORITY_STANDARD", I.HAS, I.verdict_sql(_PRIO),
    f"CASE WHEN {_PRIO} THEN 'o_orderpriority is a listed term.' ELSE 'o_orderpriority [' || o_orderpriority || '] is not a listed term.' END", "orders"))
def _(spark, d):
    return _eval(table(spark, d, "orders"), "VALIDATION_PRIORITY_STANDARD")


_QTY = "(SELECT CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS l_quantity FROM lineitem)"
_LESS = "CAST(l_linenumber AS DOUBLE) <= CAST(l_quantity AS DOUBLE)"


@query("eval_less_than", _eval_sql(
    "VALIDATION_LINE_LESSTHAN_QUANTITY", I.HAS, I.verdict_sql(_LESS),
    I.when_sql(_LESS, "l_linenumber is not greater than l_quantity.", "l_linenumber is greater than l_quantity."), _QTY))
def _(spark, d):
    return _eval(table(spark, d, "lineitem").select("l_linenumber", F.col("l_quantity").cast("int").alias("l_quantity")),
                 "VALIDATION_LINE_LESSTHAN_QUANTITY")


@query("eval_matches", _eval_sql(
    "VALIDATION_NAME_FORMAT", I.HAS, I.verdict_sql("regexp_full_match(p_name, '[a-m]+ [a-z]+')"),
    I.when_sql("regexp_full_match(p_name, '[a-m]+ [a-z]+')", "p_name is a known shape.", "p_name is not a known shape."), "part"))
def _(spark, d):
    return _eval(table(spark, d, "part"), "VALIDATION_NAME_FORMAT")


_AGREE = "(l_linestatus = CASE WHEN l_returnflag IN ('A', 'R') THEN 'F' ELSE 'O' END)"


@query("eval_consistent", _eval_sql(
    "VALIDATION_STATUS_CONSISTENT", I.HAS, I.verdict_sql(_AGREE),
    I.when_sql(_AGREE, "l_returnflag and l_linestatus agree.", "l_returnflag and l_linestatus do not agree."), "lineitem"))
def _(spark, d):
    return _eval(table(spark, d, "lineitem"), "VALIDATION_STATUS_CONSISTENT")


_TITLE = "upper(p_type[1]) || lower(p_type[2:])"


@query("eval_standardize", _eval_sql(
    "AMENDMENT_TYPE_STANDARDIZED", "CASE WHEN p_type = 'ECONOMY' THEN 'NOT_AMENDED' ELSE 'AMENDED' END",
    f"CASE WHEN p_type = 'ECONOMY' THEN '' ELSE 'p_type=' || {_TITLE} END",
    I.when_sql("p_type = 'ECONOMY'", "p_type already has a standard value.", "p_type standardised."), "part"))
def _(spark, d):
    return _eval(table(spark, d, "part"), "AMENDMENT_TYPE_STANDARDIZED")


_BUCKETS = """(SELECT CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS event_type,
  CAST(user_id % 7 AS VARCHAR) AS bucket, event_id FROM events)"""


def _bucketed(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"),
        (F.col("user_id") % 7).cast("string").alias("bucket"))


@query("eval_fill_from", _eval_sql(
    "AMENDMENT_EVENTTYPE_FROM_BUCKET",
    "CASE WHEN event_type <> '' THEN 'INTERNAL_PREREQUISITES_NOT_MET' WHEN bucket = '3' THEN 'NOT_AMENDED' ELSE 'FILLED_IN' END",
    "CASE WHEN event_type = '' AND bucket <> '3' THEN 'event_type=b' || bucket ELSE '' END",
    "CASE WHEN event_type <> '' THEN 'Not altering existing values of event_type.' WHEN bucket = '3' "
    "THEN 'No value can be derived from bucket.' ELSE 'Filled in from bucket.' END", _BUCKETS))
def _(spark, d):
    return _eval(_bucketed(spark, d), "AMENDMENT_EVENTTYPE_FROM_BUCKET")


@query("iso_interval", """WITH t AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders), s AS (
  SELECT d AS text, CAST(d AS DATE) AS a, CAST(d AS DATE) AS b FROM t
  UNION SELECT d[:7], CAST(d[:7] || '-01' AS DATE), last_day(CAST(d[:7] || '-01' AS DATE)) FROM t
  UNION SELECT d[:4], CAST(d[:4] || '-01-01' AS DATE), CAST(d[:4] || '-12-31' AS DATE) FROM t
  UNION SELECT d || '/' || strftime(last_day(CAST(d AS DATE)), '%d'), CAST(d AS DATE), last_day(CAST(d AS DATE)) FROM t
  UNION SELECT d || 'x', NULL, NULL FROM t)
SELECT text, CAST(a AS VARCHAR) AS start, CAST(b AS VARCHAR) AS "end", CAST(b - a + 1 AS INTEGER) AS days,
  a IS NOT NULL AND EXISTS (SELECT 1 FROM range(1990, 2010) r(y) WHERE y % 4 = 0 AND make_date(y, 2, 29) BETWEEN a AND b) AS leap FROM s""")
def _(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    t = table(spark, d, "orders").select(day.alias("d")).distinct()
    forms = F.array(F.col("d"), F.substring("d", 1, 7), F.substring("d", 1, 4),
                    F.concat("d", F.lit("/"), F.date_format(F.last_day(F.col("d").cast("date")), "dd")), F.concat("d", F.lit("x")))
    out = t.select(F.explode(forms).alias("text")).distinct().withColumn("i", iso_interval(F.col("text")))
    return out.select("text", F.col("i.start").cast("string").alias("start"), F.col("i.end").cast("string").alias("end"),
                      duration_days(F.col("i")).alias("days"), F.coalesce(has_leap_day(F.col("i")), F.lit(False)).alias("leap"))


@query("standard_date", """SELECT strftime(o_orderdate, '%-d %B %Y') AS text, strftime(o_orderdate, '%Y-%m-%d') AS iso, count(*) AS count FROM orders GROUP BY 1, 2
UNION ALL SELECT strftime(o_orderdate, '%d/%m/%Y'), CASE WHEN day(o_orderdate) > 12 OR day(o_orderdate) = month(o_orderdate) THEN strftime(o_orderdate, '%Y-%m-%d') END, count(*) FROM orders GROUP BY 1, 2""")
def _(spark, d):
    o = table(spark, d, "orders")
    texts = o.select(F.explode(F.array(F.date_format("o_orderdate", "d MMMM yyyy"), F.date_format("o_orderdate", "dd/MM/yyyy"))).alias("text"))
    counted = texts.groupBy("text").agg(F.count(F.lit(1)).alias("count"))
    return counted.select("text", standard_date(F.col("text")).alias("iso"), "count")


_EVD = "(SELECT strftime(o_orderdate, '%Y-%m-%d') AS \"dwc:eventDate\" FROM orders)"


@query("eval_date_rules", "\nUNION ALL ".join([
    _eval_sql("VALIDATION_EVENTDATE_STANDARD", I.HAS, "'COMPLIANT'", "'eventDate is an ISO date.'", _EVD, DWC),
    _eval_sql("VALIDATION_EVENTDATE_INRANGE", I.HAS, I.verdict_sql(I._DATE),
              I.when_sql(I._DATE, "eventDate lies within the valid range.", "eventDate lies outside the valid range."), _EVD, DWC),
    _eval_sql("EVENT_DATE_YEAR_INCOMPLETE", I.HAS, I.verdict_sql("\"dwc:eventDate\" NOT LIKE '%-02-29'"),
              I.when_sql("\"dwc:eventDate\" NOT LIKE '%-02-29'", "eventDate has no leap day and lasts at most one calendar year.",
                         "eventDate has a leap day or lasts longer than one calendar year."), _EVD, DWC)]))
def _(spark, d):
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("dwc:eventDate"))
    rules = [DWC["VALIDATION_EVENTDATE_STANDARD"], DWC["VALIDATION_EVENTDATE_INRANGE"].with_params(latestValidDate=I.LATEST),
             DWC["EVENT_DATE_YEAR_INCOMPLETE"]]
    return I.flat(evaluate.evaluate(combos.unique_combos(o, ["dwc:eventDate"]), rules))


@query("pandas_rule", "SELECT 'VALIDATION_PRIORITY_USER' AS test_id, 'RUN_HAS_RESULT' AS status, CASE WHEN o_orderpriority LIKE '5%' "
       "THEN 'NOT_COMPLIANT' ELSE 'COMPLIANT' END AS result, 'o_orderpriority=' || o_orderpriority AS \"actedUpon\", count(*) AS count "
       "FROM orders GROUP BY o_orderpriority")
def _(spark, d):
    user = Registry()
    user.rule("VALIDATION_PRIORITY_USER", acted=["o_orderpriority"])(pandas_rule(
        lambda p: (N.HAS_RESULT, N.NOT_COMPLIANT if p.startswith("5") else N.COMPLIANT, ""), ["o_orderpriority"]))
    return evaluate.run_tests(table(spark, d, "orders"), user).results.select("test_id", "status", "result", "actedUpon", "count")


# --- runs -----------------------------------------------------------------------------------------------------

@query("run_tests", I.with_results(f"SELECT {I.BASE} FROM results"))
def _(spark, d):
    return I.flat(I.results(spark, d))


@query("run_tests_per_set", I.with_results(f"SELECT {I.BASE} FROM results"))
def _(spark, d):
    return I.flat(evaluate.run_tests(I.occ(spark, d), I.OCC_RULES).results)


_WIDE = ["dwc:basisOfRecord", "dwc:country", "dwc:countryCode", "dwc:decimalLatitude", "dwc:eventDate", "dwc:taxonRank"]


@query("union_wide", I.with_results("SELECT test_id, result, count, " + ", ".join(
    f"coalesce(nullif(regexp_extract('|' || \"actedUpon\" || '|' || consulted || '|', '\\|{c}=([^|]*)\\|', 1), ''), '') AS \"{c.replace(':', '_')}\"" for c in _WIDE)
    + " FROM results"))
def _(spark, d):
    wide = evaluate.to_wide(I.results(spark, d), evaluate.fields_of(I.OCC_RULES))
    return wide.select("test_id", "result", "count", *[N.col(c).alias(c.replace(":", "_")) for c in _WIDE])


def _requests(spark, d) -> DataFrame:
    """Events as test requests: two known tests, one unknown, one blank id."""
    e, k = table(spark, d, "events"), F.col("event_id") % 4
    name = F.when(k == 0, "VALIDATION_COUNTRY_NOTEMPTY").when(k == 1, I.OCC_RULES["AMENDMENT_TAXONRANK_STANDARDIZED"].guid).when(
        k == 2, "NO_SUCH_TEST").otherwise("")
    return e.select(F.col("event_id").alias("seq"), name.alias("id"), F.create_map(
        F.lit("dwc:country"), F.when(F.col("event_type") != "error", F.col("event_type")),
        F.lit("dwc:taxonRank"), F.substring("event_type", 1, 1)).alias("params"))


_ANSWERS = """answers AS (SELECT event_id AS seq, event_id % 4 AS k, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS et FROM events),
flat AS (SELECT seq, CASE k WHEN 0 THEN 'VALIDATION_COUNTRY_NOTEMPTY' WHEN 1 THEN 'AMENDMENT_TAXONRANK_STANDARDIZED' END AS test_id,
  CASE k WHEN 0 THEN 'RUN_HAS_RESULT' WHEN 1 THEN 'NOT_AMENDED' ELSE 'INTERNAL_PREREQUISITES_NOT_MET' END AS status,
  CASE WHEN k = 0 THEN CASE WHEN et <> '' THEN 'COMPLIANT' ELSE 'NOT_COMPLIANT' END ELSE '' END AS result FROM answers)"""


@query("evaluate_requests", f"WITH {_ANSWERS} SELECT * FROM flat")
def _(spark, d):
    return evaluate.evaluate_requests(_requests(spark, d), I.OCC_RULES).select("seq", "test_id", "status", "result")


@query("batch_summary", f"WITH {_ANSWERS} SELECT count(*) AS items, count(*) FILTER (status = 'INTERNAL_PREREQUISITES_NOT_MET') AS failed, "
       "FALSE AS homogeneous FROM flat")
def _(spark, d):
    return evaluate.batch_summary(evaluate.evaluate_requests(_requests(spark, d), I.OCC_RULES))


# --- packed texts ---------------------------------------------------------------------------------------------

@query("render_pairs", "SELECT c_custkey, 'name=' || c_name || '|segment=' || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS packed FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    pairs = F.array(F.struct(F.lit("name").alias("field"), F.col("c_name").alias("value")),
                    F.struct(F.lit("segment").alias("field"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("value")))
    return c.select("c_custkey", X.render_response(F.lit(None).cast("string"), pairs, F.lit("none")).alias("packed"))


@query("parse_pairs", """SELECT c_custkey, 'name' AS field, c_name AS value FROM customer
UNION ALL SELECT c_custkey, 'note', 'a=' || c_mktsegment FROM customer""")
def _(spark, d):
    packed = F.concat(F.lit("name = \""), F.col("c_name"), F.lit("\"|bare| note =a="), F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.inline(X.parse_pairs(packed)))


@query("parse_pairs_bare", """SELECT c_custkey, 'name' AS field, c_name AS value FROM customer
UNION ALL SELECT c_custkey, 'bare', '' FROM customer""")
def _(spark, d):
    packed = F.concat(F.lit("name="), F.col("c_name"), F.lit("|| bare "))
    return table(spark, d, "customer").select("c_custkey", F.inline(X.parse_pairs(packed, keep_bare=True)))


@query("combo_text", I.with_results("""SELECT CASE WHEN consulted = '' THEN "actedUpon" ELSE "actedUpon" || ' · ' || consulted END AS combo,
  CAST(sum(count) AS BIGINT) AS count FROM results GROUP BY 1"""))
def _(spark, d):
    return I.results(spark, d).groupBy(X.combo_text(F.col("actedUpon"), F.col("consulted")).alias("combo")).agg(F.sum("count").alias("count"))


@query("test_kind", "SELECT p_partkey, upper(split_part(p_name, ' ', 2)) AS kind, len(string_split(p_name, ' ')) AS elements FROM part")
def _(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", X.test_kind(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("kind"),
                    F.size(X.parse_ie(F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(" , ")), F.lit(", ")))).cast("bigint").alias("elements"))


@query("case_change", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'lowercase change' WHEN 1 THEN 'uppercase change' WHEN 2 THEN 'case change' END AS kind FROM part""")
def _(spark, d):
    p, k, name = table(spark, d, "part"), F.col("p_size") % 4, F.col("p_name")
    old = F.when(k == 0, F.upper(name)).when(k == 1, name).when(k == 2, F.initcap(name)).otherwise(name)
    new = F.when(k == 0, name).when(k == 1, F.upper(name)).when(k == 2, name).otherwise(F.concat(name, F.lit("s")))
    return p.select("p_partkey", X.case_change(old, new).alias("kind"))


# --- catalogue ------------------------------------------------------------------------------------------------

def _catalogue(spark, d) -> DataFrame:
    """Parts as test definitions, with repeated ids and guids."""
    p = table(spark, d, "part")
    family = F.element_at(F.array(*[F.lit(x) for x in ("qc.georeference.Geo", "qc.sciname.Name", "qc.date.Date")]), (F.col("p_size") % 3 + 1).cast("int"))
    return p.select(
        F.col("p_partkey").alias("seq"), F.concat(F.col("p_brand"), F.lit("_"), F.col("p_type")).alias("id"),
        F.when(F.col("p_size") % 11 != 0, F.concat(F.lit("g"), F.pmod(F.col("p_partkey"), F.lit(300)))).otherwise("").alias("guid"),
        F.when(F.col("p_size") % 10 == 0, "Measure").otherwise("Validation").alias("type"),
        F.concat(family, F.when(F.col("p_size") % 5 == 0, "Defaults").otherwise("")).alias("class_name"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.lit("ns:sourceAuthority"), F.lit("ns:spatialBufferInMeters"))).otherwise(
            F.array(F.lit("ns:sourceAuthority"))).alias("parameters"),
        F.array(F.lit("l_shipdate")).alias("acted_upon"),
        F.when(F.col("p_size") % 4 == 0, F.array(F.lit("l_nothing"))).otherwise(F.array(F.lit("l_tax"))).alias("consulted"))


_CAT = """cat AS (SELECT p_partkey AS seq, p_brand || '_' || p_type AS id,
  CASE WHEN p_size % 11 <> 0 THEN 'g' || (p_partkey % 300) ELSE '' END AS guid,
  CASE WHEN p_size % 10 = 0 THEN 'Measure' ELSE 'Validation' END AS type,
  (['qc.georeference.Geo', 'qc.sciname.Name', 'qc.date.Date'])[p_size % 3 + 1] || CASE WHEN p_size % 5 = 0 THEN 'Defaults' ELSE '' END AS class_name,
  CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS n, p_size FROM part)"""
_PREFER = "ORDER BY CASE WHEN class_name LIKE '%Defaults' THEN 0 ELSE 1 END, n, seq"


@query("list_tests", f"""WITH {_CAT}, a AS (SELECT *, row_number() OVER (PARTITION BY guid {_PREFER}) AS k FROM cat WHERE guid <> ''),
  g AS (SELECT seq, id, guid FROM a WHERE k = 1),
  b AS (SELECT *, row_number() OVER (PARTITION BY id {_PREFER}) AS k FROM cat WHERE guid = '')
SELECT seq, id, guid FROM g UNION ALL SELECT seq, id, guid FROM b WHERE k = 1 AND id NOT IN (SELECT id FROM g)""")
def _(spark, d):
    return catalogue.list_tests(_catalogue(spark, d)).select("seq", "id", "guid")


@query("prefer_tests", f"""WITH {_CAT}, a AS (SELECT *, row_number() OVER (PARTITION BY id {_PREFER}) AS k FROM cat)
SELECT id, seq, class_name FROM a WHERE k = 1""")
def _(spark, d):
    return catalogue.prefer_tests(_catalogue(spark, d)).select("id", "seq", "class_name")


@query("find_tests", f"""WITH {_CAT}, r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Brand#' || (o_custkey % 30) || '_ECONOMY'
   WHEN 1 THEN 'g' || (o_custkey % 400) ELSE 'zz' END AS id FROM orders)
SELECT o_orderkey, coalesce(l.id, g.id) AS test_id FROM r LEFT JOIN (SELECT DISTINCT id FROM cat) l USING (id)
LEFT JOIN (SELECT guid, min(id) AS id FROM cat WHERE guid <> '' GROUP BY guid) g ON r.id = g.guid""")
def _(spark, d):
    k = F.col("o_orderkey") % 3
    name = F.when(k == 0, F.concat(F.lit("Brand#"), F.col("o_custkey") % 30, F.lit("_ECONOMY"))).when(
        k == 1, F.concat(F.lit("g"), F.col("o_custkey") % 400)).otherwise("zz")
    requests = table(spark, d, "orders").select("o_orderkey", name.alias("id"))
    return catalogue.find_tests(requests, _catalogue(spark, d)).select("o_orderkey", "test_id")


@query("applicable_tests", f"WITH {_CAT} SELECT seq, id FROM cat WHERE type <> 'Measure' AND p_size % 4 <> 0")
def _(spark, d):
    return catalogue.applicable_tests(_catalogue(spark, d), table(spark, d, "lineitem").columns).select("seq", "id")


@query("default_params", f"""WITH {_CAT} SELECT seq, CASE WHEN class_name LIKE '%.georeference.%' THEN 'NE_10M_ADMIN_0_COUNTRIES'
  WHEN class_name LIKE '%.sciname.%' THEN 'GBIF Backbone Taxonomy' END AS authority,
  CASE WHEN p_size % 6 = 0 THEN 'own' WHEN p_size % 2 = 0 THEN '3000' END AS buffer FROM cat""")
def _(spark, d):
    mine = F.when(F.col("n6") == 0, F.create_map(F.lit("ns:spatialBufferInMeters"), F.lit("own")))
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), (F.col("p_size") % 6).alias("n6"))
    requests = _catalogue(spark, d).join(sizes, "seq").withColumn("params", mine)
    done = catalogue.with_default_params(requests)
    return done.select("seq", F.col("params")["ns:sourceAuthority"].alias("authority"), F.col("params")["ns:spatialBufferInMeters"].alias("buffer"))


@query("normalise_catalogue", """SELECT p_brand AS test_id, min(CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END) AS ie_class FROM part GROUP BY 1""")
def _(spark, d):
    raw = table(spark, d, "part").select(
        F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias(" test_id "), F.when(F.col("p_size") > 25, "big\r").otherwise("small\r").alias("IE  Class\r"))
    return catalogue.one_per_test(catalogue.normalise_catalogue(raw))


@query("catalogue_coverage", I.with_context("SELECT test_id, test_id IN (SELECT test_id FROM context) AS known FROM results GROUP BY test_id"))
def _(spark, d):
    return catalogue.catalogue_coverage(I.results(spark, d), I.context(spark))


# --- amendments -------------------------------------------------------------------------------------------------

PART_RULES = Registry()
PART_RULES.rule("AMENDMENT_BRAND_STANDARDIZED", "Amendment", acted=["p_brand"])(
    B.standardize("p_brand", lambda v: F.concat(F.lit("B-"), F.substring_index(v["p_brand"], "#", -1)), lambda v: v["p_brand"] == "Brand#1"))
PART_RULES.rule("AMENDMENT_TYPE_FROM_BRAND", "Amendment", acted=["p_type"], consulted=["p_brand"])(
    B.standardize("p_type", lambda v: F.when(v["p_brand"] == "Brand#2", F.lit("SECOND")), lambda v: v["p_type"] == "ECONOMY"))
PART_RULES.rule("AMENDMENT_TYPE_STANDARDIZED", "Amendment", acted=["p_type"])(
    B.standardize("p_type", lambda v: F.initcap(F.lower(v["p_type"])), lambda v: v["p_type"] == "ECONOMY"))

_AMENDED = f"""SELECT p_partkey, p_name, CASE WHEN p_brand = 'Brand#1' THEN p_brand ELSE 'B-' || split_part(p_brand, '#', 2) END AS p_brand,
  CASE WHEN p_type = 'ECONOMY' THEN p_type ELSE {_TITLE} END AS p_type FROM part"""


def _part(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")


def _part_results(spark, d) -> DataFrame:
    return evaluate.run_tests(_part(spark, d), PART_RULES).results


@query("apply_amendments", _AMENDED)
def _(spark, d):
    return amend.apply_amendments(_part(spark, d), cut(_part_results(spark, d)))


@query("amend_inline", _AMENDED)
def _(spark, d):
    return amend.amend_inline(_part(spark, d), PART_RULES)


@query("amend_occurrences", f"""WITH {I.OCC_SQL} SELECT CASE WHEN {I._FILL} THEN 'X' || split_part("dwc:country", '_', 2) ELSE "dwc:countryCode" END AS code,
  coalesce({I._LONG}, "dwc:taxonRank") AS rank, count(*) AS count FROM occ GROUP BY 1, 2""")
def _(spark, d):
    paths = write_run(f"{checkpoint_dir(spark)}/amend-{uuid.uuid4().hex}", "r", original=I.occ(spark, d))
    original = spark.read.parquet(paths["original"])
    run = evaluate.run_tests(original, I.OCC_RULES.select("AMENDMENT_COUNTRYCODE_FROM_COUNTRY", "AMENDMENT_TAXONRANK_STANDARDIZED"))
    amended = amend.apply_amendments(original, cut(run.results))
    return amended.groupBy(F.coalesce(N.col("dwc:countryCode"), F.lit("")).alias("code"), N.col("dwc:taxonRank").alias("rank")).agg(
        F.count(F.lit(1)).alias("count"))


@query("amend_blank_fill", f"""SELECT event_id, CASE WHEN event_type = '' AND bucket <> '3' THEN 'b' || bucket ELSE nullif(event_type, '') END AS event_type, bucket FROM {_BUCKETS}""")
def _(spark, d):
    df = _bucketed(spark, d)
    run = evaluate.run_tests(df, GENERIC.select("AMENDMENT_EVENTTYPE_FROM_BUCKET"))
    return amend.apply_amendments(df, cut(run.results))


_METRICS = """WITH a AS (SELECT count(*) FILTER (p_brand <> 'Brand#1') AS b, count(*) FILTER (p_type <> 'ECONOMY') AS t,
  count(*) FILTER (p_type <> 'ECONOMY' AND p_brand = 'Brand#2') AS s FROM part)
SELECT b + t + s AS updates, b + t + s AS rows_touched, '' AS not_found FROM a"""


@query("amend_metrics", _METRICS)
def _(spark, d):
    out = amend.amend_metrics(_part(spark, d), cut(_part_results(spark, d)))
    return out.withColumn("not_found", F.array_join("not_found", ","))


@query("change_log", f"""SELECT 'AMENDMENT_TYPE_STANDARDIZED' AS test_id, 'p_type' AS field, p_type AS before, {_TITLE} AS after, 'case change' AS case_change, count(*) AS count
  FROM part WHERE p_type <> 'ECONOMY' GROUP BY p_type
UNION ALL SELECT 'AMENDMENT_BRAND_STANDARDIZED', 'p_brand', p_brand, 'B-' || split_part(p_brand, '#', 2), NULL, count(*) FROM part WHERE p_brand <> 'Brand#1' GROUP BY p_brand
UNION ALL SELECT 'AMENDMENT_TYPE_FROM_BRAND', 'p_type', p_type, 'SECOND', NULL, count(*) FROM part WHERE p_brand = 'Brand#2' AND p_type <> 'ECONOMY' GROUP BY p_type""")
def _(spark, d):
    return amend.change_log(_part_results(spark, d)).select("test_id", "field", "before", "after", "case_change", "count")


@query("change_text", f"""SELECT p_partkey, 'p_type amended from ' || p_type || ' → ' || {_TITLE} || '; p_note → x; kept' AS text FROM part""")
def _(spark, d):
    result = F.concat(F.lit("p_type="), F.initcap(F.lower("p_type")), F.lit("|p_note=x|kept"))
    return table(spark, d, "part").select("p_partkey", X.change_text(result, F.concat(F.lit("p_type="), "p_type")).alias("text"))
