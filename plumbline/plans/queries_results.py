"""Driver queries over result tables: filters, context joins, summaries, profiles and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import names as N
from plumbline.functions.text import combo_text
from plumbline.operators import context as C
from plumbline.operators import export, filters, profile, summary
from plumbline.operators.summary import tested_columns
from plumbline.plans import inputs as I
from plumbline.plans.inputs import Book, table

BOOK = Book()
query = BOOK.query

_ACT = "status IN ('AMENDED', 'FILLED_IN')"
_ATT = "result IN ('NOT_COMPLIANT', 'POTENTIAL_ISSUE')"
_FLAGGED = f"{_ATT} AND status = 'RUN_HAS_RESULT'"


def _rows(where: str) -> str:
    return I.with_results(f"SELECT {I.BASE} FROM results WHERE {where}")


@query("actionable", _rows(_ACT))
def _(spark, d):
    return I.flat(filters.actionable(I.results(spark, d)))


@query("needs_attention", _rows(_ATT))
def _(spark, d):
    return I.flat(filters.needs_attention(I.results(spark, d)))


@query("flagged", _rows(_FLAGGED))
def _(spark, d):
    return I.flat(filters.flagged(I.results(spark, d)))


@query("curated_mask", _rows(f"{_ACT} OR {_ATT}"))
def _(spark, d):
    return I.flat(filters.curated_mask(I.results(spark, d)))


def _joined(spark, d):
    return C.join_context(I.results(spark, d), I.context(spark))


@query("filter_usecase", I.with_context(f"SELECT {I.BASE} FROM joined WHERE contains(usecases, 'Record-Management')"))
def _(spark, d):
    return I.flat(filters.filter_usecase(_joined(spark, d), "Record-Management"))


@query("filter_kind", _rows("test_id LIKE '%\\_STANDARD' ESCAPE '\\'"))
def _(spark, d):
    return I.flat(filters.filter_kind(I.results(spark, d), "STANDARD"))


_COMBO = "CASE WHEN consulted = '' THEN \"actedUpon\" ELSE \"actedUpon\" || ' · ' || consulted END"


@query("search_combos", I.with_results(f"SELECT test_id, {_COMBO} AS combo, comment, count FROM results WHERE contains(lower({_COMBO} || ' ' || comment), 'nation_1')"))
def _(spark, d):
    r = I.results(spark, d).select("test_id", combo_text(F.col("actedUpon"), F.col("consulted")).alias("combo"), "comment", "count")
    return filters.search_combos(r, "NATION_1")


@query("tested_columns", I.with_results("""SELECT DISTINCT unnest(string_split("actedUpon_cols" || CASE WHEN consulted_cols = '' THEN '' ELSE '|' || consulted_cols END, '|')) AS "column" FROM results"""))
def _(spark, d):
    return tested_columns(I.results(spark, d))


# --- context --------------------------------------------------------------------------------------------------

_CTX = "description, notes, type, ie_class, ie_acted_upon, ie_consulted, usecases"


@query("join_context", I.with_context(f"SELECT {I.BASE}, {_CTX} FROM joined"))
def _(spark, d):
    return _joined(spark, d).select(*N.RESULT_COLUMNS, *_CTX.split(", "))


@query("curated", I.with_context(f"""SELECT r.test_id, test_type, status, result, "actedUpon", consulted, count, "actedUpon_cols", consulted_cols, c.* EXCLUDE (test_id)
FROM results r LEFT JOIN context c USING (test_id) WHERE {_ACT} OR {_ATT}
ORDER BY count DESC, test_id, "actedUpon", consulted, status, result LIMIT 500"""))
def _(spark, d):
    return C.curated(I.results(spark, d), I.context(spark))


def _list(expr: str) -> str:
    return f"list_distinct(list_filter(list_transform(string_split({expr}, ','), lambda x: trim(x)), lambda x: x <> ''))"


_PAIRED = f"""f AS (SELECT test_id AS validation_id, unnest({_list("ie_acted_upon || ',' || ie_consulted")}) AS field FROM context),
w AS (SELECT test_id, unnest({_list("ie_acted_upon")}) AS field FROM context),
pairs AS (SELECT DISTINCT validation_id, test_id FROM f JOIN w USING (field) WHERE validation_id IN (SELECT test_id FROM results WHERE {_FLAGGED})),
applied AS (SELECT test_id, result, CAST(sum(count) AS BIGINT) AS count FROM results WHERE {_ACT} AND lower(test_type) = 'amendment' GROUP BY 1, 2)"""


def _paired(body: str) -> str:
    return f"WITH {I.RESULTS_SQL},\n{I.CONTEXT_SQL},\n{_PAIRED}\n{body}"


@query("amendments_for_validations", _paired("SELECT validation_id, test_id, result, count FROM pairs JOIN applied USING (test_id)"))
def _(spark, d):
    return C.amendments_for_validations(I.results(spark, d), I.context(spark))


@query("amendment_tests", _paired("SELECT validation_id, test_id, CAST(sum(count) AS BIGINT) AS count FROM pairs JOIN applied USING (test_id) GROUP BY 1, 2"))
def _(spark, d):
    return C.amendment_tests(C.amendments_for_validations(I.results(spark, d), I.context(spark)))


_LOOKUP = f"""look AS (SELECT test_id, result, "actedUpon", count, row_number() OVER (PARTITION BY test_id, result ORDER BY "actedUpon" DESC, consulted DESC) AS n
  FROM results WHERE {_ACT} AND test_type = 'Amendment')"""


@query("amendment_lookup", f"WITH {I.RESULTS_SQL},\n{_LOOKUP} SELECT test_id, result, \"actedUpon\", count FROM look WHERE n = 1")
def _(spark, d):
    return C.amendment_lookup(I.results(spark, d))


@query("fixes_for_combos", f"""WITH {I.RESULTS_SQL},
{_LOOKUP},
bad AS (SELECT test_id AS validation_id, unnest(string_split("actedUpon", '|')) AS pair, count FROM results WHERE {_FLAGGED}),
b AS (SELECT validation_id, pair, CAST(sum(count) AS BIGINT) AS flagged FROM bad GROUP BY 1, 2),
x AS (SELECT *, unnest(string_split("actedUpon", '|')) AS pair FROM look WHERE n = 1)
SELECT validation_id, split_part(pair, '=', 1) AS field, split_part(pair, '=', 2) AS value, flagged, test_id, result, "actedUpon", count
FROM b JOIN x USING (pair) WHERE list_contains(list_transform(string_split(result, '|'), lambda p: split_part(p, '=', 1)), split_part(pair, '=', 1))""")
def _(spark, d):
    return C.fixes_for_combos(I.results(spark, d))


# --- summaries ------------------------------------------------------------------------------------------------

def _sum(cond: str, name: str) -> str:
    return f"CAST(coalesce(sum(count) FILTER ({cond}), 0) AS BIGINT) AS {name}"


_SUMMARY = I.with_results("SELECT (SELECT CAST(max(s) AS BIGINT) FROM (SELECT sum(count) AS s FROM results GROUP BY test_id)) AS number_of_records_in_dataset, "
    "(SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT unnest(string_split(\"actedUpon_cols\" || '|' || consulted_cols, '|')) AS c FROM results) WHERE c <> '') AS list_of_all_columns_tested, "
    "CAST(sum(count) AS BIGINT) AS no_of_tests_results, count(DISTINCT test_id) AS no_of_tests_run, "
    + ", ".join([_sum("result = 'NOT_COMPLIANT'", "no_of_non_compliant_validations"), _sum("status = 'AMENDED'", "no_of_amendments"),
                 _sum("status = 'FILLED_IN'", "no_of_filled_in"), _sum("result = 'POTENTIAL_ISSUE'", "no_of_issues")])
    + ", count(*) FILTER (result = 'NOT_COMPLIANT') AS no_of_unique_non_compliant_validations, count(*) FILTER (status = 'AMENDED') AS no_of_unique_amendments, "
      "count(*) FILTER (status = 'FILLED_IN') AS no_of_unique_filled_in, count(*) FILTER (result = 'POTENTIAL_ISSUE') AS no_of_unique_issues FROM results")


def _summary_columns(df):
    return df.withColumn("list_of_all_columns_tested", F.array_join("list_of_all_columns_tested", ","))


@query("run_summary", _SUMMARY)
def _(spark, d):
    return _summary_columns(summary.run_summary(I.results(spark, d)))


@query("top_results", I.with_results(f"""SELECT * FROM (SELECT class, CAST(row_number() OVER (PARTITION BY class ORDER BY count DESC, test_id, "actedUpon", consulted, result) AS INTEGER) AS rank,
  "actedUpon", consulted, test_id, count FROM (SELECT CASE WHEN result = 'NOT_COMPLIANT' THEN 'non_compliant_validations' WHEN status = 'AMENDED' THEN 'amendments'
  WHEN status = 'FILLED_IN' THEN 'filled_in' ELSE 'issues' END AS class, * FROM results WHERE {_ACT} OR {_ATT})) WHERE rank <= 15"""))
def _(spark, d):
    return summary.top_results(I.results(spark, d))


@query("dataset_size", I.with_results("SELECT CAST(max(s) AS BIGINT) AS dataset_size FROM (SELECT sum(count) AS s FROM results GROUP BY test_id)"))
def _(spark, d):
    return summary.dataset_size(I.results(spark, d))


@query("summary_cards", I.with_results("""SELECT 1 AS position, 'records in dataset' AS label, CAST((SELECT max(s) FROM (SELECT sum(count) AS s FROM results GROUP BY test_id)) AS BIGINT) AS number
UNION ALL SELECT 2, 'tests across dataset', count(DISTINCT test_id) FROM results
UNION ALL SELECT 3, 'test passes', CAST(sum(count) FILTER (result <> 'NOT_COMPLIANT') AS BIGINT) FROM results
UNION ALL SELECT 4, 'needs attention', CAST(sum(count) FILTER (result = 'NOT_COMPLIANT') AS BIGINT) FROM results
UNION ALL SELECT 5, 'autocorrections', CAST(sum(count) FILTER (status IN ('AMENDED', 'FILLED_IN')) AS BIGINT) FROM results
UNION ALL SELECT 6, 'can''t be checked', CAST(sum(count) FILTER (result = 'POTENTIAL_ISSUE') AS BIGINT) FROM results
UNION ALL SELECT 7, 'compliant', CAST(sum(count) FILTER (result = 'COMPLIANT') AS BIGINT) FROM results"""))
def _(spark, d):
    return summary.summary_cards(I.results(spark, d))


@query("attention_matrix", I.with_context(f"""SELECT ie_class, test_id, CAST(coalesce(n, 0) AS BIGINT) AS count, round(coalesce(n, 0) * 100.0 / (SELECT sum(count) FROM joined WHERE {_ATT}), 6) AS percent
FROM (SELECT DISTINCT regexp_replace(ie_class, '^[^:]+:', '') AS ie_class FROM joined WHERE {_ATT}) a
CROSS JOIN (SELECT DISTINCT test_id FROM joined WHERE {_ATT}) b
LEFT JOIN (SELECT regexp_replace(ie_class, '^[^:]+:', '') AS ie_class, test_id, sum(count) AS n FROM joined WHERE {_ATT} GROUP BY 1, 2) c USING (ie_class, test_id)"""))
def _(spark, d):
    return summary.attention_matrix(_joined(spark, d)).withColumn("percent", F.round("percent", 6))


_RANKED = f"SELECT test_id, CAST(sum(count) AS BIGINT) AS total FROM results WHERE {_FLAGGED} GROUP BY 1"


@query("ranked_tests", I.with_results(_RANKED))
def _(spark, d):
    return summary.ranked_tests(filters.flagged(I.results(spark, d)))


@query("page", I.with_results(f"{_RANKED} ORDER BY total DESC, test_id LIMIT 2 OFFSET 2"))
def _(spark, d):
    ranked = summary.ranked_tests(filters.flagged(I.results(spark, d)))
    return summary.page(ranked, 2, 2, summary.ranked_order())


@query("page_combos", I.with_results(f"SELECT test_id, \"actedUpon\", count FROM results WHERE {_FLAGGED} ORDER BY count DESC, test_id, \"actedUpon\" LIMIT 20 OFFSET 40"))
def _(spark, d):
    rows = filters.flagged(I.results(spark, d)).select("test_id", "actedUpon", "count")
    return summary.page(rows, 3, 20, [F.col("count").desc(), "test_id", "actedUpon"])


@query("total_pages", I.with_results(f"SELECT CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM results WHERE {_FLAGGED}"))
def _(spark, d):
    return summary.total_pages(filters.flagged(I.results(spark, d)), 20)


@query("top_combos", I.with_results(f"""SELECT test_id, combo, count, comment, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY count DESC, combo) AS n FROM (
  SELECT test_id, {_COMBO} AS combo, CAST(sum(count) AS BIGINT) AS count, min(comment) AS comment FROM results WHERE {_FLAGGED} GROUP BY 1, 2)) WHERE n <= 5"""))
def _(spark, d):
    return summary.top_combos(filters.flagged(I.results(spark, d)), 5)


@query("flag_heading", I.with_results(f"SELECT count(DISTINCT test_id) AS tests, CAST(sum(count) AS BIGINT) AS records FROM results WHERE {_FLAGGED}"))
def _(spark, d):
    return summary.flag_heading(I.results(spark, d))


@query("kinds_available", I.with_context(f"""SELECT string_split(test_id, '_')[-1] AS kind, CAST(sum(count) AS BIGINT) AS count FROM joined
WHERE {_FLAGGED} AND contains(usecases, 'Spatial-Temporal_Patterns') GROUP BY 1"""))
def _(spark, d):
    return summary.kinds_available(_joined(spark, d), "Spatial-Temporal_Patterns")


@query("breakdown", I.with_results("""SELECT 'test_type' AS dimension, test_type AS value, count(*) AS rows FROM results GROUP BY 2
UNION ALL SELECT 'status', status, count(*) FROM results GROUP BY 2 UNION ALL SELECT 'result', result, count(*) FROM results GROUP BY 2"""))
def _(spark, d):
    return summary.breakdown(I.results(spark, d))


@query("flagged_wide", I.with_results(f"""SELECT regexp_extract("actedUpon", '=(.*)', 1) AS dwc_country, regexp_extract(consulted, '=(.*)', 1) AS "dwc_countryCode", count AS records_flagged
FROM results WHERE {_FLAGGED} AND test_id = 'VALIDATION_COUNTRY_NOTEMPTY'"""))
def _(spark, d):
    return export.flagged_wide(I.results(spark, d), "VALIDATION_COUNTRY_NOTEMPTY").toDF("dwc_country", "dwc_countryCode", "records_flagged")


# --- profile --------------------------------------------------------------------------------------------------

_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
_CUSTOMER = "(SELECT c_custkey, repeat(c_name, 3) AS c_name, c_nationkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer)"


def _customer(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.repeat("c_name", 3).alias("c_name"), "c_nationkey",
                    F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("c_mktsegment"))


_COUNTS = "v AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM {_CUSTOMER} GROUP BY 2" for c in _COLUMNS) + ")"


@query("value_counts", f"WITH {_COUNTS} SELECT col AS \"column\", value, count FROM v")
def _(spark, d):
    return profile.value_counts(_customer(spark, d))


@query("profile", f"""WITH {_COUNTS}, s AS (SELECT col, count(value) AS d, CAST(coalesce(sum(count) FILTER (value IS NULL), 0) AS BIGINT) AS nulls, CAST(sum(count) AS BIGINT) AS total FROM v GROUP BY col),
r AS (SELECT col, value, count, row_number() OVER (PARTITION BY col ORDER BY count DESC, value) AS a, row_number() OVER (PARTITION BY col ORDER BY count, value DESC) AS z FROM v WHERE value IS NOT NULL),
p AS (SELECT s.*, value, count, CASE WHEN d <= 10 THEN 'all' ELSE 'top' END AS part, a AS rank FROM s JOIN r USING (col) WHERE d <= 10 OR a <= 5
  UNION ALL SELECT s.*, value, count, 'bottom', z FROM s JOIN r USING (col) WHERE d > 10 AND z <= 2)
SELECT col AS "column", d AS "distinct", nulls, total, part, CAST(rank AS INTEGER) AS rank, CASE WHEN length(value) > 50 THEN value[:50] || '...' ELSE value END AS value, count FROM p""")
def _(spark, d):
    return profile.profile(_customer(spark, d))


@query("snapshot", f"""WITH t AS (SELECT * EXCLUDE (c_mktsegment, c_name), coalesce(c_mktsegment, '') AS c_mktsegment, CASE WHEN length(c_name) > 20 THEN c_name[:17] || '...' ELSE c_name END AS c_name FROM {_CUSTOMER})
SELECT CAST(row_number() OVER (ORDER BY c_custkey) AS INTEGER) AS position, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM (SELECT * FROM t ORDER BY c_custkey LIMIT 5)
UNION ALL SELECT -CAST(row_number() OVER (ORDER BY c_custkey DESC) AS INTEGER), CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment FROM (SELECT * FROM t ORDER BY c_custkey DESC LIMIT 5)""")
def _(spark, d):
    return profile.snapshot(_customer(spark, d), ["c_custkey"], width=20)
