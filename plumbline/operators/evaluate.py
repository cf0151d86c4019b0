"""Evaluation of rules over combinations and over request lists."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline import names as N
from plumbline.functions.text import pack_cols, pairs_text
from plumbline.operators.catalogue import applicable_rules, with_default_params
from plumbline.operators.combos import distinct_key_sets, unique_combos, unique_combos_all
from plumbline.operators.lookups import MissingReference, References, attach_answers, missing_tables
from plumbline.rules.base import unmet
from plumbline.rules.registry import Rule, Source, bind, column_source, columns_source, map_source
from plumbline.session import cut

RESULT_SCHEMA = (
    "test_id string, test_type string, status string, result string, comment string, actedUpon string, "
    "consulted string, actedUpon_cols string, consulted_cols string, count bigint, "
    "values map<string,string>, changes map<string,string>"
)
FAILED_SCHEMA = "test_id string, reason string"


def _entry(r: Rule, source: Source) -> Column:
    """One result row as a struct, except for the count."""
    keys = r.columns
    return F.struct(
        F.lit(r.id).alias("test_id"), F.lit(r.type).alias("test_type"), bind(r, source).alias("response"),
        pairs_text({c: source(c) for c in r.acted}).alias("actedUpon"),
        pairs_text({c: source(c) for c in r.consulted}).alias("consulted"),
        F.lit(pack_cols(r.acted)).alias("actedUpon_cols"), F.lit(pack_cols(r.consulted)).alias("consulted_cols"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in keys]), F.array(*[source(c) for c in keys])).alias("values"),
    )


def _flatten(df: DataFrame, carry: Sequence[str]) -> DataFrame:
    fixed = ["test_id", "test_type", "response.status", "response.result", "response.comment",
             "actedUpon", "consulted", "actedUpon_cols", "consulted_cols", "count", "values", "response.changes"]
    return df.select(*[N.col(c) for c in carry], *fixed)


def evaluate(combos: DataFrame, rules: Sequence[Rule] | Rule, refs: References | None = None,
             carry: Sequence[str] = ()) -> DataFrame:
    """Result rows of one or more rules over the same combinations (columns of the rules, and ``count``)."""
    rules = [rules] if isinstance(rules, Rule) else list(rules)
    source = columns_source(combos)
    if any(n.startswith("geo_") for r in rules for n in r.needs):
        combos = cut(combos)  # else the points are read from each row, several times, where Spark moves their filter below the counting
    ready, done = combos, set()
    for r in rules:
        wanted = [n for n in r.needs if n not in done]
        if wanted:
            ready = attach_answers(ready, _only(r, wanted), source, refs or References())
            done.update(wanted)
    entries = F.inline(F.array(*[_entry(r, source) for r in rules]))
    return _flatten(ready.select(*[N.col(c) for c in carry], "count", entries), carry)


def _only(r: Rule, needs: Sequence[str]) -> Rule:
    from dataclasses import replace
    return replace(r, needs=tuple(needs))


@dataclass
class Run:
    """Outcome of a run: result rows, the tests that were left out with the reason, and the rules used."""

    results: DataFrame
    failed: DataFrame
    rules: list[Rule]


def _each_buildable(rules: Sequence[Rule], build: Callable[[list[Rule]], DataFrame]
                    ) -> tuple[DataFrame | None, list[Rule], list[tuple[str, str]]]:
    """The plan of ``rules`` together; when that cannot be built, the rules at fault are left out and named."""
    try:
        return build(list(rules)), list(rules), []
    except Exception:  # find out which ones
        good, bad = [], []
    for r in rules:
        try:
            build([r])
            good.append(r)
        except Exception as error:  # one broken test must not stop the others
            bad.append((r.id, str(error) if isinstance(error, MissingReference) else str(error).split("\n")[0]))
    return (build(good) if good else None), good, bad


def _families(rules: Sequence[Rule]) -> list[tuple[tuple[str, ...], list[Rule]]]:
    """Rules that can share one evaluation: the same key columns and compatible reference needs."""
    groups: dict[tuple, list[Rule]] = {}
    for r in rules:
        # a geo answer depends on its rule's settings, so such rules stay apart
        own = r.id if any(n.startswith("geo_") for n in r.needs) else ""
        groups.setdefault((frozenset(r.columns), own), []).append(r)
    return [(g[0].columns, g) for g in groups.values()]


@dataclass(frozen=True)
class Combos:
    """The combinations of several key sets, from one pass over an input."""

    sets: list[tuple[str, ...]]
    rows: DataFrame


def shared_combos(df: DataFrame, rules: Iterable[Rule], carry: Sequence[str] = ()) -> Combos | None:
    """What ``single_pass`` reads of ``df`` for those of ``rules`` that need no reference table."""
    sets = distinct_key_sets([r.columns for r in applicable_rules(rules, df.columns) if not r.needs])
    return Combos(sets, unique_combos_all(df, sets, carry)) if sets else None


def run_tests(df: DataFrame, rules: Iterable[Rule], refs: References | None = None, single_pass: bool = False,
              carry: Sequence[str] = (), combos: Combos | None = None) -> Run:
    """Run every applicable rule over the distinct combinations of its columns.

    Rules with equal key columns share one aggregation. By default each key set is aggregated on its own and
    reads only its columns; ``single_pass`` builds the combinations of all rules that need no reference
    table in one read of ``df``, for inputs that are expensive to produce; ``combos`` gives them as they were stored for these rules or more.
    """
    refs = refs or References()
    candidates = applicable_rules(rules, df.columns)
    shared = [r for r in candidates if not r.needs] if single_pass else []
    jobs = [(shared, lambda rs: _evaluate_single_pass(combos or shared_combos(df, rs, carry), rs, carry))] if shared else []
    for columns, family in _families([r for r in candidates if r not in shared]):
        jobs.append((family, lambda rs, columns=columns: evaluate(unique_combos(df, columns, carry), rs, refs, carry)))
    parts, good, bad = [], [], []
    for members, build in jobs:
        part, built, broken = _each_buildable(members, build)
        good += built
        bad += broken
        if part is not None:
            parts.append(part)
    spark = df.sparkSession
    failed = spark.createDataFrame(bad, FAILED_SCHEMA)
    if not parts:
        return Run(spark.createDataFrame([], RESULT_SCHEMA), failed, [])
    return Run(reduce(DataFrame.unionByName, parts), failed, good)


def _evaluate_single_pass(combos: Combos, rules: Sequence[Rule], carry: Sequence[str]) -> DataFrame:
    source = column_source()  # within its own set a column is never null
    members = {frozenset(s): i for i, s in enumerate(combos.sets)}
    per_set: dict[int, list[Column]] = {}
    for r in rules:
        per_set.setdefault(members[frozenset(r.columns)], []).append(_entry(r, source))
    choice = None
    for i, entries in per_set.items():
        cond = F.col("set_id") == i
        choice = F.when(cond, F.array(*entries)) if choice is None else choice.when(cond, F.array(*entries))
    return _flatten(combos.rows.select(*[N.col(c) for c in carry], "count", F.inline(choice)), carry)


def run_map_tests(rows: DataFrame, rules: Iterable[Rule], carry: Sequence[str], values: str = "values",
                  columns: Sequence[str] | None = None, refs: References | None = None) -> DataFrame:
    """:func:`run_tests` for rows that hold their values in a map, with a group such as a run id in ``carry``.

    A rule applies to a row when the map has all its columns, so tables with different headers run
    together. ``columns`` narrows the rules beforehand. Rules whose reference tables are not in ``refs`` are not run here.
    """
    refs = refs or References()
    chosen = [r for r in rules if r.type != "Measure" and r.columns and not missing_tables(r, refs)
              and (columns is None or set(r.columns) <= set(columns))]
    parts = []
    for keys, family in _families(chosen):
        have = reduce(lambda a, b: a & b, [F.map_contains_key(F.col(values), F.lit(k)) for k in keys])
        combos = unique_combos(rows.filter(have), keys, carry, map_source(F.col(values)))
        parts.append(evaluate(combos, family, refs, carry))
    if not parts:
        none = rows.limit(0).select(*[N.col(c) for c in carry])
        return none.unionByName(rows.sparkSession.createDataFrame([], RESULT_SCHEMA), allowMissingColumns=True)
    return reduce(DataFrame.unionByName, parts)


def evaluate_requests(requests: DataFrame, rules: Iterable[Rule], refs: References | None = None,
                      ordered: bool = False) -> DataFrame:
    """Answer requests (seq, id, params): seq, id, test_id, status, result, comment.

    An id is a label or a guid. Blank and unknown ids, and parameters of the wrong type, answer with an error of their own and do not
    stop the others. A parameter that a test has and a request does not give takes its published default
    (``with_default_params``), else the rule's own. Rules without reference needs are answered in one projection; each rule with needs is a
    branch over its own requests. Rows carry ``seq``, so order is restored by sorting (``ordered``).
    """
    refs = refs or References()
    rules = list(rules)
    by_name = {**{r.guid: r for r in rules}, **{r.id: r for r in rules}}
    keyed_requests = requests.withColumn("__id", F.coalesce("id", F.lit("")))
    source = map_source(F.col("params"))
    # one entry for each registered name; a join would become a nested loop where all requests ask for one literal id
    names = F.map_from_arrays(F.array(*[F.lit(k) for k in by_name]).cast("array<string>"), F.array(*[
        F.struct(F.lit(r.id).alias("test_id"), F.array(*[F.lit(p) for p in sorted(r.params)]).cast("array<string>").alias("parameters"), F.lit(r.class_name).alias("class"))
        for r in by_name.values()]).cast("array<struct<test_id:string,parameters:array<string>,class:string>>"))
    rule = F.try_element_at(names, F.col("__id"))
    known = keyed_requests.withColumns({"test_id": rule["test_id"], "__parameters": rule["parameters"], "__class": rule["class"]})
    known = with_default_params(known, parameters="__parameters", class_name="__class")

    pure = [r for r in rules if not r.needs]
    answer = (
        F.when(F.col("__id") == "", unmet("Missing id (label or guid)"))
        .when(F.col("test_id").isNull(), unmet(F.concat(F.lit("Unknown test id or guid: "), F.col("__id"))))
    )
    for r in pure:
        answer = answer.when(F.col("test_id") == r.id, bind(r, source, F.col("params")))
    with_needs = [r for r in rules if r.needs]
    parts = [known.filter(~F.coalesce(F.col("test_id").isin([r.id for r in with_needs]), F.lit(False)))
             .withColumn("response", answer)]
    for r in with_needs:
        mine = known.filter(F.col("test_id") == r.id)
        try:
            out = attach_answers(mine, r, source, refs, F.col("params")).withColumn("response", bind(r, source, F.col("params")))
        except MissingReference as error:
            out = mine.withColumn("response", unmet(str(error), external=True))
        parts.append(out)
    flat = [p.select("seq", "id", "test_id", "response.status", "response.result", "response.comment") for p in parts]
    out = reduce(DataFrame.unionByName, flat)
    return out.orderBy("seq") if ordered else out


def batch_summary(responses: DataFrame) -> DataFrame:
    """One row: batch size, items that could not be run, and whether all items ask for one test."""
    return responses.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("status") == N.INTERNAL_UNMET).alias("failed"),
        (F.count_distinct(F.struct("id")) <= 1).alias("homogeneous"),  # a missing id counts as an id of its own
    )


def observe_run(results: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """Attach progress figures that Spark fills in while the results are computed by any later action."""
    seen = Observation(name)
    watched = results.observe(
        seen, F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(F.col("status") == N.INTERNAL_UNMET, 1).otherwise(0)).alias("unmet"),
        F.sum(F.when(F.col("status").isin(*N.ACTIONABLE), 1).otherwise(0)).alias("actionable"),
    )
    return watched, seen


def union_results(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union of per-test frames; text columns a frame lacks become ``''``. Base columns come first, then
    field columns by name, then what is left."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    kinds = dict(out.dtypes)
    fields = sorted(c for c in out.columns if c not in N.RESULT_COLUMNS and ":" in c)
    rest = [c for c in out.columns if c not in N.RESULT_COLUMNS and c not in fields]
    present = [c for c in N.RESULT_COLUMNS if c in out.columns]
    return out.select(*[
        F.coalesce(N.col(c), F.lit("")).alias(c) if kinds[c] == "string" else N.col(c)
        for c in present + fields + rest])


def to_wide(results: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The sparse form of a result table: one column per field, ``''`` where a test does not read it."""
    rest = [c for c in results.columns if c not in [*N.RESULT_COLUMNS, "values", "changes"]]
    return results.select(
        *N.RESULT_COLUMNS, *[F.coalesce(F.col("values")[f], F.lit("")).alias(f) for f in sorted(fields)],
        *[N.col(c) for c in rest])


def fields_of(rules: Iterable[Rule]) -> list[str]:
    return sorted({c for r in rules for c in r.columns})


def empty_results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULT_SCHEMA)
