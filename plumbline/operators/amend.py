"""Applying proposed changes back to a table by value, and reporting what changed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import names as N
from plumbline.functions.sizing import BROADCAST_LIMIT
from plumbline.functions.text import case_change, key_text, parse_pairs
from plumbline.operators.combos import unique_combos
from plumbline.operators.filters import actionable
from plumbline.operators.skew import left_join_hot
from plumbline.rules.registry import Rule, bind, columns_source

# A combination that holds more than this share of a test's rows is joined apart from the others. At most
# 1 / HOT_SHARE combinations per test can do so, which bounds the table that is broadcast for them.
HOT_SHARE = 0.001
# Bytes a result row is taken to need beside its texts, when the size of a broadcast is worked out.
ROW_OVERHEAD = 256


def _pairs(results: DataFrame) -> Column:
    """Proposed (field, value) pairs: the typed changes where they exist, else the packed text."""
    packed = parse_pairs(F.col("result"))
    if "changes" not in results.columns:
        return packed
    typed = F.transform(F.map_entries("changes"), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value")))
    return F.when(F.col("changes").isNotNull(), typed).otherwise(packed)


def _key(results: DataFrame, name: str) -> Column:
    """The value a result was computed for: from the values map, else from the column of that name."""
    if "values" in results.columns:
        return F.coalesce(F.col("values")[name], F.lit(""))
    return F.coalesce(N.col(name).cast("string"), F.lit("")) if name in results.columns else F.lit("")


@dataclass(frozen=True)
class KeySet:
    """The key columns shared by some tests, the fields those tests write, the rows one test covers and the
    size of what is to be written."""

    acted_cols: str
    consulted_cols: str
    keys: tuple[str, ...]
    fields: tuple[str, ...]
    rows: int
    bytes: int


def key_sets(results: DataFrame, columns: Sequence[str]) -> list[KeySet]:
    """Key sets of the actionable tests. One row per key set reaches the driver, so its size is bounded by the
    number of tests, not by the data."""
    hits = F.col("status").isin(*N.ACTIONABLE)
    fields = F.when(hits, F.transform(_pairs(results), lambda p: p["field"]))
    count = F.col("count").cast("bigint") if "count" in results.columns else F.lit(1).cast("bigint")
    size = F.lit(ROW_OVERHEAD) + sum((2 * F.length(F.coalesce(c, F.lit(""))) for c in ("result", "actedUpon", "consulted")), F.lit(0))
    per_test = results.groupBy("actedUpon_cols", "consulted_cols", "test_id").agg(
        F.sum(count).alias("rows"), F.sum(F.when(hits, size)).alias("bytes"), F.collect_set(fields).alias("fields"), F.max(hits).alias("hit"))
    found = per_test.filter("hit").groupBy("actedUpon_cols", "consulted_cols").agg(
        F.max("rows").alias("rows"), F.sum("bytes").alias("bytes"),
        F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list("fields"))))).alias("fields"))
    out = []
    for row in found.collect():
        packed = [row["actedUpon_cols"] or "", row["consulted_cols"] or ""]
        keys = tuple(dict.fromkeys(c for p in packed for c in p.split("|") if c in columns))
        if keys:
            out.append(KeySet(row["actedUpon_cols"], row["consulted_cols"], keys,
                              tuple(f for f in row["fields"] if f in columns), int(row["rows"] or 0), int(row["bytes"])))
    return sorted(out, key=lambda k: (k.acted_cols or "", k.consulted_cols or ""))


def _of_set(results: DataFrame, s: KeySet) -> DataFrame:
    return results.filter(F.col("actedUpon_cols").eqNullSafe(s.acted_cols) & F.col("consulted_cols").eqNullSafe(s.consulted_cols))


def _writes(results: DataFrame, s: KeySet, strict_blank_mismatch: bool) -> DataFrame:
    """Per key combination: a map from field to (order, value), the last write by (test_id, seq) winning."""
    mine = actionable(_of_set(results, s))
    names = [f"__k{i}" for i in range(len(s.keys))]
    order = F.struct(F.col("test_id").alias("test_id"),
                     (F.col("seq") if "seq" in results.columns else F.lit(0)).cast("bigint").alias("seq"),
                     F.coalesce("result", F.lit("")).alias("result"))
    rows = mine.select(*[_key(results, k).alias(n) for k, n in zip(s.keys, names)], order.alias("order"),
                       F.explode(_pairs(results)).alias("pair"))
    rows = rows.filter(F.col("pair.field").isin(*s.fields) & F.col("pair.value").isNotNull())
    if strict_blank_mismatch:
        rows = rows.filter(reduce(lambda a, b: a & b, [F.col(n) != "" for n in names]))
    cell = rows.groupBy(*names, F.col("pair.field").alias("field")).agg(
        F.max(F.struct("order", F.col("pair.value").alias("value"))).alias("write"))
    return cell.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("field", "write"))).alias("writes"))


def _hot_keys(results: DataFrame, s: KeySet, names: Sequence[str]) -> DataFrame:
    """Combinations that hold more than HOT_SHARE of a test's rows, whether amended or not."""
    threshold = max(1, int(s.rows * HOT_SHARE))
    return _of_set(results, s).filter(F.col("count").cast("bigint") > threshold).select(
        *[_key(results, k).alias(n) for k, n in zip(s.keys, names)]).distinct()


def _match(df: DataFrame, results: DataFrame, s: KeySet, index: int, strict: bool) -> DataFrame:
    """Left join of the writes of one key set as ``__w{index}``.

    Writes whose measured size is within BROADCAST_LIMIT are broadcast: the table is not shuffled. Beyond
    that the join shuffles, and the hot combinations, which the counts already tell, are kept out of it.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    names = [f"__k{i}" for i in range(len(s.keys))]
    writes = _writes(results, s, strict)
    out = df.withColumns({n: key_text(N.col(k), types[k]) for k, n in zip(s.keys, names)})
    if s.bytes <= BROADCAST_LIMIT:
        return out.join(F.broadcast(writes.withColumnRenamed("writes", f"__w{index}")), names, "left").drop(*names)
    if s.rows * HOT_SHARE < 1 or "count" not in results.columns:
        return out.join(writes.withColumnRenamed("writes", f"__w{index}"), names, "left").drop(*names)
    hot = _hot_keys(results, s, names)
    return left_join_hot(out, writes.withColumnRenamed("writes", f"__w{index}"), names, hot).drop(*names)


def apply_amendments(df: DataFrame, results: DataFrame, strict_blank_mismatch: bool = False) -> DataFrame:
    """The table with every AMENDED / FILLED_IN result applied to the rows it was computed for.

    Rows match on their original values, null and ``''`` being equal; changes of later tests (by test id)
    override earlier ones per cell; fields that are no columns are skipped. With ``strict_blank_mismatch``
    results whose key holds a blank match nothing. A proposed text that the column's type cannot hold is not written. One join per key set, not per test. ``results`` is
    read several times, so pass a stored table.
    """
    sets = [s for s in key_sets(results, df.columns) if s.fields]
    if not sets:
        return df
    out = df
    for i, s in enumerate(sets):
        out = _match(out, results, s, i, strict_blank_mismatch)
    columns = []
    for c in df.columns:
        writers = [F.col(f"__w{i}")[c] for i, s in enumerate(sets) if c in s.fields]
        if not writers:
            columns.append(N.col(c))
            continue
        last = writers[0] if len(writers) == 1 else F.greatest(*writers)
        columns.append(F.coalesce(last["value"].try_cast(df.schema[c].dataType), N.col(c)).alias(c))
    return out.select(*columns)


def amend_inline(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """:func:`apply_amendments` without results or join, for rules that need no reference table: each rule is
    evaluated on the original row and its changes are written in order of test id."""
    chosen = sorted((r for r in rules if r.type == "Amendment" and not r.needs and set(r.columns) <= set(df.columns)),
                    key=lambda r: r.id)
    source = columns_source(df)
    answered = df.withColumns({f"__r{i}": bind(r, source) for i, r in enumerate(chosen)})
    columns = []
    for c in df.columns:
        writes = [F.when(F.col(f"__r{i}.status").isin(*N.ACTIONABLE), F.col(f"__r{i}.changes")[c])
                  for i, r in enumerate(chosen) if c in r.acted]
        value = F.coalesce(*reversed(writes)) if writes else None
        columns.append(N.col(c) if value is None else
                       F.coalesce(value.try_cast(df.schema[c].dataType), N.col(c)).alias(c))
    return answered.select(*columns)


def amend_maps(rows: DataFrame, results: DataFrame, rules: Iterable[Rule], keys: Sequence[str], values: str = "values") -> DataFrame:
    """:func:`apply_amendments` for rows ``(*keys, line, values)`` that hold their values in a map, all runs (``keys``) together.

    Every row is looked up once for each set of columns that some amendment reads, by run and values; adaptive execution splits a combination that
    many rows share. Fields that a row has not got are skipped.
    """
    sets: dict[tuple[str, ...], list[str]] = {}
    for r in rules:
        if r.type == "Amendment":
            sets.setdefault(tuple(sorted(r.columns)), []).append(r.id)
    if not sets:
        return rows

    def packed(source: str, columns: Sequence[str]) -> Column:
        return F.to_json(F.array(*[F.coalesce(F.col(source)[c], F.lit("")) for c in columns]))

    asked = F.array_compact(F.array(*[
        F.when(reduce(lambda a, b: a & b, [F.map_contains_key(values, F.lit(c)) for c in columns]), F.struct(F.lit(i).alias("set"), packed(values, columns).alias("key")))
        for i, columns in enumerate(sets)]))
    answered, place = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (columns, ids) in enumerate(sets.items()):
        mine = F.col("test_id").isin(*ids)
        answered, place = F.when(mine, packed("values", columns)).otherwise(answered), F.when(mine, F.lit(i)).otherwise(place)
    writes = actionable(results).where(F.col("changes").isNotNull()).select(*keys, place.alias("set"), answered.alias("key"), "test_id", "changes")
    writes = writes.where("set is not null").groupBy(*keys, "set", "key").agg(F.collect_list(F.struct("test_id", "changes")).alias("writes"))
    found = rows.select(*keys, "line", F.inline(asked)).join(writes, [*keys, "set", "key"])
    per_row = found.groupBy(*keys, "line").agg(F.array_sort(F.flatten(F.collect_list(F.transform("writes", lambda w: F.struct(
        w["test_id"].alias("test_id"), F.map_entries(w["changes"]).alias("changes")))))).alias("writes"))
    out = rows.join(per_row, [*keys, "line"], "left")
    # the last write of a field, by test id, else the original
    pairs = F.flatten(F.transform(F.coalesce("writes", F.array().cast("array<struct<test_id:string,changes:array<struct<key:string,value:string>>>>")),
                                  lambda w: w["changes"]))
    new = F.transform_values(values, lambda k, v: F.coalesce(F.try_element_at(F.filter(F.col("__pairs"), lambda p: (p["key"] == k) & p["value"].isNotNull()), F.lit(-1))["value"], v))
    return out.withColumn("__pairs", pairs).withColumn(values, F.when(F.col("writes").isNull(), F.col(values)).otherwise(new)).select(*rows.columns)


def amend_metrics(df: DataFrame, results: DataFrame) -> DataFrame:
    """One row: field updates applied, rows touched (summed over results) and target fields not found.

    The rows each result matches are counted on the grouped table, not on the rows.
    """
    spark = df.sparkSession
    known = F.array(*[F.lit(c) for c in df.columns])
    parts = []
    for s in key_sets(results, df.columns):
        names = [f"__k{i}" for i in range(len(s.keys))]
        mine = actionable(_of_set(results, s)).select(
            *[_key(results, k).alias(n) for k, n in zip(s.keys, names)],
            F.transform(_pairs(results), lambda p: p["field"]).alias("fields"))
        counted = unique_combos(df, s.keys).toDF(*names, "matched")
        parts.append(mine.filter(F.size("fields") > 0).join(counted, names).select("fields", "matched"))
    if not parts:
        return spark.createDataFrame([(0, 0, [])], "updates bigint, rows_touched bigint, not_found array<string>")
    hits = reduce(DataFrame.unionByName, parts)
    return hits.agg(
        F.coalesce(F.sum(F.col("matched") * F.size(F.filter("fields", lambda f: F.array_contains(known, f)))), F.lit(0)).alias("updates"),
        F.coalesce(F.sum("matched"), F.lit(0)).alias("rows_touched"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_except("fields", known))))).alias("not_found"),
    )


def change_log(results: DataFrame) -> DataFrame:
    """One row per changed field of every actionable combination: field, before, after, kind of case change,
    test and affected rows. ``before`` is null where the test did not read the field it writes."""
    fix = actionable(results)
    acted = parse_pairs(F.col("actedUpon"), keep_bare=True)
    rows = fix.select("test_id", "status", "actedUpon", "consulted", F.col("count").cast("bigint").alias("count"),
                      F.explode(_pairs(results)).alias("pair")).withColumn("acted", acted)
    before = F.try_element_at(F.filter("acted", lambda a: a["field"] == F.col("pair.field")), F.lit(1))["value"]
    out = rows.select("test_id", "status", "actedUpon", "consulted", "count", F.col("pair.field").alias("field"),
                      before.alias("before"), F.col("pair.value").alias("after"))
    return out.withColumn("case_change", case_change(F.col("before"), F.col("after")))
