"""Joins of results with test definitions and with each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.sizing import small
from plumbline.functions.text import parse_ie, parse_pairs, strip
from plumbline.operators.catalogue import one_per_test
from plumbline.operators.filters import actionable, curated_mask, flagged

# Texts shown for a result whose test is not in the catalogue.
CONTEXT_DEFAULTS = {
    "description": "No description available", "notes": "No notes available", "ie_class": "Unknown",
    "ie_acted_upon": "", "ie_consulted": "", "type": "", "usecases": "",
}

BLANK_PARTS = 16  # parts over which tests with a blank value are dealt

# Columns of the curated table, in order.
CURATED_COLUMNS = [
    "test_id", "test_type", "status", "result", "actedUpon", "consulted", "count", "actedUpon_cols",
    "consulted_cols", "description", "notes", "type", "ie_class", "ie_acted_upon", "ie_consulted", "usecases",
]


def _context(results: DataFrame, catalogue: DataFrame) -> DataFrame:
    kept = [c for c in CONTEXT_DEFAULTS if c in catalogue.columns]
    tests = one_per_test(catalogue.select("test_id", *kept))
    trimmed = results.withColumn("test_id", strip(F.coalesce("test_id", F.lit(""))))
    return trimmed.join(small(tests.withColumn("__known", F.lit(True))), "test_id", "left")


def join_context(results: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Results with the texts of their test; defaults stand in for tests the catalogue does not know."""
    joined = _context(results, catalogue)
    fills = {c: F.when(F.col("__known"), F.coalesce(c, F.lit(""))).otherwise(F.lit(v))
             for c, v in CONTEXT_DEFAULTS.items() if c in catalogue.columns}
    return joined.withColumns(fills).drop("__known")


def curated(results: DataFrame, catalogue: DataFrame, n: int | None = 500, keys: Sequence[str] = ()) -> DataFrame:
    """Actionable and needs-attention results with their test's texts, in a fixed order. The report keeps the
    first ``n`` rows, or the first of each value of ``keys`` (such as a run id); None keeps all."""
    joined = _context(curated_mask(results), catalogue)
    out = joined.select(*keys, *[c for c in CURATED_COLUMNS if c in joined.columns])
    if n is None:
        return out
    order = [F.col("count").desc(), "test_id", *[c for c in ("actedUpon", "consulted", "status", "result") if c in out.columns]]
    if keys:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return out.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")
    return out.orderBy(*order).limit(n)


def _fields(catalogue: DataFrame, *columns: str) -> DataFrame:
    """(test_id, field) for the information elements in the named columns."""
    lists = F.array_distinct(F.concat(*[parse_ie(F.col(c)) for c in columns]))
    return one_per_test(catalogue).select("test_id", F.explode(lists).alias("field"))


def amendments_for_validations(results: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(validation_id, test_id, result, count): amendments applied to a field that a flagged test reads.

    Amendment rows are summed per (test, result) before they meet the validations; which tests belong
    together is settled on the catalogue alone, by an equi-join on the field.
    """
    reads = _fields(catalogue, "ie_acted_upon", "ie_consulted").withColumnRenamed("test_id", "validation_id")
    reads = reads.join(small(flagged(results).select(strip(F.col("test_id")).alias("validation_id")).distinct()),
                       "validation_id", "left_semi")
    writes = _fields(catalogue, "ie_acted_upon")
    pairs = reads.join(small(writes), "field").select("validation_id", "test_id").distinct()
    applied = (
        actionable(results).filter(F.lower("test_type") == "amendment")
        .groupBy(strip(F.col("test_id")).alias("test_id"), F.coalesce("result", F.lit("")).alias("result"))
        .agg(F.sum(F.coalesce(F.col("count").cast("bigint"), F.lit(1))).alias("count"))
    )
    return applied.join(small(pairs), "test_id").select("validation_id", "test_id", "result", "count")


def amendment_tests(applied: DataFrame) -> DataFrame:
    """Roll-up of :func:`amendments_for_validations` per validation and amendment test."""
    return applied.groupBy("validation_id", "test_id").agg(F.sum("count").alias("count"))


def amendment_lookup(results: DataFrame, seq: str | None = None) -> DataFrame:
    """One row per (test_id, result) of the applied amendments: the last by ``seq``, counts not summed."""
    rows = actionable(results).filter(F.lower("test_type") == "amendment").withColumn("result", F.coalesce("result", F.lit("")))
    order = [F.col(seq).desc()] if seq else [F.col("actedUpon").desc(), F.coalesce("consulted", F.lit("")).desc()]
    w = Window.partitionBy("test_id", "result").orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(
        "test_id", "result", "actedUpon", F.coalesce(F.col("count").cast("bigint"), F.lit(1)).alias("count"))


def fixes_for_combos(results: DataFrame, seq: str | None = None) -> DataFrame:
    """(validation_id, field, value, flagged, test_id, result, actedUpon, count): amendments that start from
    the same field and value as a flagged test and write that field.

    Flagged combinations are summed per (test, field, value) first, so a value shared by many of them
    meets the amendments once per test and never as pairs of combinations.
    """
    bad = flagged(results).select(
        F.col("test_id").alias("validation_id"), F.coalesce(F.col("count").cast("bigint"), F.lit(1)).alias("count"),
        F.explode(F.array_distinct(parse_pairs(F.col("actedUpon"), keep_bare=True))).alias("pair"))
    bad = bad.groupBy("validation_id", "pair.field", "pair.value").agg(F.sum("count").alias("flagged"))
    look = amendment_lookup(results, seq)
    writes = F.transform(parse_pairs(F.col("result"), keep_bare=True), lambda p: p["field"])
    fixes = look.select(
        "test_id", "result", "actedUpon", "count",
        F.explode(F.array_distinct(parse_pairs(F.col("actedUpon"), keep_bare=True))).alias("pair"),
    ).withColumn("writes", writes).filter(F.array_contains("writes", F.col("pair.field"))).select(
        F.col("pair.field").alias("field"), F.col("pair.value").alias("value"), "test_id", "result", "actedUpon", "count")
    # a blank value is the one key that very many tests share: it is told apart by test as well, on both sides
    blank = F.col("value") == ""
    bad = bad.withColumn("__part", F.when(blank, F.pmod(F.xxhash64("validation_id"), F.lit(BLANK_PARTS))).otherwise(0).cast("int"))
    parts = F.when(blank, F.sequence(F.lit(0), F.lit(BLANK_PARTS - 1))).otherwise(F.array(F.lit(0)))
    fixes = fixes.withColumn("__part", F.explode(parts))
    return bad.join(fixes, ["field", "value", "__part"]).select(
        "validation_id", "field", "value", "flagged", "test_id", "result", "actedUpon", "count")


def fixes_for_item(fixes: DataFrame, validation_id: str, acted_upon: dict[str, str]) -> DataFrame:
    """The fixes of one flagged combination, given its acted-upon values."""
    match = F.lit(False)
    for field, value in acted_upon.items():
        match = match | ((F.col("field") == field) & (F.col("value") == value))
    return fixes.filter((F.col("validation_id") == validation_id) & match)


