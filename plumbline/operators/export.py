"""Wide exports of flagged results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import parse_pairs
from plumbline.operators.filters import flagged


def export_fields(results: DataFrame, test_id: str) -> list[str]:
    """Sorted names of the fields in the pairs of a test's flagged rows.

    Where the table has the columns that the rule declares, only those count: a value text that looks like a pair is no field, and the
    list is as short as the declaration, whatever the data hold.
    """
    rows = flagged(results).filter(F.col("test_id") == test_id)

    def distinct(names: Column) -> list[str]:
        found = rows.select(F.explode(names).alias("f")).filter("f <> ''").distinct()
        return sorted(r["f"] for r in found.collect())

    if {"actedUpon_cols", "consulted_cols"} <= set(results.columns):
        return distinct(F.split(F.concat_ws("|", "actedUpon_cols", "consulted_cols"), r"\|"))
    pairs = F.concat(*[parse_pairs(F.col(c), keep_bare=True) for c in ("actedUpon", "consulted")])
    return distinct(F.transform(pairs, lambda p: p["field"]))


def flagged_wide(results: DataFrame, test_id: str, fields: Sequence[str] | None = None) -> DataFrame:
    """Flagged rows of one test with a column per field and ``Records flagged``.

    An acted-upon value stands before a consulted one unless it is empty; fields without a value are ``''``.
    """
    names = list(fields) if fields is not None else export_fields(results, test_id)
    rows = flagged(results).filter(F.col("test_id") == test_id)

    def value(column: str, field: str):
        hit = F.filter(parse_pairs(F.col(column), keep_bare=True), lambda p: p["field"] == field)
        text = F.try_element_at(hit, F.lit(-1))["value"]
        return F.when(text != "", text)

    return rows.select(
        *[F.coalesce(value("actedUpon", n), value("consulted", n), F.lit("")).alias(n) for n in names],
        F.coalesce(F.col("count").try_cast("bigint"), F.lit(1)).alias("Records flagged"))
