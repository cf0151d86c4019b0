"""Row filters over results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import names as N
from plumbline.functions.text import test_kind

# Use cases a result list can be narrowed to.
USE_CASES = ["all", "Record-Management", "Spatial-Temporal_Patterns", "Taxon-Management", "Alien-Species",
             "Biotic-Relationships"]


def _is(name: str, values):
    return F.coalesce(F.col(name).isin(*values), F.lit(False))


def actionable(results: DataFrame) -> DataFrame:
    return results.filter(_is("status", N.ACTIONABLE))


def needs_attention(results: DataFrame) -> DataFrame:
    return results.filter(_is("result", N.ATTENTION))


def flagged(results: DataFrame) -> DataFrame:
    return results.filter(_is("result", N.ATTENTION) & _is("status", [N.HAS_RESULT]))


def curated_mask(results: DataFrame) -> DataFrame:
    return results.filter(_is("status", N.ACTIONABLE) | _is("result", N.ATTENTION))


def filter_usecase(df: DataFrame, usecase: str, column: str = "usecases", exact: bool = False) -> DataFrame:
    """Rows of one use case: text contains it, or with ``exact`` the array (or comma list) holds it."""
    if usecase == "all":
        return df
    value = F.col(column)
    if not exact:
        text = value if dict(df.dtypes)[column] == "string" else F.concat_ws(",", value)
        return df.filter(F.coalesce(text, F.lit("")).contains(usecase))
    items = F.split(value, r"\s*,\s*") if dict(df.dtypes)[column] == "string" else value
    return df.filter(F.array_contains(items, usecase))


def filter_kind(df: DataFrame, kind: str) -> DataFrame:
    return df if kind == "all" else df.filter(test_kind(F.col("test_id")) == kind)


def search_combos(df: DataFrame, term: str, columns=("combo", "comment")) -> DataFrame:
    """Case-insensitive search for a literal text in the named columns."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    return df.filter(F.lower(text).contains(term.lower()))
