"""Catalogue operators: listing, preference, lookup, applicability and parameter defaults."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.sizing import small
from plumbline.functions.text import strip
from plumbline.rules.registry import Rule

# Header of a published test list → our column.
CATALOGUE_HEADERS = {
    "ie class": "ie_class",
    "informationelement:actedupon": "ie_acted_upon",
    "informationelement:consulted": "ie_consulted",
    "description": "description",
    "notes": "notes",
    "type": "type",
    "usecases": "usecases",
}

# Default parameters by local name, and those that depend on the class family.
PARAMETER_DEFAULTS = {
    "geospatialLand": "Union of NaturalEarth 10m-physical-vectors for Land and NaturalEarth Minor Islands",
    "assumptionOnUnknownBiome": "noassumption",
    "spatialBufferInMeters": "3000",
    "taxonIsMarine": "World Register of Marine Species (WoRMS)",
}
SOURCE_AUTHORITY_BY_FAMILY = {
    ".georeference.": "NE_10M_ADMIN_0_COUNTRIES",
    ".metadata.": "NE_10M_ADMIN_0_COUNTRIES",
    ".sciname.": "GBIF Backbone Taxonomy",
}


def _first_per(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def _preference(seq: str) -> list[Column]:
    return [
        F.substring_index("class_name", ".", -1).endswith("Defaults").desc(),
        F.size("parameters").asc(), F.col(seq).asc(),
    ]


def prefer_tests(catalogue: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """One row per ``key``: a ``…Defaults`` class first, then fewer parameters, then the first seen."""
    return _first_per(catalogue, [F.col(key)], _preference(seq))


def list_tests(catalogue: DataFrame, seq: str = "seq") -> DataFrame:
    """Listing of a catalogue: one test per guid; tests without a guid join by id unless that id is listed
    already. Sort by id when showing it; the result itself is unordered."""
    has_guid = F.coalesce(F.col("guid") != "", F.lit(False))
    by_guid = prefer_tests(catalogue.filter(has_guid), "guid", seq)
    loose = prefer_tests(catalogue.filter(~has_guid & (F.coalesce("id", F.lit("")) != "")), "id", seq)
    return by_guid.unionByName(loose.join(by_guid.select("id"), "id", "left_anti"))


def find_tests(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add ``test_id`` to requests: the id where it is a known label, else the test with that guid."""
    labels = small(catalogue.select(F.col("id").alias("__label")).distinct())
    guids = small(catalogue.filter("guid <> ''").groupBy(F.col("guid").alias("__guid"))
                  .agg(F.min("id").alias("__by_guid")))
    return (
        requests.join(labels, F.col("id") == F.col("__label"), "left")
        .join(guids, F.col("id") == F.col("__guid"), "left")
        .withColumn("test_id", F.coalesce("__label", "__by_guid"))
        .drop("__label", "__guid", "__by_guid")
    )


def applicable_tests(catalogue: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Tests of another type than Measure whose columns all exist."""
    have = F.array(*[F.lit(c) for c in columns]).cast("array<string>")
    needed = F.concat(F.coalesce("acted_upon", F.array().cast("array<string>")),
                      F.coalesce("consulted", F.array().cast("array<string>")))
    return catalogue.filter((F.col("type") != "Measure") & (F.size(F.array_except(needed, have)) == 0))


def applicable_rules(rules: Iterable[Rule], columns: Iterable[str]) -> list[Rule]:
    """:func:`applicable_tests` for registered rules; rules that read no column are left out."""
    have = set(columns)
    return [r for r in rules if r.type != "Measure" and r.columns and set(r.columns) <= have]


def with_default_params(requests: DataFrame, params: str = "params", parameters: str = "parameters",
                        class_name: str = "class_name") -> DataFrame:
    """Add the default of every parameter a test declares and the request does not give.

    Parameters are matched by their local name, whatever the namespace before ``:``; a blank value is none.
    """
    defaults = F.create_map(*[F.lit(x) for kv in PARAMETER_DEFAULTS.items() for x in kv])
    authority = F.lit(None).cast("string")
    for family, value in SOURCE_AUTHORITY_BY_FAMILY.items():
        authority = F.when(F.col(class_name).contains(family), F.lit(value)).otherwise(authority)

    def default_of(p: Column) -> Column:
        local = F.substring_index(p, ":", -1)
        return F.when(local == "sourceAuthority", authority).otherwise(defaults[local])

    given = F.coalesce(F.col(params), F.create_map().cast("map<string,string>"))
    filled = F.map_filter(given, lambda k, v: F.btrim(F.coalesce(v, F.lit(""))) != "")
    named = F.transform(F.map_keys(filled), lambda k: F.substring_index(k, ":", -1))
    missing = F.filter(F.array_distinct(F.coalesce(F.col(parameters), F.array().cast("array<string>"))), lambda p: (
        (F.coalesce(p, F.lit("")) != "") & ~F.array_contains(named, F.substring_index(p, ":", -1)) & default_of(p).isNotNull()))
    given = F.map_filter(given, lambda k, v: ~F.array_contains(missing, k))
    added = F.map_from_arrays(missing, F.transform(missing, default_of))
    return requests.withColumn(params, F.map_concat(given, F.coalesce(added, F.create_map().cast("map<string,string>"))))


def normalise_catalogue(raw: DataFrame) -> DataFrame:
    """Headers of a published test list: trimmed, inner spaces collapsed, known ones renamed; cells lose a
    trailing carriage return, and ids are trimmed."""
    names = []
    for c in raw.columns:
        clean = " ".join(c.replace("\r", "").split())
        names.append(CATALOGUE_HEADERS.get(clean.lower(), clean))
    out = raw.toDF(*names)
    fixed = {n: F.regexp_replace(F.coalesce(F.col(f"`{n}`"), F.lit("")), r"\r$", "") for n in names}
    if "test_id" in fixed:
        fixed["test_id"] = strip(fixed["test_id"])
    return out.select(*[e.alias(n) for n, e in fixed.items()])


def one_per_test(catalogue: DataFrame, key: str = "test_id") -> DataFrame:
    """Deterministic de-duplication of a catalogue on the trimmed test id."""
    rest = sorted(c for c in catalogue.columns if c != key)
    order = F.struct(*[F.col(f"`{c}`").cast("string") for c in rest])
    trimmed = catalogue.withColumn(key, strip(F.col(key)))
    return _first_per(trimmed.withColumn("__o", order), [F.col(key)], [F.col("__o").asc_nulls_last()]).drop("__o")


def catalogue_coverage(results: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Distinct result test ids with ``known``: whether the catalogue has them."""
    ids = results.select(strip(F.col("test_id")).alias("test_id")).distinct()
    known = small(catalogue.select(strip(F.col("test_id")).alias("test_id")).distinct().withColumn("known", F.lit(True)))
    return ids.join(known, "test_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def context_of(rules_catalogue: DataFrame) -> DataFrame:
    """Catalogue rows as test context: ``test_id`` and texts, lists packed by comma."""
    packed: Mapping[str, str] = {"ie_acted_upon": "ie_acted_upon", "ie_consulted": "ie_consulted", "usecases": "usecases"}
    return rules_catalogue.select(
        F.col("id").alias("test_id"), "description", "notes", "type", "ie_class",
        *[F.concat_ws(",", F.col(c)).alias(n) for n, c in packed.items()])
