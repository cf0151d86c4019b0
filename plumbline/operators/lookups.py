"""Reference lookups: countries, vocabularies, time zones and the taxonomic backbone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.coords import number
from plumbline.functions.sizing import is_small, small
from plumbline.functions.text import strip
from plumbline.operators.geo import point_countries
from plumbline.operators.names import NameIndex, build_index, search_index
from plumbline.operators.skew import hot_keys, left_join_hot
from plumbline.rules.registry import Inputs, Rule, Source, answer_column


def keyed(table: DataFrame, key: Column, order: str | None = None, name: str = "answer") -> DataFrame:
    """(key, answer): one struct of all columns per key; the first row by ``order`` wins, blanks have none."""
    row = F.struct(*[F.col(f"`{c}`") for c in table.columns])
    pos = F.col(order) if order else F.to_json(row)
    return (
        table.select(key.alias("key"), row.alias(name), pos.alias("__pos"))
        .filter((F.col("key") != "") & F.col("key").isNotNull())
        .groupBy("key").agg(F.min_by(name, "__pos").alias(name))
    )


def with_answer(df: DataFrame, key: Column, table: DataFrame, out: str) -> DataFrame:
    """Left join of a keyed table: broadcast when its size is known to be small, else a shuffle join that
    keeps the hot keys of ``df`` apart."""
    side = table.select(F.col("key").alias("__key"), F.col("answer").alias(out))
    keyed_df = df.withColumn("__key", key)
    if is_small(side):
        return keyed_df.join(F.broadcast(side), "__key", "left").drop("__key")
    return left_join_hot(keyed_df, side, ["__key"], hot_keys(keyed_df, ["__key"])).drop("__key")


def collapse(c: Column) -> Column:
    """Name with outer spaces removed and inner runs collapsed."""
    return F.regexp_replace(strip(c), r"\s+", " ")


def country_by_alpha2(df: DataFrame, c: str, iso: DataFrame, out: str = "country_row") -> DataFrame:
    return with_answer(df, F.upper(F.col(c)), keyed(iso, F.upper("alpha2"), _pos(iso)), out)


def country_by_alpha3(df: DataFrame, c: str, iso: DataFrame, out: str = "country_row") -> DataFrame:
    return with_answer(df, F.upper(F.col(c)), keyed(iso, F.upper("alpha3"), _pos(iso)), out)


def country_by_name(df: DataFrame, c: str, iso: DataFrame, out: str = "country_row") -> DataFrame:
    return with_answer(df, F.lower(collapse(F.col(c))), keyed(iso, F.lower(collapse(F.col("name"))), _pos(iso)), out)


def _pos(table: DataFrame) -> str | None:
    return "pos" if "pos" in table.columns else None


def vocab_terms(vocab: DataFrame, name: str) -> DataFrame:
    """Terms of one vocabulary; names are compared in lower case."""
    return vocab.filter(F.lower("vocab") == name.lower())


def tz_offset(df: DataFrame, c: str, zones: DataFrame, first_only: bool = False) -> DataFrame:
    """Add ``offsets``: every offset a zone id has, in zone order (an id may stand in several zones); with
    ``first_only`` just the first as ``offset``."""
    pos = F.col("pos") if "pos" in zones.columns else F.col("offset")
    per_id = zones.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(pos.alias("p"), "offset"))).alias("o"))
    per_id = per_id.select(F.col("id").alias("__id"), F.transform("o", lambda x: x["offset"]).alias("offsets"))
    joined = df.join(small(per_id), F.col(c) == F.col("__id"), "left").drop("__id")
    if not first_only:
        return joined
    return joined.withColumn("offset", F.try_element_at("offsets", F.lit(1))).drop("offsets")


# --- taxonomy -------------------------------------------------------------------------------------

def taxon_exact(df: DataFrame, c: str, backbone: DataFrame, out: str = "taxon") -> DataFrame:
    """Backbone entry by canonical name, without case; the first entry wins, blank finds none."""
    return with_answer(df, F.lower(strip(F.col(c))), keyed(backbone, F.lower(strip(F.col("canonical_name"))), _pos(backbone)), out)


def taxon_key(name: Column) -> Column:
    """Stable positive key of a name: |31 + h| + 1000 in 32-bit arithmetic, h being the polynomial text
    hash with base 31."""
    codes = F.transform(F.filter(F.split(name, ""), lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("bigint"))
    raw = F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, v: F.pmod(acc * 31 + v, F.lit(2**32)))
    wrapped = F.pmod(raw + 31, F.lit(2**32))
    signed = F.when(wrapped >= 2**31, wrapped - 2**32).otherwise(wrapped)
    return F.abs(signed) + 1000


def backbone_index(backbone: DataFrame, path: str | None = None) -> NameIndex:
    """The stored index for :func:`taxon_search` and :func:`taxon_query`; build it once for a backbone and pass it on."""
    pos = _pos(backbone)
    key = F.lower(collapse(F.coalesce(F.col("canonical_name"), F.lit(""))))
    return build_index(backbone, key, F.col(pos) if pos else F.to_json(F.struct(*backbone.columns)), path)


def taxon_search(names: DataFrame, c: str, backbone: DataFrame | NameIndex, limit: int = 100) -> DataFrame:
    """(query, rank, exact, backbone columns): entries whose canonical name equals the query, else those that
    contain it, at most ``limit`` per query, by name.

    Containment looks at the shortest posting lists of the query's letter triples only (see ``names``). A backbone that
    is no index yet is indexed first.
    """
    index = backbone if isinstance(backbone, NameIndex) else backbone_index(backbone)
    queries = names.select(F.lower(collapse(F.col(c))).alias("query"))
    return search_index(queries, index, limit).select("query", "rank", "exact", "entry.*")


def genus_search(names: DataFrame, c: str, backbone: DataFrame) -> DataFrame:
    """One row per distinct queried genus that the backbone knows, with the ranks of its first entry."""
    queries = names.select(F.lower(strip(F.col(c))).alias("query")).filter("query <> ''").distinct()
    named = backbone.where(F.coalesce("canonical_name", F.lit("")) != "")
    ranks = named.select(*[x for x in backbone.columns if x != "canonical_name"])
    genera = keyed(ranks, F.lower(F.col("genus")), _pos(backbone))
    return queries.join(small(genera), F.col("query") == F.col("key")).select("query", "answer.*")


def taxon_by_key(df: DataFrame, c: str, backbone: DataFrame) -> DataFrame:
    """Backbone entry by numeric key; of several names with one key the last one counts."""
    order = F.col("pos") if "pos" in backbone.columns else F.col("canonical_name")
    table = backbone.filter(F.col("canonical_name").isNotNull()).select(
        taxon_key(F.col("canonical_name")).alias("__key"), F.struct(*backbone.columns).alias("entry"), order.alias("__o"))
    table = table.groupBy("__key").agg(F.max_by("entry", "__o").alias("taxon"))
    return df.join(small(table), F.col(c).cast("bigint") == F.col("__key"), "left").drop("__key")


EPOCH = "1970-01-01T00:00:00Z"  # fixed value: the date of creation in usage records


def taxon_usage(df: DataFrame, genus: bool = False, dataset: str = "backbone") -> DataFrame:
    """Usage records of backbone rows: key, names, status, rank and the ranks with blanks for missing ones."""
    name = F.col("genus") if genus else F.col("canonical_name")
    text = F.coalesce(name, F.lit(""))
    key = taxon_key(F.concat(F.lit("genus:"), text) if genus else text)
    def rank_text(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`"), F.lit(""))
    usage = F.struct(
        key.alias("key"), key.alias("usageKey"), F.lit(dataset).alias("datasetKey"),
        text.alias("scientificName"), text.alias("canonicalName"), F.lit("ACCEPTED").alias("taxonomicStatus"),
        F.lit("GENUS" if genus else "SPECIES").alias("rank"),
        rank_text("kingdom").alias("kingdom"), rank_text("phylum").alias("phylum"),
        F.col("clazz").alias("class"), F.col("clazz"),
        rank_text("order").alias("order"), rank_text("family").alias("family"), rank_text("genus").alias("genus"),
        *([] if genus else [F.lit("").alias("authorship")]), F.lit(0).alias("numDescendants"), F.lit(False).alias("synonym"),
        F.concat(F.lit("local-genus:" if genus else "local:"), text if genus else key.cast("string")).alias("taxonID"),
        F.lit(EPOCH).alias("created"),
    )
    return df.withColumn("usage", usage).withColumn("usage_json", F.to_json("usage"))


def taxon_query(requests: DataFrame, backbone: DataFrame, dataset: str = "backbone", index: NameIndex | None = None) -> DataFrame:
    """Answer search requests (request_id, name, q, rank, dataset_key, max_rows).

    The name falls back to ``q``; another dataset finds nothing; rank GENUS searches genera, any other rank
    species; ``max_rows`` is 100 where missing. Rows: request_id, rank_no and the found entry.
    """
    wanted = requests.filter(F.coalesce(F.col("dataset_key"), F.lit("")).isin("", dataset)).select(
        "request_id", F.coalesce("name", "q").alias("__name"), F.upper(F.coalesce("rank", F.lit(""))).alias("__rank"),
        F.coalesce(F.col("max_rows").try_cast("int"), F.lit(100)).alias("__max"))
    genus_in = wanted.filter("__rank = 'GENUS'")
    genus = genus_in.join(genus_search(genus_in, "__name", backbone).withColumnRenamed("query", "__q"),
                          F.lower(strip(F.col("__name"))) == F.col("__q")).select(
        "request_id", F.lit(1).alias("rank_no"), F.lit("GENUS").alias("found_rank"), F.col("genus").alias("found_name"))
    species_in = wanted.filter("__rank <> 'GENUS'")
    # the longest list that any request asks for bounds the search; lists are then cut per request
    most = species_in.agg(F.max("__max")).first()[0]
    if most is None or most < 1:
        return genus
    species = species_in.join(
        taxon_search(species_in, "__name", index or backbone, limit=most).select(
            F.col("query").alias("__q"), F.col("rank").alias("rank_no"), F.col("canonical_name").alias("found_name")),
        F.lower(collapse(F.col("__name"))) == F.col("__q")).filter("rank_no <= __max").select(
        "request_id", "rank_no", F.lit("SPECIES").alias("found_rank"), "found_name")
    return genus.unionByName(species)


def fresh(df: DataFrame, ttl: str, at: str = "fetched_at", now: Column | None = None) -> DataFrame:
    """Rows whose timestamp plus ``ttl`` (an interval text such as ``12 hours``) has not passed yet."""
    return df.filter(F.col(at) + F.expr(f"INTERVAL {ttl}") >= (now if now is not None else F.current_timestamp()))


# --- answers for rules ------------------------------------------------------------------------------

@dataclass(frozen=True)
class References:
    """The reference tables a run may use. A rule whose table is missing is reported as failed."""

    iso: DataFrame | None = None
    backbone: DataFrame | None = None
    habitat: DataFrame | None = None
    boundaries: DataFrame | None = None


class MissingReference(ValueError):
    """A rule asks for a reference table that was not supplied."""


_LAT, _LON = "dwc:decimalLatitude", "dwc:decimalLongitude"


def _table(refs: References, name: str) -> DataFrame:
    table = getattr(refs, name)
    if table is None:
        raise MissingReference(f"reference table '{name}' was not supplied")
    return table


def _by_key(table: str, key: Callable[[Source], Column], build: Callable[[DataFrame], DataFrame]):
    def attach(df: DataFrame, source: Source, refs: References, out: str, rule: Rule, param_map: Column | None = None) -> DataFrame:
        return with_answer(df, key(source), build(_table(refs, table)), out)
    return attach


def _full_name(backbone: DataFrame) -> Column:
    parts = ["canonical_name", *(["authorship"] if "authorship" in backbone.columns else [])]
    return F.concat_ws(" ", *[F.when(strip(F.col(p)) != "", strip(F.col(p))) for p in parts])


def _variants(lat: Column, lon: Column) -> Column:
    from plumbline.rules.dwc import POINT_VARIANTS
    out = []
    for i, (swap, flip_lat, flip_lon) in enumerate(POINT_VARIANTS):
        a, b = (lon, lat) if swap else (lat, lon)
        out.append(F.struct(F.lit(i).alias("i"), (-a if flip_lat else a).alias("lat"), (-b if flip_lon else b).alias("lon")))
    return F.array(*out)


def _geo_points(df: DataFrame, source: Source, refs: References, out: str, rule: Rule, param_map: Column | None = None) -> DataFrame:
    """Array over the point variants: the country codes each lies in (empty for none)."""
    boundaries = _table(refs, "boundaries")
    lat, lon = number(source(_LAT)), number(source(_LON))
    from plumbline.rules.dwc import POINT_VARIANTS
    variants = range(len(POINT_VARIANTS)) if rule.id == "AMENDMENT_COORDINATES_TRANSPOSED" else range(1)
    given = df.select(lat.alias("__y"), lon.alias("__x")).filter("__y is not null and __x is not null").distinct()
    spread = given.select("__y", "__x", F.explode(F.slice(_variants(F.col("__y"), F.col("__x")), 1, len(variants))).alias("v"))
    spread = spread.select("__y", "__x", "v.i", "v.lat", "v.lon")
    answers = point_countries(spread, boundaries)
    per_point = spread.join(answers, ["lat", "lon"]).groupBy("__y", "__x").agg(
        F.map_from_entries(F.collect_list(F.struct("i", "codes"))).alias("__m"))
    none = F.array().cast("array<string>")
    joined = df.withColumn("__lat", lat).withColumn("__lon", lon).join(
        per_point, (F.col("__lat") == F.col("__y")) & (F.col("__lon") == F.col("__x")), "left")
    return joined.withColumn(out, F.array(*[F.coalesce(F.col("__m")[i], none) for i in variants])).drop(
        "__lat", "__lon", "__y", "__x", "__m")


def _geo_near(df: DataFrame, source: Source, refs: References, out: str, rule: Rule, param_map: Column | None = None) -> DataFrame:
    """The country codes the point lies in, within the buffer of the row's own request or else the rule's."""
    lat, lon = number(source(_LAT)), number(source(_LON))
    metres = F.greatest(F.coalesce(Inputs(source, rule.params, param_map).param("spatialBufferInMeters", 0.0).try_cast("double"), F.lit(0.0)), F.lit(0.0))
    points = df.select(lat.alias("__y"), lon.alias("__x"), metres.alias("__r")).distinct()
    codes = point_countries(points, _table(refs, "boundaries"), "__y", "__x", radius="__r")
    joined = df.withColumns({"__lat": lat, "__lon": lon, "__m": metres}).join(
        codes, (F.col("__lat") == F.col("__y")) & (F.col("__lon") == F.col("__x")) & (F.col("__m") == F.col("__r")), "left")
    return joined.withColumn(out, F.coalesce("codes", F.array().cast("array<string>"))).drop(
        "__lat", "__lon", "__m", "__y", "__x", "__r", "codes")


ANSWERS = {
    "iso_alpha2": _by_key("iso", lambda s: F.upper(s("dwc:countryCode")), lambda t: keyed(t, F.upper("alpha2"), _pos(t))),
    "iso_alpha3": _by_key("iso", lambda s: F.upper(s("dwc:countryCode")), lambda t: keyed(t, F.upper("alpha3"), _pos(t))),
    "iso_code_name": _by_key("iso", lambda s: F.lower(collapse(s("dwc:countryCode"))),
                             lambda t: keyed(t, F.lower(collapse(F.col("name"))), _pos(t))),
    "iso_name": _by_key("iso", lambda s: F.lower(collapse(s("dwc:country"))),
                        lambda t: keyed(t, F.lower(collapse(F.col("name"))), _pos(t))),
    "taxon_name": _by_key("backbone", lambda s: F.lower(collapse(s("dwc:scientificName"))),
                          lambda t: keyed(t, F.lower(collapse(_full_name(t))), _pos(t))),
    "phylum": _by_key("backbone", lambda s: strip(s("dwc:phylum")), lambda t: keyed(t.select("phylum").distinct(), F.col("phylum"))),
    "habitat": _by_key("habitat", lambda s: F.lower(collapse(s("dwc:scientificName"))),
                       lambda t: keyed(t, F.lower(collapse(F.col("name"))))),
    "geo_points": _geo_points,
    "geo_near": _geo_near,
}


# The reference tables behind each answer.
ANSWER_TABLES = {
    "iso_alpha2": "iso", "iso_alpha3": "iso", "iso_code_name": "iso", "iso_name": "iso", "taxon_name": "backbone", "phylum": "backbone",
    "habitat": "habitat", "geo_points": "boundaries", "geo_near": "boundaries",
}


def missing_tables(rule: Rule, refs: References) -> list[str]:
    """The reference tables that ``rule`` needs and ``refs`` has not got."""
    return sorted({ANSWER_TABLES[n] for n in rule.needs if getattr(refs, ANSWER_TABLES[n]) is None})


def attach_answers(df: DataFrame, rule: Rule, source: Source, refs: References, param_map: Column | None = None) -> DataFrame:
    """Join what ``rule`` needs from the reference tables, one answer column per need. ``param_map`` holds each row's own parameters."""
    for name in rule.needs:
        df = ANSWERS[name](df, source, refs, answer_column(name), rule, param_map)
    return df
