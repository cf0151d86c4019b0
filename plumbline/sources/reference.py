"""Reference files: loading, reshaping, integrity and refresh."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RINGS = "array<array<array<double>>>"


def _json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def load_iso(spark: SparkSession, path: str) -> DataFrame:
    raw = _json(spark, path, "countries array<struct<alpha2:string,alpha3:string,numeric:string,name:string,region:string,subRegion:string>>")
    return raw.select(F.posexplode("countries").alias("pos", "c")).select(
        "pos", "c.alpha2", "c.alpha3", "c.numeric", "c.name", "c.region", F.col("c.subRegion").alias("sub_region"))


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(vocab, pos, term, definition); a term may carry its text as ``definition`` or ``description``."""
    raw = _json(spark, path, "vocabularies map<string,array<struct<name:string,definition:string,description:string>>>")
    named = raw.select(F.explode("vocabularies").alias("vocab", "terms"))
    return named.select(F.lower("vocab").alias("vocab"), F.posexplode("terms").alias("pos", "t")).select(
        "vocab", "pos", F.col("t.name").alias("term"), F.coalesce("t.definition", "t.description").alias("definition"))


def load_backbone(spark: SparkSession, path: str) -> DataFrame:
    raw = _json(spark, path, "ranks array<struct<kingdom:string,phylum:string,clazz:string,`order`:string,family:string,"
                             "genus:string,canonicalName:string,authorship:string>>")
    return raw.select(F.posexplode("ranks").alias("pos", "r")).select(
        "pos", "r.kingdom", "r.phylum", "r.clazz", "r.order", "r.family", "r.genus",
        F.col("r.canonicalName").alias("canonical_name"), F.coalesce("r.authorship", F.lit("")).alias("authorship"))


def load_timezones(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id, abbr, offset, description): one row per zone id; a zone without ids has none."""
    raw = _json(spark, path, "zones array<struct<ids:array<string>,description:string,abbr:string,offset:double>>")
    zones = raw.select(F.posexplode("zones").alias("pos", "z"))
    return zones.select("pos", F.explode("z.ids").alias("id"), "z.abbr", "z.offset", "z.description")


def load_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """(poly_id, part, iso_a2, name, rings, bounding box) of a GeoJSON feature collection.

    The code is the first present of three property names; polygons and multipolygons are kept, other
    geometry is dropped; positions need two numbers; open rings are closed.
    """
    raw = _json(spark, path, "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>")
    return shape_boundaries(raw.select(F.posexplode("features").alias("poly_id", "f")).select(
        "poly_id", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("type"),
        F.col("f.geometry.coordinates").alias("coordinates")))


def shape_boundaries(features: DataFrame) -> DataFrame:
    """Features (poly_id, properties, type, coordinates as JSON text) to boundary rows."""
    p = F.col("properties")
    # Property names that may hold the country code, in order of preference.
    iso = F.coalesce(*[p[k] for k in ("iso_a2", "ISO3166-1-Alpha-2", "ISO_A2")])
    parts = (
        F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", _RINGS)))
        .when(F.col("type") == "MultiPolygon", F.from_json("coordinates", f"array<{_RINGS}>"))
    )

    def ring(points: Column) -> Column:
        kept = F.filter(points, lambda q: F.size(q) >= 2)
        named = F.transform(kept, lambda q: F.struct(q[0].alias("lon"), q[1].alias("lat")))
        return F.when(F.size(named) == 0, named).when(F.get(named, F.lit(0)) == F.try_element_at(named, F.lit(-1)), named).otherwise(
            F.concat(named, F.slice(named, 1, 1)))

    rows = features.select("poly_id", iso.alias("iso_a2"), p["name"].alias("name"), F.posexplode(parts).alias("part", "raw"))
    rows = rows.filter(F.size("raw") > 0).select(
        "poly_id", "part", "iso_a2", "name", F.filter(F.transform("raw", ring), lambda r: F.size(r) > 0).alias("rings"))
    shell = F.col("rings")[0]
    lons, lats = F.transform(shell, lambda q: q["lon"]), F.transform(shell, lambda q: q["lat"])
    return rows.filter(F.size("rings") > 0).withColumns({
        "min_lon": F.array_min(lons), "min_lat": F.array_min(lats), "max_lon": F.array_max(lons), "max_lat": F.array_max(lats)})


# --- source shapes ------------------------------------------------------------------------------------

def shape_iso(raw: DataFrame) -> DataFrame:
    """A published country list to our columns."""
    renamed = {"alpha-2": "alpha2", "alpha-3": "alpha3", "country-code": "numeric", "name": "name", "region": "region",
               "sub-region": "sub_region"}
    have = set(raw.columns)
    return raw.select(*[(F.col(f"`{s}`") if s in have else F.lit(None)).cast("string").alias(d) for s, d in renamed.items()])


def shape_timezones(raw: DataFrame) -> DataFrame:
    """A published zone list: ids may be one text, a list or missing."""
    kind = dict(raw.dtypes).get("utc", "")
    ids = F.col("utc") if kind.startswith("array") else F.when(F.col("utc").isNotNull(), F.array("utc"))
    return raw.select(F.coalesce(ids, F.array().cast("array<string>")).alias("ids"), F.col("value").alias("description"),
                      "abbr", F.col("offset").cast("double").alias("offset"))


def shape_vocab(raw: DataFrame, name: str) -> DataFrame:
    """A published vocabulary page (results array) to (vocab, pos, term, definition, deprecated)."""
    return raw.select(F.posexplode("results").alias("pos", "t")).select(
        F.lit(name.lower()).alias("vocab"), "pos", F.col("t.name").alias("term"), F.col("t.definition").alias("definition"),
        F.coalesce(F.col("t.deprecated"), F.lit(False)).alias("deprecated"))


# --- integrity ----------------------------------------------------------------------------------------

def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content, modified) of reference files; reference files are small by nature."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.col("modificationTime").alias("modified"))


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Provenance of every manifest entry (name, source, filename, checksum): expected and actual SHA-256, size,
    and whether they agree, case not counting. A missing file agrees with nothing."""
    modified = F.col("modified") if "modified" in files.columns else F.lit(None).cast("timestamp")
    actual = files.select("filename", F.sha2(F.col("content").cast("binary"), 256).alias("actual"),
                          F.octet_length("content").cast("bigint").alias("size_bytes"), modified.alias("downloaded_at"))
    return manifest.join(actual, "filename", "left").select(
        "name", "source", "filename", F.col("checksum").alias("expected"), "actual", "size_bytes", "downloaded_at",
        F.coalesce(F.lower("checksum") == F.col("actual"), F.lit(False)).alias("valid"))


def manifest_status(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Presence of each dataset; see :func:`all_present` for the overall state."""
    have = files.select("filename").distinct().withColumn("present", F.lit(True))
    return manifest.join(have, "filename", "left").select("name", "filename", F.coalesce("present", F.lit(False)).alias("present"))


def all_present(status: DataFrame) -> DataFrame:
    return status.agg(F.coalesce(F.bool_and("present"), F.lit(True)).alias("up"), F.count(F.lit(1)).alias("datasets"),
                      F.count_if(~F.col("present")).alias("missing"))


def resolve_refresh(manifest: DataFrame, requested: DataFrame | Sequence[str], column: str = "names") -> DataFrame:
    """(name, known) of the requested datasets; requests are comma lists, trimmed and made distinct."""
    if not isinstance(requested, DataFrame):
        requested = manifest.sparkSession.createDataFrame([(r,) for r in requested], f"{column} string")
    wanted = requested.select(F.explode(F.split(column, ",")).alias("n")).select(F.btrim("n").alias("name")).filter("name <> ''").distinct()
    known = manifest.select("name").distinct().withColumn("known", F.lit(True))
    return wanted.join(known, "name", "left").select("name", F.coalesce("known", F.lit(False)).alias("known"))
