"""Driver queries over reference data, geography, text sources, submissions and streams.

Reference tables are derived from the driver tables, so that their size grows with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.coords import grid_key
from plumbline.operators import evaluate, geo, summary
from plumbline.operators import lookups as L
from plumbline.plans import inputs as I
from plumbline.plans.inputs import Book, table
from plumbline.plans.queries_results import _SUMMARY, _summary_columns
from plumbline.plans.run import run_dataset
from plumbline.rules.dwc import REGISTRY as DWC
from plumbline.session import checkpoint_dir
from plumbline.sources import delimited, reference, sinks, submissions
from plumbline.streaming import intake, running

BOOK = Book()
query = BOOK.query


def _folder(spark, what: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


# --- countries, vocabularies, zones -----------------------------------------------------------------------------

def _iso(spark, d) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("pos"), F.concat(F.lit("n"), "n_nationkey").alias("alpha2"),
                    F.concat(F.lit("NT"), F.col("n_nationkey") % 20).alias("alpha3"), F.col("n_name").alias("name"))


@query("country_by_alpha2", "SELECT c_custkey, n_name AS country FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND c_custkey % 3 <> 0")
def _(spark, d):
    code = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("N"), "c_nationkey")).otherwise("QQ")
    c = table(spark, d, "customer").withColumn("code", code)
    return L.country_by_alpha2(c, "code", _iso(spark, d)).select("c_custkey", F.col("country_row.name").alias("country"))


@query("country_by_alpha3", "SELECT c_custkey, n_name AS country FROM customer JOIN nation ON c_nationkey % 20 = n_nationkey")
def _(spark, d):
    c = table(spark, d, "customer").withColumn("code", F.concat(F.lit("nt"), F.col("c_nationkey") % 20))
    return L.country_by_alpha3(c, "code", _iso(spark, d)).select("c_custkey", F.col("country_row.name").alias("country"))


@query("country_by_name", "SELECT c_custkey, 'n' || c_nationkey AS code FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").withColumn("name", F.concat(F.lit(" nation_"), "c_nationkey", F.lit(" ")))
    return L.country_by_name(c, "name", _iso(spark, d)).select("c_custkey", F.col("country_row.alpha2").alias("code"))


@query("vocab_terms", "SELECT p_partkey, p_name AS term FROM part WHERE p_type = 'ECONOMY'")
def _(spark, d):
    vocab = table(spark, d, "part").select("p_partkey", F.lower("p_type").alias("vocab"), F.col("p_name").alias("term"))
    return L.vocab_terms(vocab, "Economy").select("p_partkey", "term")


@query("tz_offset", """WITH z AS (SELECT n_name AS id, n_regionkey AS pos FROM nation UNION ALL SELECT n_name, n_regionkey + 5 FROM nation WHERE n_nationkey % 3 = 0)
SELECT c_custkey, (SELECT string_agg(CAST(pos - 2.5 AS DOUBLE), '|' ORDER BY pos) FROM z WHERE id = 'NATION_' || (c_nationkey + 2)) AS offsets FROM customer""")
def _(spark, d):
    n = table(spark, d, "nation")
    more = n.filter("n_nationkey % 3 = 0").withColumn("n_regionkey", F.col("n_regionkey") + 5)
    zones = n.unionByName(more).select(F.col("n_name").alias("id"), F.col("n_regionkey").alias("pos"), (F.col("n_regionkey") - 2.5).cast("double").alias("offset"))
    c = table(spark, d, "customer").withColumn("zone", F.concat(F.lit("NATION_"), F.col("c_nationkey") + 2))
    out = L.tz_offset(c, "zone", zones)
    return out.select("c_custkey", F.when(F.col("offsets").isNotNull(), F.array_join(F.transform("offsets", lambda x: x.cast("string")), "|")).alias("offsets"))


# --- taxonomy -----------------------------------------------------------------------------------------------------

def _backbone(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    genus = F.substring_index("p_name", " ", 1)
    return p.select(F.col("p_partkey").alias("pos"), F.lit("Partes").alias("kingdom"), F.col("p_type").alias("phylum"), F.lit(None).cast("string").alias("clazz"),
                    F.col("p_brand").alias("order"), F.lit("").alias("family"), genus.alias("genus"), F.col("p_name").alias("canonical_name"))


_FIRST = "first AS (SELECT lower(p_name) AS k, min(p_partkey) AS pos FROM part GROUP BY 1)"


@query("taxon_exact", f"WITH {_FIRST} SELECT p_partkey, pos FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || 'x' ELSE p_name END AS n FROM part) LEFT JOIN first ON lower(n) = k")
def _(spark, d):
    name = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit("x"))).otherwise(F.concat(F.lit("  "), F.upper("p_name")))
    p = table(spark, d, "part").select("p_partkey", name.alias("n"))
    return L.taxon_exact(p, "n", _backbone(spark, d)).select("p_partkey", F.col("taxon.pos").alias("pos"))


_SEARCH = """q AS (SELECT DISTINCT lower(trim(x)) AS query FROM (SELECT unnest([p_name, substr(p_name, 2 + p_size % 3, 1 + p_size % 7), substr(p_name, 3, 5) || 'zz']) AS x FROM part) WHERE trim(x) <> ''),
e AS (SELECT lower(p_name) AS k, p_partkey, p_name FROM part), names AS (SELECT DISTINCT k FROM e),
m AS (SELECT query, query = k AS exact, k FROM q JOIN names ON query = k OR (contains(k, query) AND query NOT IN (SELECT k FROM names))),
r AS (SELECT query, exact, p_partkey, p_name, row_number() OVER (PARTITION BY query ORDER BY k, p_partkey) AS rank FROM m JOIN e USING (k))"""


def _search_names(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.explode(F.array(
        F.col("p_name"), F.substr("p_name", F.col("p_size") % 3 + 2, F.col("p_size") % 7 + 1),
        F.concat(F.substring("p_name", 3, 5), F.lit("zz")))).alias("n"))


@query("taxon_search", f"WITH {_SEARCH} SELECT query, CAST(rank AS INTEGER) AS rank, exact, p_partkey AS pos, p_name AS canonical_name FROM r WHERE rank <= 5")
def _(spark, d):
    return L.taxon_search(_search_names(spark, d), "n", _backbone(spark, d), limit=5).select("query", "rank", "exact", "pos", "canonical_name")


@query("genus_search", """SELECT g AS query, g AS genus, p_brand AS "order", p_partkey AS pos FROM (SELECT *, split_part(p_name, ' ', 1) AS g,
  row_number() OVER (PARTITION BY split_part(p_name, ' ', 1) ORDER BY p_partkey) AS n FROM part) WHERE n = 1""")
def _(spark, d):
    names = table(spark, d, "part").select(F.explode(F.array(F.upper(F.substring_index("p_name", " ", 1)), F.lit("nothing"))).alias("g"))
    return L.genus_search(names, "g", _backbone(spark, d)).select("query", "genus", "order", "pos")


_HASH = "list_reduce(list_transform(string_split({0}, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda a, b: (a * 31 + b) % 4294967296, CAST(0 AS BIGINT))"
_WRAPPED = "((" + _HASH + " + 31) % 4294967296)"
_KEY = "CAST(abs(CASE WHEN {0} >= 2147483648 THEN {0} - 4294967296 ELSE {0} END) + 1000 AS BIGINT)"


def _key_sql(c: str) -> str:
    return _KEY.format(_WRAPPED.format(c))


@query("taxon_key", f"SELECT c_custkey, {_key_sql('c_name')} AS key FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", L.taxon_key(F.col("c_name")).alias("key"))


@query("taxon_by_key", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name END AS name FROM part")
def _(spark, d):
    key = L.taxon_key(F.col("p_name")) + F.when(F.col("p_size") % 2 == 0, 0).otherwise(2**40)
    p = table(spark, d, "part").select("p_partkey", key.alias("k"))
    return L.taxon_by_key(p, "k", _backbone(spark, d)).select("p_partkey", F.col("taxon.canonical_name").alias("name"))


@query("taxon_usage", f"""SELECT p_partkey, {_key_sql('p_name')} AS key, 'local:' || {_key_sql('p_name')} AS "taxonID", 'SPECIES' AS rank, p_brand AS "order", '' AS family, '' AS authorship, '1970-01-01T00:00:00Z' AS created FROM part""")
def _(spark, d):
    u = L.taxon_usage(_backbone(spark, d))
    return u.select(F.col("pos").alias("p_partkey"), "usage.key", "usage.taxonID", "usage.rank", "usage.order", "usage.family", "usage.authorship", "usage.created")


@query("taxon_query", f"""WITH {_SEARCH}, req AS (SELECT p_partkey AS request_id, CASE WHEN p_size % 2 = 0 THEN p_name END AS name, split_part(p_name, ' ', 1) AS q,
  CASE WHEN p_size % 5 = 0 THEN 'genus' ELSE '' END AS rk, CASE WHEN p_size % 9 = 0 THEN 'other' ELSE '' END AS ds FROM part),
ok AS (SELECT request_id, lower(coalesce(name, q)) AS n, rk FROM req WHERE ds = ''),
e2 AS (SELECT query, rank, p_name FROM (SELECT DISTINCT lower(n) AS query FROM ok) s JOIN LATERAL (SELECT p_name, row_number() OVER (ORDER BY k, p_partkey) AS rank FROM e
   WHERE k = s.query OR (contains(k, s.query) AND s.query NOT IN (SELECT k FROM names))) t ON TRUE)
SELECT request_id, CAST(rank AS INTEGER) AS rank_no, 'SPECIES' AS found_rank, p_name AS found_name FROM ok JOIN e2 ON n = query WHERE rk <> 'genus' AND rank <= 3
UNION ALL SELECT request_id, 1, 'GENUS', n FROM ok WHERE rk = 'genus' AND n IN (SELECT DISTINCT split_part(p_name, ' ', 1) FROM part)""")
def _(spark, d):
    p = table(spark, d, "part")
    requests = p.select(
        F.col("p_partkey").alias("request_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("name"), F.substring_index("p_name", " ", 1).alias("q"),
        F.when(F.col("p_size") % 5 == 0, "genus").otherwise("").alias("rank"), F.when(F.col("p_size") % 9 == 0, "other").otherwise("").alias("dataset_key"),
        F.lit("3").alias("max_rows"))
    return L.taxon_query(requests, _backbone(spark, d))


@query("fresh", "SELECT event_id FROM events WHERE ts + INTERVAL 12 HOURS >= TIMESTAMP '2024-01-10 00:00:00'")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("fetched_at"))
    return L.fresh(e, "12 hours", now=F.lit("2024-01-10 00:00:00").cast("timestamp")).select("event_id")


# --- geography ----------------------------------------------------------------------------------------------------

def _points(spark, d) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select("o_orderkey", (F.col("c_acctbal") / 50).alias("lat"), (F.col("o_totalprice") / 1000).alias("lon"))


_POINTS = "pts AS (SELECT o_orderkey, c_acctbal / 50 AS lat, o_totalprice / 1000 AS lon FROM orders JOIN customer ON o_custkey = c_custkey)"
_VALID = "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180"


def _ring(points) -> Column:
    return F.array(*[F.struct((F.col("x") + dx).cast("double").alias("lon"), F.lit(float(y)).alias("lat")) for dx, y in points])


def _shapes(spark, d, boxes: bool = False) -> DataFrame:
    """One L-shaped country per nation, every third with a hole; or plain boxes."""
    n = table(spark, d, "nation").withColumn("x", F.col("n_nationkey") * 7)
    box = _ring([(0, -20), (6, -20), (6, 60), (0, 60), (0, -20)])
    shell = box if boxes else _ring([(0, -20), (6, -20), (6, 60), (3, 60), (3, 20), (0, 20), (0, -20)])
    hole = _ring([(1, -10), (2, -10), (2, 0), (1, 0), (1, -10)])
    rings = F.when((F.col("n_nationkey") % 3 == 0) & F.lit(not boxes), F.array(shell, hole)).otherwise(F.array(shell))
    return n.select(F.col("n_nationkey").alias("poly_id"), F.lit(0).alias("part"), F.col("n_name").alias("iso_a2"), rings.alias("rings"))


def _in_sql(lat: str, lon: str, holes: bool = True) -> str:
    x = "n_nationkey * 7"
    inside = f"(({lon} BETWEEN {x} AND {x} + 6 AND {lat} BETWEEN -20 AND 20) OR ({lon} BETWEEN {x} + 3 AND {x} + 6 AND {lat} BETWEEN 20 AND 60))"
    hole = f"(n_nationkey % 3 = 0 AND {lon} > {x} + 1 AND {lon} < {x} + 2 AND {lat} > -10 AND {lat} < 0)"
    return f"{_VALID} AND {inside}" + (f" AND NOT {hole}" if holes else "")


@query("point_country", f"WITH {_POINTS} SELECT o_orderkey, n_name AS iso_a2 FROM pts LEFT JOIN nation ON {_in_sql('lat', 'lon')}")
def _(spark, d):
    return geo.point_country(_points(spark, d), _shapes(spark, d)).select("o_orderkey", "iso_a2")


@query("point_country_shell", f"WITH {_POINTS} SELECT o_orderkey, n_name AS iso_a2 FROM pts LEFT JOIN nation ON {_in_sql('lat', 'lon', False)}")
def _(spark, d):
    return geo.point_country(_points(spark, d), _shapes(spark, d), shell_only=True).select("o_orderkey", "iso_a2")


@query("point_country_grid", f"""WITH {_POINTS}, c AS (SELECT o_orderkey, floor(lat / 0.1) * 0.1 + 0.05 AS lat, floor(lon / 0.1) * 0.1 + 0.05 AS lon FROM pts)
SELECT o_orderkey, n_name AS iso_a2 FROM c LEFT JOIN nation ON {_in_sql('lat', 'lon')}""")
def _(spark, d):
    return geo.point_country_grid(_points(spark, d), _shapes(spark, d)).select("o_orderkey", "iso_a2")


_FAR = 50_000.0


@query("point_near", f"""WITH {_POINTS}, g AS (SELECT DISTINCT lat, lon FROM pts WHERE {_VALID})
SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, string_agg(n_name, '|' ORDER BY n_nationkey) AS codes FROM g JOIN nation ON
  sqrt(pow(greatest(n_nationkey * 7 - lon, 0, lon - n_nationkey * 7 - 6) * cos(radians(lat)) * 111195.0, 2) + pow(greatest(-20 - lat, 0, lat - 60) * 111195.0, 2)) <= {_FAR}
GROUP BY g.lat, g.lon""")
def _(spark, d):
    near = geo.point_near(_points(spark, d), _shapes(spark, d, boxes=True), _FAR)
    return near.select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.array_join("codes", "|").alias("codes"))


@query("grid_key", f"WITH {_POINTS} SELECT format('{{:.3f}}:{{:.3f}}', floor(lat / 0.1) * 0.1, floor(lon / 0.1) * 0.1) AS cell, count(*) AS count FROM pts GROUP BY 1")
def _(spark, d):
    return _points(spark, d).groupBy(grid_key(F.col("lat"), F.col("lon")).alias("cell")).agg(F.count(F.lit(1)).alias("count"))


@query("shape_boundaries", """SELECT n_nationkey AS poly_id, p AS part, n_name AS iso_a2, CAST(n_nationkey + 10 * p AS DOUBLE) AS min_lon, CAST(n_nationkey + 10 * p + 2 AS DOUBLE) AS max_lon, CAST(1.5 AS DOUBLE) AS min_lat, CAST(3 AS DOUBLE) AS max_lat, 4 AS points
FROM nation JOIN (SELECT unnest([0, 1]) AS p) ON p = 0 OR n_nationkey % 2 = 0 WHERE n_nationkey % 5 <> 4""")
def _(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")

    def polygon(offset: int, closed: bool) -> Column:
        pts = [(0, "1.5"), (2, "1.5"), (2, "3.0"), *([(0, "1.5")] if closed else [])]
        inner = [x for dx, y in pts for x in (F.lit("["), k + (offset + dx), F.lit(f",{y}],"))]
        return F.concat(F.lit("[["), F.rtrim(F.concat(*[x.cast("string") for x in inner]), F.lit(",")), F.lit("]]"))

    multi = F.concat(F.lit("["), polygon(0, True), F.lit(","), polygon(10, False), F.lit("]"))
    kind = F.when(k % 5 == 4, "Point").when(k % 2 == 0, "MultiPolygon").otherwise("Polygon")
    text = F.when(k % 5 == 4, "[1,2]").when(k % 2 == 0, multi).otherwise(polygon(0, False))
    name = F.when(k % 3 == 0, "iso_a2").when(k % 3 == 1, "ISO3166-1-Alpha-2").otherwise("ISO_A2")
    features = n.select(k.alias("poly_id"), F.create_map(name, F.col("n_name")).alias("properties"), kind.alias("type"), text.alias("coordinates"))
    out = reference.shape_boundaries(features)
    return out.select("poly_id", "part", "iso_a2", "min_lon", "max_lon", "min_lat", "max_lat", F.size(F.col("rings")[0]).alias("points"))


# --- reference files ------------------------------------------------------------------------------------------------

_MANIFEST = """man AS (SELECT 'd' || doc_id AS name, 'doc_' || doc_id AS filename, CASE WHEN doc_id % 5 = 0 THEN 'bad' WHEN doc_id % 2 = 0 THEN upper(sha256(text)) ELSE sha256(text) END AS checksum, text, doc_id FROM documents)"""


def _manifest(spark, d) -> tuple[DataFrame, DataFrame]:
    """Documents as files, every seventh missing, with a manifest whose every fifth checksum is wrong."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    digest = F.sha2("text", 256)
    checksum = F.when(k % 5 == 0, "bad").when(k % 2 == 0, F.upper(digest)).otherwise(digest)
    filename = F.concat(F.lit("doc_"), k)
    manifest = docs.select(F.concat(F.lit("d"), k).alias("name"), F.lit("").alias("source"), filename.alias("filename"), checksum.alias("checksum"))
    return manifest, docs.filter(k % 7 != 0).select(filename.alias("filename"), F.col("text").alias("content"))


@query("verify_manifest", f"""WITH {_MANIFEST} SELECT name, CASE WHEN doc_id % 7 <> 0 THEN sha256(text) END AS actual,
  CASE WHEN doc_id % 7 <> 0 THEN CAST(strlen(text) AS BIGINT) END AS size_bytes, doc_id % 7 <> 0 AND doc_id % 5 <> 0 AS valid FROM man""")
def _(spark, d):
    return reference.verify_manifest(*_manifest(spark, d)).select("name", "actual", "size_bytes", "valid")


@query("manifest_status", f"WITH {_MANIFEST} SELECT FALSE AS up, count(*) AS datasets, count(*) FILTER (doc_id % 7 = 0) AS missing FROM man")
def _(spark, d):
    return reference.all_present(reference.manifest_status(*_manifest(spark, d)))


@query("resolve_refresh", """SELECT DISTINCT name, name IN (SELECT n_name FROM nation) AS known FROM (SELECT unnest(['NATION_' || c_nationkey, c_mktsegment]) AS name FROM customer)""")
def _(spark, d):
    asked = table(spark, d, "customer").select(F.concat(F.lit(" NATION_"), "c_nationkey", F.lit(", ,"), "c_mktsegment").alias("names"))
    return reference.resolve_refresh(table(spark, d, "nation").select(F.col("n_name").alias("name")), asked)


@query("shape_iso", "SELECT 'c' || c_custkey AS alpha2, CAST(NULL AS VARCHAR) AS alpha3, CAST(c_nationkey AS VARCHAR) AS numeric, c_name AS name, CAST(NULL AS VARCHAR) AS region, c_mktsegment AS sub_region FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    return reference.shape_iso(c.select(F.concat(F.lit("c"), "c_custkey").alias("alpha-2"), F.col("c_nationkey").alias("country-code"),
                                        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sub-region")))


@query("shape_timezones", "SELECT CASE WHEN c_nationkey % 4 = 0 THEN 0 ELSE 1 END AS ids, c_name AS description, CAST(c_nationkey AS DOUBLE) AS \"offset\" FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    raw = c.select(F.when(F.col("c_nationkey") % 4 != 0, F.col("c_mktsegment")).alias("utc"), F.col("c_name").alias("value"),
                   F.col("c_mktsegment").alias("abbr"), F.col("c_nationkey").alias("offset"))
    return reference.shape_timezones(raw).select(F.size("ids").alias("ids"), "description", "offset")


@query("shape_vocab", "SELECT p_name AS term, p_brand AS definition, p_size % 2 = 0 AS deprecated, 0 AS pos FROM part UNION ALL SELECT p_type, NULL, FALSE, 1 FROM part")
def _(spark, d):
    p = table(spark, d, "part")
    one = F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("definition"), (F.col("p_size") % 2 == 0).alias("deprecated"))
    two = F.struct(F.col("p_type").alias("name"), F.lit(None).cast("string").alias("definition"), F.lit(None).cast("boolean").alias("deprecated"))
    return reference.shape_vocab(p.select(F.array(one, two).alias("results")), "basis").select("term", "definition", "deprecated", "pos")


# --- delimited text and stored runs -----------------------------------------------------------------------------------

@query("read_delimited", "SELECT CAST(p_partkey AS VARCHAR) AS \"dwc_p_partkey\", p_name AS dwc_p_name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand || ', \"x\"' END AS dwc_p_brand FROM part")
def _(spark, d):
    p, path = table(spark, d, "part"), _folder(spark, "delimited")
    brand = F.when(F.col("p_size") % 3 == 0, "NA").otherwise(F.concat("p_brand", F.lit(', "x"')))
    sinks.write_csv(p.select("p_partkey", F.col("p_name").alias(" p_name "), brand.alias("p_brand")), path)
    df, _core = delimited.read_dataset(spark, path)
    return df.toDF(*[c.replace(":", "_") for c in df.columns])


def _put_lines(df: DataFrame, header: str, line, path: str) -> None:
    """Text files whose first line is ``header``, with lines as they are (the writer would quote a text with a line break)."""
    df.select(F.explode(F.split(line, "\n")).alias(header)).write.option("header", True).option("sep", "\x01").option("quote", "").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)


def _mixed_folder(spark, d):
    """Parts in files of three kinds: quoted cells with line breaks; tabs and quotes that stand for inches; semicolons, other names, stray quotes."""
    p, path = table(spark, d, "part"), _folder(spark, "mixed")
    kind = F.col("p_partkey") % 3
    quoted = F.format_string('%d,"%s, ""%s""\n%s"', "p_partkey", "p_name", "p_brand", "p_type")
    _put_lines(p.where(kind == 0), "key,text", quoted, f"{path}/a")
    _put_lines(p.where(kind == 1), "key\ttext", F.format_string('%d\t%d" %s', "p_partkey", "p_size", "p_name"), f"{path}/b")
    _put_lines(p.where(kind == 2), "key;text;brand", F.format_string('%d;"%s" by;%s', "p_partkey", "p_name", "p_brand"), f"{path}/c")
    return [f"{path}/{x}" for x in "abc"]


@query("read_mixed_folder", """
SELECT CAST(p_partkey AS VARCHAR) AS key, CASE p_partkey % 3 WHEN 0 THEN p_name || ', "' || p_brand || '"' || chr(10) || p_type
       WHEN 1 THEN p_size || '" ' || p_name ELSE p_name || ' by' END AS text, CASE WHEN p_partkey % 3 = 2 THEN p_brand END AS brand FROM part""")
def _(spark, d):
    return delimited.read_folder(spark, _mixed_folder(spark, d)).rows


@query("read_mixed_routes", """
SELECT 'standard' AS strategy, x.sep AS sep, sum(n)::BIGINT AS records, sum(n * x.per)::BIGINT AS lines, sum(n * x.breaks)::BIGINT AS spans
FROM (SELECT p_partkey % 3 AS kind, count(*) AS n FROM part GROUP BY 1) JOIN (VALUES (0, ',', 2, 1), (1, chr(9), 1, 0), (2, ';', 1, 0)) AS x(kind, sep, per, breaks) USING (kind)
GROUP BY x.sep""")
def _(spark, d):
    found = delimited.read_folder(spark, _mixed_folder(spark, d)).routes
    return found.where("records > 0").groupBy("strategy", "sep").agg(F.sum("records").alias("records"), F.sum("lines").alias("lines"), F.sum("spans").alias("spans"))


def _unclosed(spark, d):
    """Suppliers as lines; some open a quote that no line closes, some hold more cells than the header names."""
    s, path = table(spark, d, "supplier"), _folder(spark, "unclosed")
    line = (F.when(F.col("s_suppkey") % 10 == 3, F.format_string('%d,"%s', "s_suppkey", "s_name"))
            .when(F.col("s_suppkey") % 10 == 6, F.format_string("%d,%s,%d", "s_suppkey", "s_name", "s_nationkey"))
            .otherwise(F.format_string('%d,"%s, %d"', "s_suppkey", "s_name", "s_nationkey")))
    _put_lines(s.select("s_suppkey", "s_name", "s_nationkey", line.alias("line")), "key,name", F.col("line"), path)
    return path


@query("read_unclosed_quote", """
SELECT CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_suppkey % 10 = 3 THEN '"' || s_name ELSE s_name || ', ' || s_nationkey END AS name
FROM supplier WHERE s_suppkey % 10 <> 6""")
def _(spark, d):
    return delimited.read_folder(spark, _unclosed(spark, d)).rows


@query("read_rejects", "SELECT s_suppkey || ',' || s_name || ',' || s_nationkey AS text, 1 AS lines, '3 cells under 2 names' AS reason FROM supplier WHERE s_suppkey % 10 = 6")
def _(spark, d):
    return delimited.read_folder(spark, _unclosed(spark, d)).rejects.drop("file")


@query("repair_quotes", "SELECT doc_id, '\"' || lang || '\"' || chr(9) || source || ' \"a\" b' AS value FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents")
    return delimited.repair_quotes(docs.select("doc_id", F.concat(F.lit('"'), "lang", F.lit('"'), "source", F.lit(' "a" b')).alias("value")))


@query("read_results", I.with_results(f"SELECT {I.BASE} FROM results"))
def _(spark, d):
    path = _folder(spark, "results")
    sinks.write_csv(I.flat(I.results(spark, d)), path)
    return sinks.read_results(spark, path)


@query("run_dataset", _SUMMARY)
def _(spark, d):
    report = run_dataset(I.occ(spark, d), I.OCC_RULES, _folder(spark, "run"), "r1")
    drop = [c for c in report.summary.columns if c.startswith("top_")]
    return _summary_columns(report.summary.drop(*drop))


# --- submissions --------------------------------------------------------------------------------------------------------

def _messages(spark, d) -> DataFrame:
    """Conversation turns as messages with three attachments: a picture, an undecodable table and the text."""
    c = table(spark, d, "conversations")
    safe = F.rtrim(F.translate(F.base64(F.encode("text", "UTF-8")), "+/", "-_"), F.lit("="))

    def attachment(name: str, mime: str, body: Column) -> Column:
        return F.struct(F.lit(name).alias("filename"), F.lit(mime).alias("mimeType"), F.length(body).cast("bigint").alias("size"), body.alias("contentBase64"))

    parts = F.array(attachment("a.png", "image/png", F.lit("AAAA")), attachment("broken.csv", "", F.lit("A")), attachment("t.txt", "text/plain", safe))
    none = F.array().cast(parts_type())
    headers = F.struct(F.when(F.col("turn") % 2 == 1, "x").alias("inReplyTo"), F.lit("").alias("references"))
    return c.select(F.concat("conv_id", F.lit("-"), "turn").alias("messageId"), F.col("conv_id").cast("string").alias("threadId"),
                    F.lpad(F.col("turn").cast("string"), 8, "0").alias("receivedAt"), headers.alias("headers"),
                    F.when(F.col("role") == "user", parts).otherwise(none).alias("attachments"))


def parts_type() -> str:
    return "array<struct<filename:string,mimeType:string,size:bigint,contentBase64:string>>"


@query("attachments", "SELECT conv_id || '-' || turn AS \"messageId\", CASE WHEN role = 'user' THEN 't.txt' END AS filename, CASE WHEN role = 'user' THEN text END AS content FROM conversations")
def _(spark, d):
    return submissions.extract_attachments(_messages(spark, d)).select("messageId", "filename", "content")


@query("route", "SELECT role = 'user' AS has_table, count(*) AS count FROM conversations WHERE turn % 2 = 0 GROUP BY 1")
def _(spark, d):
    yes, no = intake.route(intake.top_level(_messages(spark, d)))
    both = yes.select(F.lit(True).alias("has_table")).unionByName(no.select(F.lit(False).alias("has_table")))
    return both.groupBy("has_table").agg(F.count(F.lit(1)).alias("count"))


@query("top_level", "SELECT conv_id || '-' || turn AS \"messageId\" FROM conversations WHERE turn % 2 = 0 AND (conv_id, turn) IN (SELECT (conv_id, min(turn)) FROM conversations GROUP BY conv_id)")
def _(spark, d):
    return intake.top_level(_messages(spark, d), per_thread=True).select("messageId")


@query("submission_runs", """SELECT 'VALIDATION_COUNTRY_NOTEMPTY' AS test_id, CASE WHEN o_custkey % 4 = 0 THEN 'NOT_COMPLIANT' ELSE 'COMPLIANT' END AS result, count(*) AS runs, CAST(2 * count(*) AS BIGINT) AS count FROM orders GROUP BY 2
UNION ALL SELECT 'VALIDATION_BASISOFRECORD_STANDARD', CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'COMPLIANT' ELSE 'NOT_COMPLIANT' END, count(*), CAST(2 * count(*) AS BIGINT) FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 2""")
def _(spark, d):
    o = table(spark, d, "orders")
    country = F.when(F.col("o_custkey") % 4 == 0, "NA").otherwise(F.concat(F.lit('"a, '), F.col("o_custkey") % 9, F.lit('"')))
    wide = F.col("o_orderkey") % 2 == 0
    row = F.concat(F.col("o_orderkey").cast("string"), F.lit(","), country, F.lit(",x"), F.when(wide, F.concat(F.lit(","), "o_orderpriority")).otherwise(""))
    head = F.when(wide, "occurrenceID,country,countryCode,basisOfRecord").otherwise("occurrenceID,country,countryCode")
    messages = o.select(F.col("o_orderkey").cast("string").alias("messageId"), F.concat_ws("\n", head, row, row).alias("content"))
    path = _folder(spark, "rows")
    submissions.submission_rows(messages).withColumnRenamed("id", "run_id").write.parquet(path)
    rows = spark.read.parquet(path)  # parsed once, read once per key set
    out = evaluate.run_map_tests(rows, I.OCC_RULES.select("VALIDATION_COUNTRY_NOTEMPTY", "VALIDATION_BASISOFRECORD_STANDARD"), ["run_id"])
    return out.groupBy("test_id", "result").agg(F.count(F.lit(1)).alias("runs"), F.sum("count").alias("count"))


# --- streams --------------------------------------------------------------------------------------------------------------

def _event_stream(spark, d) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("stream_combos", "SELECT event_type, CAST(user_id % 10 AS VARCHAR) AS grp, count(*) AS count FROM events GROUP BY 1, 2")
def _(spark, d):
    stream = _event_stream(spark, d).withColumn("grp", F.col("user_id") % 10)
    out = _folder(spark, "counts")
    running.store_counts(stream, ["event_type", "grp"], out, _folder(spark, "state")).awaitTermination()
    return running.latest_counts(spark.read.parquet(out), ["event_type", "grp"])


@query("stream_dedupe", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS \"messageId\" FROM events")
def _(spark, d):
    stream = _event_stream(spark, d).select(F.col("user_id").cast("string").alias("messageId"), F.col("ts").cast("string").alias("receivedAt"))
    out = _folder(spark, "once")
    intake.dedupe_submissions(stream).select("messageId").writeStream.format("parquet").option(
        "checkpointLocation", _folder(spark, "state")).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)




# --- whole intakes, counts in a base and deltas, pages ----------------------------------------------------------------------

_REPORT_RULES = ["VALIDATION_COUNTRY_NOTEMPTY", "VALIDATION_BASISOFRECORD_STANDARD", "AMENDMENT_COUNTRYCODE_FROM_COUNTRY"]


def _submitted(spark, d) -> DataFrame:
    """Orders as submissions of a table with two rows; some are replies, some have no attachment, some are no JSON."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    country = F.when(F.col("o_custkey") % 4 == 0, "NA").otherwise(F.concat(F.lit("Land_"), F.col("o_custkey") % 9))
    row = F.concat_ws(",", k, country, F.when(k % 3 == 0, "").otherwise("Q"), "o_orderpriority")
    content = F.concat_ws("\n", F.lit("occurrenceID,country,countryCode,basisOfRecord"), row, row)
    attached = F.array(F.struct(F.lit("t.csv").alias("filename"), F.lit("text/csv").alias("mimeType"), F.lit(1).cast("bigint").alias("size"),
                                F.base64(F.encode(content, "UTF-8")).alias("contentBase64")))
    message = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("receivedAt"), k.cast("string").alias("messageId"), F.concat(F.lit("t"), k).alias("threadId"),
                       F.struct(F.when(k % 7 == 0, "<x>").alias("inReplyTo")).alias("headers"),
                       F.when(k % 11 != 0, attached).otherwise(F.array().cast(parts_type())).alias("attachments"))
    return o.select(F.when(k % 13 == 0, F.concat(F.lit("{broken "), k)).otherwise(F.to_json(message)).alias("value"))


_SUBMITTED_SQL = """sub AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'unreadable' WHEN o_orderkey % 7 = 0 THEN 'reply' WHEN o_orderkey % 11 = 0 THEN 'no attachment' ELSE 'processed' END AS reason,
  CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'Land_' || (o_custkey % 9) END AS country, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Q' END AS code, o_orderpriority AS basis FROM orders),
land AS (SELECT DISTINCT 'Land_' || (n_nationkey % 5) AS name FROM nation)"""


@query("submission_reports", f"""WITH {_SUBMITTED_SQL},
one AS (SELECT reason, CASE WHEN reason = 'processed' THEN 2 END AS records, CASE WHEN reason = 'processed' THEN
    2 * CAST(country = '' AS INT) + 2 * CAST(basis NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS INT) + 2 * CAST(country <> '' AND country NOT IN (SELECT name FROM land) AS INT) END AS bad,
  CASE WHEN reason = 'processed' THEN 2 * CAST(code = '' AND country <> '' AS INT) END AS filled,
  CASE WHEN reason = 'processed' THEN CASE WHEN code = '' AND country <> '' THEN 'X' || split_part(country, '_', 2) ELSE code END END AS code,
  CASE WHEN reason = 'processed' THEN CAST(country = '' AS INT) + CAST(basis NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS INT) + CAST(country <> '' AND country NOT IN (SELECT name FROM land) AS INT)
    + CAST(code = '' AND country <> '' AS INT) ELSE 0 END AS curated FROM sub)
SELECT reason, records::BIGINT AS records, bad::BIGINT AS bad, filled::BIGINT AS filled, code, curated::BIGINT AS curated, count(*) AS runs FROM one GROUP BY ALL""")
def _(spark, d):
    rules = [*I.OCC_RULES.select(*_REPORT_RULES), DWC["VALIDATION_COUNTRY_FOUND"]]
    n = table(spark, d, "nation")
    iso = n.select(F.concat(F.lit("Land_"), F.col("n_nationkey") % 5).alias("name"), F.concat(F.lit("N"), "n_nationkey").alias("alpha2"), F.lit("").alias("alpha3")).dropDuplicates(["name"])
    out = _folder(spark, "intake")
    intake.process_batch(out, rules, L.References(iso=iso))(submissions.parse_messages(_submitted(spark, d)), 0)

    def part(name: str) -> DataFrame:
        return intake.committed(spark, out, name)

    reason = F.when(F.col("reason").startswith("invalid"), "unreadable").otherwise(F.col("reason")).alias("reason")
    summary = part("summary").select("run_id", F.col("number_of_records_in_dataset").alias("records"), F.col("no_of_non_compliant_validations").alias("bad"),
                                     F.col("no_of_filled_in").alias("filled"))
    amended = part("amended").where("line = 0").select("run_id", F.col("values")["dwc:countryCode"].alias("code"))
    curated = part("curated").groupBy("run_id").agg(F.count("*").alias("curated"))
    joined = part("outcome").select("run_id", reason).join(summary, "run_id", "left").join(amended, "run_id", "left").join(curated, "run_id", "left")
    return joined.withColumn("curated", F.coalesce("curated", F.lit(0)).cast("bigint")).groupBy("reason", "records", "bad", "filled", "code", "curated").agg(F.count("*").alias("runs"))


WRITERS = 4  # tasks for each core that write message files


def _inbox(spark, d) -> str:
    """Suppliers as message files, each twice, in one folder; some are no JSON. Rows with one key are lines of one file."""
    s, k, path = table(spark, d, "supplier"), F.col("s_suppkey"), _folder(spark, "inbox")
    table_text = F.concat(F.lit("taxonID,country,countryCode\n"), k, F.lit(",Land_"), k % 3, F.lit(",\n"))
    attached = F.array(F.struct(F.lit("t.csv").alias("filename"), F.base64(F.encode(table_text, "UTF-8")).alias("contentBase64")))
    message = F.struct(F.lit("2024-01-01").alias("receivedAt"), F.concat(F.lit("m"), k).alias("messageId"), F.struct(F.col("s_name").alias("subject"),
                       F.when(k % 7 == 3, "<x>").alias("inReplyTo")).alias("headers"), F.when(k % 5 != 1, attached).alias("attachments"))
    text = F.when(k % 10 == 0, F.lit("{broken")).otherwise(F.to_json(message))
    files = s.select(text.alias("value"), k.alias("file")).groupBy("file").agg(F.concat_ws("\n", F.collect_list("value")).alias("value"))
    copies = files.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    # a file of its own for each row, made by all cores; a folder for each file would cost more than the files
    tasks = WRITERS * spark.sparkContext.defaultParallelism
    # the tasks move their own files into place, in parallel; a repeated one gives files of the same names
    placed = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}
    copies.repartition(tasks, "file", "copy").select("value").write.options(**placed).text(path)
    return path


@query("read_submissions", """SELECT CASE WHEN s_suppkey % 10 <> 0 THEN 'm' || s_suppkey END AS "messageId", CASE WHEN s_suppkey % 10 <> 0 THEN s_name END AS subject,
  CASE WHEN s_suppkey % 10 = 0 THEN '{broken' || chr(10) END AS corrupt, count(*) AS copies FROM supplier JOIN (SELECT unnest([0, 1])) ON TRUE GROUP BY ALL""")
def _(spark, d):
    found = submissions.read_submissions(spark, _inbox(spark, d))
    return found.groupBy("messageId", F.col("headers.subject").alias("subject"), F.col(submissions.CORRUPT).alias("corrupt")).agg(F.count("*").alias("copies"))


@query("submission_stream", """SELECT CASE WHEN s_suppkey % 10 = 0 THEN 'unreadable' WHEN s_suppkey % 7 = 3 THEN 'reply' WHEN s_suppkey % 5 = 1 THEN 'no attachment' ELSE 'processed' END AS reason,
  CAST(sum(CASE WHEN s_suppkey % 10 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS messages, CAST(sum(CASE WHEN s_suppkey % 10 <> 0 AND s_suppkey % 7 <> 3 AND s_suppkey % 5 <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS filled
FROM supplier GROUP BY 1""")
def _(spark, d):
    stream = intake.stream_submissions(spark, _inbox(spark, d), max_files=1000)
    out = _folder(spark, "stream")
    intake.start_intake(stream, out, _folder(spark, "state"), I.OCC_RULES.select(*_REPORT_RULES), once=True).awaitTermination()
    reason = F.when(F.col("reason").startswith("invalid"), "unreadable").otherwise(F.col("reason")).alias("reason")
    filled = intake.committed(spark, out, "summary").select("run_id", F.col("no_of_filled_in").alias("filled"))
    joined = intake.committed(spark, out, "outcome").select("run_id", reason).join(filled, "run_id", "left")
    return joined.groupBy("reason").agg(F.count("*").alias("messages"), F.coalesce(F.sum("filled"), F.lit(0)).alias("filled"))


def _event_files(spark, d, path: str, files: int, cond: str = "true") -> None:
    """Events as ``files`` files, so that a stream takes as many batches."""
    e = table(spark, d, "events").where(cond)
    e.select("event_type", (F.col("user_id") % 10).cast("string").alias("grp"), F.col("ts").cast("timestamp").alias("at")).repartition(files).write.mode("append").parquet(path)


def _files_stream(spark, path: str) -> DataFrame:
    return spark.readStream.schema("event_type string, grp string, at timestamp").option("maxFilesPerTrigger", 1).parquet(path)


@query("merged_counts", "SELECT event_type, CAST(user_id % 10 AS VARCHAR) AS grp, count(*) AS count FROM events GROUP BY 1, 2")
def _(spark, d):
    files, out, cols = _folder(spark, "events"), _folder(spark, "counts"), ["event_type", "grp"]
    _event_files(spark, d, files, 7)
    running.start_counts(_files_stream(spark, files), cols, out, _folder(spark, "state"), merge_every=3).awaitTermination()
    return running.current_counts(spark, out, cols, running.last_batch(spark, out))


_NOON = "2024-01-15 12:00:00"


@query("late_events", f"""WITH e AS (SELECT event_type, CAST(ts AS TIMESTAMP) AS t FROM events), m AS (SELECT max(t) AS newest FROM e WHERE t >= TIMESTAMP '{_NOON}')
SELECT event_type, count(*) FILTER (late) AS late, count(*) FILTER (NOT late) AS count FROM (SELECT event_type, coalesce(t < TIMESTAMP '{_NOON}' AND t < newest - INTERVAL 10 DAYS, FALSE) AS late FROM e, m)
GROUP BY 1""")
def _(spark, d):
    files, out, state, cols = _folder(spark, "events"), _folder(spark, "counts"), _folder(spark, "state"), ["event_type"]
    for cond in (f"ts >= timestamp '{_NOON}'", f"ts < timestamp '{_NOON}'"):  # the earlier ones come last
        _event_files(spark, d, files, 1, cond)
        running.start_counts(_files_stream(spark, files), cols, out, state, at="at", delay="10 days").awaitTermination()
    counts = running.current_counts(spark, out, cols, running.last_batch(spark, out))
    late = spark.read.schema("event_type string").parquet(f"{out}/late").groupBy("event_type").agg(F.count("*").alias("late"))
    return counts.join(late, "event_type", "full").select("event_type", F.coalesce("late", F.lit(0)).alias("late"), F.coalesce("count", F.lit(0)).alias("count"))


@query("page_after", """WITH k AS (SELECT o_totalprice AS p, o_orderkey AS o FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders))
SELECT o_orderkey, o_totalprice FROM orders, k WHERE o_totalprice > p OR (o_totalprice = p AND o_orderkey > o) ORDER BY o_totalprice, o_orderkey LIMIT 20""")
def _(spark, d):
    order = ["o_totalprice", "o_orderkey"]
    stored = summary.store_pages(table(spark, d, "orders").select(*order), _folder(spark, "pages"), order)
    key = stored.orderBy("o_orderkey").first()
    return summary.page_after(stored, order, 20, [key[c] for c in order]).select("o_orderkey", "o_totalprice")


@query("head_n", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def _(spark, d):
    return summary.head_n(table(spark, d, "customer"), 25, [F.desc("c_acctbal"), "c_custkey"]).select("c_custkey", "c_acctbal")


@query("unique_columns", 'SELECT p_partkey AS a, p_name AS "a_2", p_brand AS b, p_type AS "a_3" FROM part')
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type").toDF("a", "a", "b", "a")
    return delimited.unique_columns(p).toDF(*[c.replace(" (", "_").replace(")", "") for c in delimited.unique_names(p.columns)])


@query("detect_core", "SELECT 'taxon' AS core, p_name AS dwc_scientificName, CAST(p_partkey AS VARCHAR) AS \"dwc_taxonID\" FROM part")
def _(spark, d):
    path = _folder(spark, "taxa")
    sinks.write_csv(table(spark, d, "part").select(F.col("p_name").alias("scientificName"), F.col("p_partkey").alias("taxonID")), path)
    df, core = delimited.read_dataset(spark, path)
    return df.toDF(*[c.replace(":", "_") for c in df.columns]).withColumn("core", F.lit(core))


@query("batch_figures", I.with_results("SELECT count(*) AS rows, count(*) FILTER (status = 'INTERNAL_PREREQUISITES_NOT_MET') AS unmet, "
                                       "count(*) FILTER (status IN ('AMENDED', 'FILLED_IN')) AS actionable FROM results"))
def _(spark, d):
    watched, seen = evaluate.observe_run(I.results(spark, d))
    watched.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([seen.get], "rows bigint, unmet bigint, actionable bigint")
