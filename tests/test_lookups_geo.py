from __future__ import annotations

import math
import random

import pytest


from pyspark.sql import functions as F

from conftest import BACKBONE, BOUNDARIES
from plumbline.operators import geo
from plumbline.functions import sizing
from plumbline.operators import lookups as L
from plumbline.operators import skew


def inside(x, y, rings):
    """Brute force: even-odd rule over all rings, edges included."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            cross = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
            if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def distance(x, y, rings):
    kx, ky = math.cos(math.radians(y)) * geo.METRES_PER_DEGREE, geo.METRES_PER_DEGREE
    best = math.inf
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            ax, ay, dx, dy = (x1 - x) * kx, (y1 - y) * ky, (x2 - x1) * kx, (y2 - y1) * ky
            n = dx * dx + dy * dy
            t = 0 if n == 0 else max(0, min(1, -(ax * dx + ay * dy) / n))
            best = min(best, math.hypot(ax + t * dx, ay + t * dy))
    return best


def sample():
    rng = random.Random(5)
    pts = [(rng.uniform(-1, 7), rng.uniform(19, 46)) for _ in range(400)] + [(float(a), float(b)) for a in range(-1, 8) for b in range(19, 47)]
    return pts + [(-10.0, -140.0), (40.7128, -74.0060), (51.05, -114.07), (95.0, 10.0)]


def test_points_against_brute_force(spark, refs):
    pts = sample()
    df = spark.createDataFrame(pts, "lat double, lon double")
    got = {(r["lat"], r["lon"]): r["iso_a2"] for r in geo.point_country(df, refs.boundaries).collect()}
    for lat, lon in pts:
        hits = [] if abs(lat) > 90 else [b[2] for b in BOUNDARIES if inside(lon, lat, b[4])]
        assert got[(lat, lon)] == (hits[0] if hits else None), (lat, lon)
    assert got[(40.7128, -74.0060)] == "US" and got[(51.05, -114.07)] == "CA" and got[(-10.0, -140.0)] is None


def test_hole_shell_and_cell_size(spark, refs):
    df = spark.createDataFrame([(3.0, 33.0)], "lat double, lon double")
    assert geo.point_country(df, refs.boundaries).first()["iso_a2"] is None
    assert geo.point_country(df, refs.boundaries, shell_only=True).first()["iso_a2"] == "H1"
    pts = spark.createDataFrame(sample(), "lat double, lon double")
    a = geo.point_country(pts, refs.boundaries, cell=0.37)
    b = geo.point_country(pts, refs.boundaries)
    assert a.exceptAll(b).count() == 0


def test_buffer_against_brute_force(spark, refs):
    pts = [p for p in sample() if abs(p[0]) <= 90]
    got = {(r["lat"], r["lon"]): r["codes"] for r in geo.point_near(spark.createDataFrame(pts, "lat double, lon double"), refs.boundaries, 60_000).collect()}
    for lat, lon in pts:
        want = [b[2] for b in BOUNDARIES if inside(lon, lat, b[4]) or distance(lon, lat, b[4]) <= 60_000]
        assert got.get((lat, lon), []) == list(dict.fromkeys(want)), (lat, lon)


def test_grid_gives_one_answer_per_cell(spark, refs):
    df = spark.createDataFrame([(0.02, 26.01), (0.09, 25.99), (0.02, 26.09)], "lat double, lon double")
    assert [r["iso_a2"] for r in geo.point_country_grid(df, refs.boundaries).orderBy("lon").collect()] == ["L1", None, None]


def test_country_lookups(spark, refs):
    df = spark.createDataFrame([("us", "fra", " namibia ")], "a string, b string, c string")
    out = L.country_by_name(L.country_by_alpha3(L.country_by_alpha2(df, "a", refs.iso, "x"), "b", refs.iso, "y"), "c", refs.iso, "z").first()
    assert (out["x"]["name"], out["y"]["alpha2"], out["z"]["alpha2"]) == ("United States", "FR", "NA")
    assert L.country_by_alpha2(spark.createDataFrame([("FR",)], "a string"), "a", refs.iso).first()["country_row"]["name"] == "France"


def test_taxon_lookups(spark, refs):
    names = spark.createDataFrame([(n,) for n in ("ursus  arctos", "URSUS", "us", "o", "zzz", "homo sapiens x", "", None)], "n string")
    got = {}
    for r in L.taxon_search(names, "n", refs.backbone, limit=2).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["canonical_name"])
    known = sorted(b[7] for b in BACKBONE)
    want = {}
    for q in ("ursus arctos", "ursus", "us", "o", "zzz", "homo sapiens x"):
        hits = [k for k in known if k.lower() == q] or [k for k in known if q in k.lower()]
        if hits:
            want[q] = hits[:2]
    assert got == want
    exact = L.taxon_exact(names, "n", refs.backbone).filter("taxon is not null").collect()
    assert exact == []  # inner double space is not collapsed by the exact lookup
    assert L.genus_search(names, "n", refs.backbone).select("query", "family").first()[:] == ("ursus", "Ursidae")


def test_taxon_keys(spark, refs):
    def key(s):
        h = 0
        for ch in s:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        h = (h + 31) & 0xFFFFFFFF
        return abs(h - 2**32 if h >= 2**31 else h) + 1000
    usage = {r["canonical_name"]: r["usage"] for r in L.taxon_usage(refs.backbone).collect()}
    assert usage["Ursus arctos"]["key"] == key("Ursus arctos") and usage["Rubus idaeus"]["class"] is None and usage["Rubus idaeus"]["family"] == "Rosaceae"
    asked = spark.createDataFrame([(key("Homo sapiens"),), (7,)], "k bigint")
    assert {r["k"]: r["taxon"] and r["taxon"]["genus"] for r in L.taxon_by_key(asked, "k", refs.backbone).collect()} == {key("Homo sapiens"): "Homo", 7: None}
    genus = L.taxon_usage(refs.backbone.filter("pos = 3"), genus=True).first()["usage"]
    assert genus["taxonID"] == "local-genus:Ursus" and genus["rank"] == "GENUS" and genus["key"] == key("genus:Ursus")


def test_taxon_requests(spark, refs):
    req = spark.createDataFrame([(1, "ursus", None, "", "", None), (2, None, "Ursus", "genus", "", None), (3, "ursus", None, "", "elsewhere", None), (4, "ursus", None, "", "", "1")],
                                "request_id int, name string, q string, rank string, dataset_key string, max_rows string")
    got = sorted((r["request_id"], r["rank_no"], r["found_name"]) for r in L.taxon_query(req, refs.backbone).collect())
    assert got == [(1, 1, "Ursus americanus"), (1, 2, "Ursus arctos"), (2, 1, "Ursus"), (4, 1, "Ursus americanus")]


@pytest.mark.parametrize("hot_rows", [3, 10**6])
def test_large_tables_with_hot_keys(spark, refs, monkeypatch, hot_rows):
    """Without a broadcast, and with and without hot keys, every row keeps its answer."""
    name = F.when(F.col("id") % 3 > 0, "Ursus arctos").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("n"), "id"))
    df = spark.range(60).select("id", name.alias("n"), F.when(F.col("id") % 3 > 0, 48.0).otherwise(F.col("id").cast("double")).alias("lat"), F.lit(2.0).alias("lon"))
    expected = [sorted(map(str, L.taxon_exact(df, "n", refs.backbone).collect())), sorted(map(str, geo.point_country(df, refs.boundaries).collect()))]
    monkeypatch.setattr(sizing, "BROADCAST_LIMIT", -1)
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    again = [sorted(map(str, L.taxon_exact(df, "n", refs.backbone).collect())), sorted(map(str, geo.point_country(df, refs.boundaries).collect()))]
    assert again == expected and len(expected[0]) == 60 and sum("FR" in r for r in expected[1]) >= 40


def test_null_keys_are_spread(spark):
    from plumbline.operators.skew import hot_keys, left_join_hot
    df = spark.createDataFrame([(None if i % 2 else f"k{i % 7}", i) for i in range(2000)], "k string, i int")
    side = spark.createDataFrame([(f"k{i}", i) for i in range(5)], "k string, v int")
    joined = left_join_hot(df, side, ["k"], hot_keys(df, ["k"]))
    assert sorted((r["k"] or "", r["i"], r["v"] if r["v"] is not None else -1) for r in joined.collect()) == sorted(
        (r["k"] or "", r["i"], r["v"] if r["v"] is not None else -1) for r in df.join(side, "k", "left").collect())
    plan = joined.where("k IS NULL").select("i")
    assert plan.count() == 1000


def test_name_index_is_stored_and_bounded(spark, refs, tmp_path):
    from plumbline.operators import names
    words = [f"{a}{b} {c}" for a in ("ab", "ba", "abc") for b in ("x", "yy") for c in ("", "ab", "zab", "é")]
    backbone = spark.createDataFrame([(i, w.strip().upper() if i % 2 else w.strip()) for i, w in enumerate(words)] + [(99, None), (98, " ")], "pos int, canonical_name string")
    index = L.backbone_index(backbone, str(tmp_path / "index"))
    again = names.load_index(spark, str(tmp_path / "index"))
    asked = ["ab", "a", "bx", "x zab", "yy", "abx", "cyy ab", "nothing", "é", "", None, "abx zab", "AB"]
    queries = spark.createDataFrame([(q,) for q in asked], "n string")
    known = sorted((" ".join(w.lower().split()), i) for i, w in enumerate(words))
    for limit in (1, 3, 100):
        got = {}
        for r in L.taxon_search(queries, "n", again, limit).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r["pos"])
        want = {}
        for q in {q.lower() for q in asked if q}:
            hits = [i for k, i in known if k == q] or [i for k, i in known if q in k]
            if hits:
                want[q] = hits[:limit]
        assert got == want
    plan = L.taxon_search(queries, "n", index, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("FileScan") + plan.count("Scan ExistingRDD") <= 8


def test_each_point_has_its_own_radius(spark, refs):
    rnd = random.Random(9)
    points = [(rnd.uniform(-60, 75), rnd.uniform(-180, 180), rnd.choice([0.0, 0.0, 3000.0, 250_000.0, 2_000_000.0])) for _ in range(150)] + [(49.0, -100.0, 0.0), (None, 1.0, 0.0), (1.0, 1.0, None)]
    df = spark.createDataFrame(points, "lat double, lon double, r double")
    got = {(p["lat"], p["lon"], p["r"]): p["codes"] for p in geo.point_countries(df, refs.boundaries, radius="r").collect()}
    want = {}
    for r in {p[2] for p in points if p[2] is not None}:
        some = df.where(F.col("r") == r)
        alike = geo.point_near(some, refs.boundaries, r) if r else geo.point_countries(some, refs.boundaries)
        want |= {(p["lat"], p["lon"], r): p["codes"] for p in alike.collect()}
    assert got == want and any(r > 0 for _, _, r in got)


def test_a_name_of_many_entries_is_on_a_list_once(spark, tmp_path):
    rows = [(i, ("Ringed bolt", "Ring", "Blue ring", "Bolt")[i % 4]) for i in range(4000)]
    index = L.backbone_index(spark.createDataFrame(rows, "pos int, canonical_name string").repartition(5), str(tmp_path / "index"))
    assert index.postings.where("gram = 'rin'").count() == 3 and index.keys.count() == 4 and index.names.count() == 4000
    asked = spark.createDataFrame([("ring",), ("rin",), ("ing",), ("t",), ("ed bo",)], "n string")
    got = {}
    for r in L.taxon_search(asked, "n", index, 1002).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["rank"], r["pos"]))
    known = sorted((n.lower(), i) for i, n in rows)
    for q in ("ring", "rin", "ing", "t", "ed bo"):
        hits = [i for k, i in known if k == q] or [i for k, i in known if q in k]
        assert got[q] == list(enumerate(hits[:1002], 1))
