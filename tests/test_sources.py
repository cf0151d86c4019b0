from __future__ import annotations

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import lookups as L
from plumbline.sources import delimited as D
from plumbline.sources import reference as R
from plumbline.sources import sinks, submissions


def write(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_clean_file_and_core(spark, tmp_path):
    df, core = D.read_dataset(spark, write(tmp_path, '"occurrenceID" ,dwc:country,countryCode\n1,"a, ""b""",NA\n2,short\n\n3,x,null\n'))
    assert core == "occurrence" and df.columns == ["dwc:occurrenceID", "dwc:country", "dwc:countryCode"]
    assert rows(df) == [("1", 'a, "b"', None), ("2", "short", None), ("3", "x", None)]
    kept = D.read_delimited(spark, str(tmp_path / "t.csv"), keep_na_literals=True)
    assert rows(kept)[0][2] == "NA"


def test_quoted_line_break(spark, tmp_path):
    assert rows(D.read_delimited(spark, write(tmp_path, 'a,b\n1,"x\ny"\n2,z\n'))) == [("1", "x\ny"), ("2", "z")]


@pytest.mark.parametrize("sep", [";", "\t", "|"])
def test_sniffing(spark, tmp_path, sep):
    assert rows(D.read_delimited(spark, write(tmp_path, f"a{sep}b\n1{sep}2,5\n"))) == [("1", "2,5")]


def test_fallbacks(spark, tmp_path):
    # A stray quote inside a field is fine; a row with too many fields is not and is skipped by the last strategy only.
    bad = write(tmp_path, "a\tb\n1\t2\n3\t4\t5\n6\n")
    assert rows(D.read_delimited(spark, bad)) == [("1", "2"), ("6", None)]
    with pytest.raises(D.UnreadableTable):
        D.read_delimited(spark, bad, strategies=["standard", "quote_none"])
    none = write(tmp_path, "a,b\n\"x,y\n\"z,w\n", "q.csv")
    assert rows(D.read_delimited(spark, none, strategies=["quote_none"])) == [('"x', "y"), ('"z', "w")]
    mend = write(tmp_path, 'a\tb\tc\n"G.M."1951\tx\n', "r.tsv")
    assert rows(D.read_delimited(spark, mend, strategies=["repaired"])) == [('"G.M."', "1951", "x")]
    with pytest.raises(D.UnreadableTable):
        D.read_delimited(spark, write(tmp_path, "", "e.csv"))


def test_names():
    assert D.unique_names(["a", "b", "a", None, "a", None]) == ["a", "b", "a (2)", "NaN (1)", "a (3)", "NaN (2)"]
    assert D.detect_core(["DWC:TaxonID", "dwc:OccurrenceId"]) == "occurrence"
    assert D.detect_core(["dwc:taxonID"]) == "taxon" and D.detect_core(["x"]) is None


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("T", 'a="x"|b=,', "", "3"), ("T", "multi\nline", "y", "oops"), ("U", "", "z", "2.0")], "test_id string, result string, comment string, count string")
    sinks.write_csv(df, str(tmp_path / "o"), single_file=True)
    got = {(r["test_id"], r["result"], r["comment"], r["count"]) for r in sinks.read_results(spark, str(tmp_path / "o")).collect()}
    assert got == {("T", 'a="x"|b=,', "", 3), ("T", "multi\nline", "y", 0), ("U", "", "z", 2)}


# --- submissions --------------------------------------------------------------------------------------------------

def encode(text, safe=False):
    raw = text if isinstance(text, bytes) else text.encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=") if safe else base64.b64encode(raw).decode()


def attachment(name, mime, body):
    return {"filename": name, "mimeType": mime, "size": len(body), "contentBase64": body}


def message(i, attachments, thread="t", reply=None, at="2024-01-01T00:00:00Z"):
    return {"receivedAt": at, "messageId": f"m{i}", "threadId": thread, "headers": {"subject": "s", "from": "a@example.org", "inReplyTo": reply},
            "body": {"text": "x"}, "attachments": attachments}


def test_attachments(spark, tmp_path):
    odd = "id,n\n1,ÿ>?\n"
    cases = [
        message(0, [attachment("a.png", "image/png", "AAAA"), attachment("x.CSV", "", encode("a,b\n")), attachment("y.csv", "", encode("later"))]),
        message(1, [attachment("bad.csv", "", "A"), attachment("ok", "TEXT/CSV", encode(odd, safe=True))]),
        message(2, []),
        message(3, [attachment("bad.tsv", "", "AAAAA")]),
        message(4, [attachment("b.tsv", "", encode(b"a\xffb"))]),
    ]
    for i, m in enumerate(cases):
        (tmp_path / f"{i}.json").write_text(json.dumps(m, indent=1))
    (tmp_path / "9.json").write_text("{no json")
    good, dead = submissions.split_corrupt(submissions.read_submissions(spark, str(tmp_path)))
    got = {r["messageId"]: (r["filename"], r["content"]) for r in submissions.extract_attachments(good).collect()}
    assert got == {"m0": ("x.CSV", "a,b\n"), "m1": ("ok", odd), "m2": (None, None), "m3": (None, None), "m4": ("b.tsv", "a�b")}
    assert dead.count() == 1


def test_base64_is_cleaned_and_decoded_once(spark):
    bodies = ["QUJD", "QUJDRA==", "QUJDRA", "Q U\tJ\r\nD", "Q=U=JD", "=", "", "A", "AAAAA", "QU*JD", "é", "QUJDé", "QU.JD.RA==", "-_-_", "QUJD\n", "\x0bQUJD", None]

    def want(body):
        if body is None:
            return None
        kept = "".join(c for c in body.replace("-", "+").replace("_", "/") if c.isascii() and (c.isalnum() or c in "+/"))
        return None if len(kept) % 4 == 1 else base64.b64decode(kept + "=" * (-len(kept) % 4)).decode("utf-8", "replace")

    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string").coalesce(1)
    got = {r["i"]: r["text"] for r in df.select("i", submissions.decode_base64(F.col("body")).alias("text")).collect()}
    assert got == {i: want(b) for i, b in enumerate(bodies)}
    plan = df.select(submissions.decode_base64(F.col("body")).alias("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("translate(") == 1


def test_headers_are_read_as_before(spark):
    long = ",".join(f"c{i}" for i in range(2000))
    df = spark.createDataFrame([("a", 'x,"y\nz",x,dwc:x\n1,2,3,4\n5\n'), ("b", long + "\n" + ",".join("1" * 2000)), ("c", "x;y\n1;2"), ("d", "x;y\n3;4;5\n6"), ("e", "\n")],
                               "messageId string, content string").coalesce(1)
    got = {(r["id"], r["line"]): r["values"] for r in submissions.submission_rows(df, problems=True).collect()}
    assert got == {("a", 0): {"dwc:x": "4", "dwc:y\nz": "2", "dwc:x (2)": "3"}, ("a", 1): {"dwc:x": "", "dwc:y\nz": "", "dwc:x (2)": ""},
                   ("b", 0): {f"dwc:c{i}": "1" for i in range(2000)}, ("c", 0): {"dwc:x": "1", "dwc:y": "2"}, ("d", 0): None, ("d", 1): {"dwc:x": "6", "dwc:y": ""}}


def test_tables_inside_messages(spark):
    df = spark.createDataFrame([("m1", 'occurrenceID;dwc:x\n1;"a;b"\n2;NA\n\n3\n'), ("m2", "taxonID\tx\n7\tlong\ttoo\n8\tfits\n"), ("m3", None), ("m4", "")], "messageId string, content string")
    got = {(r["id"], r["line"]): r["values"] for r in submissions.submission_rows(df).collect()}
    assert got == {("m1", 0): {"dwc:occurrenceID": "1", "dwc:x": "a;b"}, ("m1", 1): {"dwc:occurrenceID": "2", "dwc:x": ""},
                   ("m1", 2): {"dwc:occurrenceID": "3", "dwc:x": ""}, ("m2", 1): {"dwc:taxonID": "8", "dwc:x": "fits"}}
    problems = submissions.submission_rows(df, problems=True).where("problem IS NOT NULL").collect()
    assert [(r["id"], r["line"], "too" in r["problem"], r["values"]) for r in problems] == [("m2", 0, True, None)]


# --- reference files ------------------------------------------------------------------------------------------------

def test_reference_files(spark, tmp_path):
    iso = write(tmp_path, json.dumps({"countries": [{"alpha2": "US", "alpha3": "USA", "numeric": "840", "name": "United States", "region": "A", "subRegion": "N"}]}), "iso.json")
    assert R.load_iso(spark, iso).first()["sub_region"] == "N"
    vocab = write(tmp_path, json.dumps({"vocabularies": {"Basis": [{"name": "x", "definition": "d"}, {"name": "y", "description": "e"}], "Empty": []}}), "v.json")
    assert {tuple(r) for r in R.load_vocab(spark, vocab).collect()} == {("basis", 0, "x", "d"), ("basis", 1, "y", "e")}
    assert [r["term"] for r in L.vocab_terms(R.load_vocab(spark, vocab), "BASIS").orderBy("pos").collect()] == ["x", "y"]
    zones = write(tmp_path, json.dumps({"zones": [{"ids": ["Z/a", "Z/b"], "abbr": "A", "offset": -2.5}, {"ids": ["Z/a"], "offset": 1}, {"ids": [], "offset": 3}]}), "z.json")
    z = R.load_timezones(spark, zones)
    asked = spark.createDataFrame([("Z/a",), ("Z/b",), ("Z/c",)], "zone string")
    assert {r["zone"]: r["offsets"] for r in L.tz_offset(asked, "zone", z).collect()} == {"Z/a": [-2.5, 1.0], "Z/b": [-2.5], "Z/c": None}
    assert {r["zone"]: r["offset"] for r in L.tz_offset(asked, "zone", z, first_only=True).collect()} == {"Z/a": -2.5, "Z/b": -2.5, "Z/c": None}
    bone = write(tmp_path, json.dumps({"ranks": [{"kingdom": "K", "genus": "Rubus", "canonicalName": "Rubus idaeus", "order": "O"}]}), "b.json")
    assert R.load_backbone(spark, bone).first()["canonical_name"] == "Rubus idaeus"


def test_boundaries(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 2], [0, 2]]
    features = [
        {"properties": {"iso_a2": "AA", "ISO_A2": "no", "name": "A", "rank": 1}, "geometry": {"type": "Polygon", "coordinates": [ring, [[0.5, 0.5], [1, 0.5], [1, 1], [0.5, 0.5]]]}},
        {"properties": {"ISO3166-1-Alpha-2": "BB"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [[[5, 5], [6, 5], [6, 6, 9], [7]]]]}},
        {"properties": {"ISO_A2": "CC"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"properties": {"ISO_A2": "DD"}, "geometry": None},
        {"properties": {"ISO_A2": "EE"}, "geometry": {"type": "Polygon", "coordinates": []}},
    ]
    path = write(tmp_path, json.dumps({"type": "FeatureCollection", "features": features}), "g.json")
    got = {(r["poly_id"], r["part"]): r for r in R.load_boundaries(spark, path).collect()}
    assert {k: r["iso_a2"] for k, r in got.items()} == {(0, 0): "AA", (1, 0): "BB", (1, 1): "BB"}
    assert len(got[(0, 0)]["rings"]) == 2 and len(got[(0, 0)]["rings"][0]) == 5
    assert len(got[(1, 1)]["rings"][0]) == 4 and got[(1, 1)]["max_lat"] == 6.0


def test_integrity(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b"one")
    (tmp_path / "b.json").write_bytes(b"two")
    digest = hashlib.sha256(b"one").hexdigest().upper()
    manifest = spark.createDataFrame([("a", "src", "a.json", digest), ("b", "src", "b.json", digest), ("c", "src", "c.json", digest)],
                                     "name string, source string, filename string, checksum string")
    files = R.read_files(spark, str(tmp_path))
    got = {r["name"]: (r["valid"], r["size_bytes"]) for r in R.verify_manifest(manifest, files).collect()}
    assert got == {"a": (True, 3), "b": (False, 3), "c": (False, None)}
    assert R.all_present(R.manifest_status(manifest, files)).first()[:] == (False, 3, 1)
    assert {tuple(r) for r in R.resolve_refresh(manifest, ["a, zz", " a ,,"]).collect()} == {("a", True), ("zz", False)}


def test_freshness(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00")], "k int, t string").select("k", F.col("t").cast("timestamp").alias("fetched_at"))
    assert [r["k"] for r in L.fresh(df, "12 hours", now=F.lit("2024-01-02 06:00:00").cast("timestamp")).collect()] == [2]


def test_unclosed_quote_and_ragged_rows_lose_nothing(spark, tmp_path):
    path = write(tmp_path, 'id,name\n1,a\n2,"Smith b\n3,c\n4,d\n5,e\n', "r.csv")
    assert sorted(r["id"] for r in D.read_delimited(spark, path).collect()) == ["1", "2", "3", "4", "5"]
    path = write(tmp_path, "occurrenceID,country\n1,a\n2,b,c\n", "s.csv")
    with pytest.raises(D.UnreadableTable):
        D.read_delimited(spark, path, strategies=["standard", "quote_none", "tab_quote_none"])
