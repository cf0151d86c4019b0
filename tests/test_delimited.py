"""Reading folders of untidy files, cut into many parts, against reading every file whole."""

from __future__ import annotations

import csv
import io
import random

import pyarrow as pa
import pytest

from plumbline.sources import delimited as D
from plumbline.sources import quoting


@pytest.fixture
def parts_of(spark):
    """Sets the size of a part."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield size
    for k, v in keep.items():
        spark.conf.set(k, v)


def put(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    return str(tmp_path)


def plain(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


def by_name(df, tmp_path):
    return {r["file"].rsplit("/", 1)[1]: r for r in df.collect()}


def test_scan_equals_csv():
    rnd = random.Random(5)
    for _ in range(3000):
        line = "".join(rnd.choice('ab"",') for _ in range(rnd.randrange(12)))
        seps, inside = quoting.scan(line, False, ",")
        (row,) = list(csv.reader(io.StringIO(line + "\n"))) or [[]]
        if not inside:
            assert seps == max(0, len(row) - 1), line
        else:  # the line break belongs to the last cell
            assert row and row[-1].endswith("\n"), line


def test_fold_equals_the_whole():
    rnd = random.Random(6)
    for _ in range(500):
        lines = ["".join(rnd.choice('ab"",,\t') for _ in range(rnd.randrange(8))) for _ in range(rnd.randrange(1, 12))]
        whole = quoting.Part(",")
        whole.add(pa.array(lines), True)
        cuts = sorted(rnd.sample(range(1, len(lines)), min(len(lines) - 1, rnd.randrange(4)))) if len(lines) > 1 else []
        chain = []
        for a, b in zip([0, *cuts], [*cuts, len(lines)], strict=True):
            part = quoting.Part(",")
            part.add(pa.array(lines[a:b]), a == 0)
            chain.append((a, part))
        most, records, spans, inside, _ = quoting.fold(chain)
        assert (most, records, spans, inside) == (whole.outside.most, whole.outside.records, whole.outside.spans, whole.outside.inside)


@pytest.mark.parametrize("size", [1 << 20, 97, 23])
def test_quoted_breaks_across_parts(spark, tmp_path, parts_of, size):
    rnd = random.Random(size)
    want = {}
    for name in ("a.csv", "b.csv"):
        rows = [[str(i), "".join(rnd.choice(['x', 'y', '"', ',', '\n', ' ', 'long word ']) for _ in range(rnd.randrange(1, 20))).strip("\n ") or "z"] for i in range(40)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([["id", "text"], *rows])
        put(tmp_path, **{name: out.getvalue()})
        want[name] = rows
    parts_of(size)
    found = D.read_folder(spark, str(tmp_path), with_file=True)
    got = [(r["_file"].rsplit("/", 1)[1], r["id"], r["text"]) for r in found.rows.collect()]
    assert sorted(got) == sorted((n, *r) for n, rows in want.items() for r in rows)
    assert found.rejects.count() == 0
    routes = by_name(found.routes, tmp_path)
    assert all(r["strategy"] == "standard" and r["records"] == 40 and r["spans"] > 0 for r in routes.values())


def test_each_file_by_its_own_strategy(spark, tmp_path, parts_of):
    path = put(tmp_path, **{
        "quoted.csv": 'occurrenceID,name,country\n1,"Smith, J",US\n2,"x\r\ny",\n', "stray.csv": 'occurrenceID,name,country\n3,5" pipe,FR\n4,"a"b,NA\n',
        "wide.tsv": "id\tname\n5\tz\n6\ty\tmore\n\n", "open.csv": 'occurrenceID,name,country\n7,"open,never\n8,"q, r",IT\n9,a,b,c\n',
        "glued.tsv": 'a\tb\tc\n"G.M."1951\tx\n', "one.csv": "name\nx, y\n", "header.csv": "name,id\n", "blank.csv": "\n \n",
        "again.csv": "name,id\nname,id\nz,10\n", "pipes.txt": "id|name\n11|a,b\n"})
    for size in (1 << 20, 16):
        parts_of(size)
        found = D.read_folder(spark, path, with_file=True)
        rows = {(r["_file"].rsplit("/", 1)[1], r["occurrenceID"] or r["id"], r["name"], r["country"]) for r in found.rows.drop("a", "b", "c").collect()}
        assert rows == {
            ("quoted.csv", "1", "Smith, J", "US"), ("quoted.csv", "2", "x\ny", None), ("stray.csv", "3", '5" pipe', "FR"), ("stray.csv", "4", "ab", None),
            ("wide.tsv", "5", "z", None), ("open.csv", "7", '"open', "never"), ("open.csv", "8", "q, r", "IT"), ("glued.tsv", None, None, None),
            ("one.csv", None, "x, y", None), ("again.csv", "id", "name", None), ("again.csv", "10", "z", None), ("pipes.txt", "11", "a,b", None)}
        assert {(r["file"].rsplit("/", 1)[1], r["text"], r["reason"]) for r in found.rejects.collect()} == {
            ("wide.tsv", "6\ty\tmore", "3 cells under 2 names"), ("open.csv", "9,a,b,c", "4 cells under 3 names")}
        routes = by_name(found.routes, tmp_path)
        assert {n: r["strategy"] for n, r in routes.items() if r["strategy"]} == {
            "quoted.csv": "standard", "stray.csv": "standard", "wide.tsv": "skip_bad", "open.csv": "skip_bad", "glued.tsv": "standard", "one.csv": "tab_quote_none",
            "again.csv": "standard", "pipes.txt": "standard", "header.csv": "standard"}
        taken = {}
        for r in [*found.rows.collect(), *[{"_file": r["file"]} for r in found.rejects.collect()]]:
            taken[r["_file"]] = taken.get(r["_file"], 0) + 1
        assert {f: n for f, n in taken.items() if n} == {r["file"]: r["records"] for r in found.routes.collect() if r["records"]}


def test_no_strategy_fits(spark, tmp_path):
    path = put(tmp_path, **{"a.csv": "x,y\n1,2,3\n4,5\n", "b.csv": "x,y\n6,7\n"})
    found = D.read_folder(spark, path, strategies=["standard", "quote_none"])
    assert plain(found.rows) == [("6", "7")]
    assert plain(found.rejects, "text", "lines", "reason") == [("1,2,3", 1, "no strategy fits"), ("4,5", 1, "no strategy fits")]
    with pytest.raises(D.UnreadableTable, match="a.csv"):
        D.read_delimited(spark, path, strategies=["standard", "quote_none"])
    with pytest.raises(ValueError):
        D.read_folder(spark, path, sep="||")


def test_many_routes_take_a_shuffle(spark, tmp_path, parts_of, monkeypatch):
    path = put(tmp_path, **{f"f{i}.csv": f'id,text\n{i},"a\nb, c"\n{i},d\n' for i in range(12)})
    parts_of(8)
    want = plain(D.read_folder(spark, path).rows)
    assert want == sorted([(str(i), t) for i in range(12) for t in ("a\nb, c", "d")], key=str)
    monkeypatch.setattr(D, "ROUTES_LIMIT", 0)
    assert plain(D.read_folder(spark, path).rows) == want


def test_without_checks_and_with_a_separator(spark, tmp_path):
    path = put(tmp_path, **{"a.csv": "x;y\n1;2\n3;4;5\n"})
    found = D.read_folder(spark, path, sep=";", strategies=["quote_none"], validate=False)
    assert plain(found.rows) == [("1", "2")] and plain(found.rejects, "text") == [("3;4;5",)]
