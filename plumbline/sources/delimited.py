"""Untidy delimited text to all-text tables.

A folder is read in three steps, each of which keeps its files splittable, quoted line breaks included:

1. **Profile**: every part (block) of every file is summed up on its own: widths of its lines, and what its quotes lead to from either state in
   which it may begin (see ``quoting``). One narrow row for each part.
2. **Route**: the parts of a file are folded in order, which tells the first strategy that fits that file, and which parts begin inside a
   quoted text.
3. **Read**: lines become records (only texts over several lines are put together, across parts by one narrow grouping of the pieces at
   the edges), and records become cells in Spark's own expressions, by the strategy of their file.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import NA_TOKENS
from plumbline.names import CORE_PREFIX
from plumbline.session import cut, ship_package
from plumbline.sources import quoting

# Delimiters looked for, the most common first.
DELIMITERS = [",", "\t", ";", "|"]
STRATEGIES = ["standard", "quote_none", "tab_quote_none", "repaired", "skip_bad"]


class UnreadableTable(ValueError):
    """No reading strategy fits the text."""


def sniff_delimiter(header: str) -> str:
    """The delimiter that splits the header line into most parts, quoted text left out."""
    def parts(sep: str) -> int:
        return len(next(csv.reader([header], delimiter=sep), []))
    best = max(DELIMITERS, key=lambda sep: (parts(sep), -DELIMITERS.index(sep)))
    return best if parts(best) > 1 else ","


def repair_quotes(lines: DataFrame, column: str = "value") -> DataFrame:
    """Put a tab between a closing quote and the text that follows it directly (``"a"b`` → ``"a"<TAB>b``)."""
    return lines.withColumn(column, _repaired(F.col(column)))


def clean_names(names: Sequence[str]) -> list[str]:
    """Header names without outer spaces, byte-order mark and outer quotes."""
    return [n.replace("﻿", "").strip().strip("\"'") for n in names]


def unique_names(names: Sequence[str | None]) -> list[str]:
    """Repeated names become ``name (2)``, ``name (3)``; missing ones ``NaN (1)``, ``NaN (2)``."""
    seen: dict[str, int] = {}
    missing, out = 0, []
    for n in names:
        if n is None:
            missing += 1
            out.append(f"NaN ({missing})")
            continue
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n} ({seen[n]})")
    return out


def clean_header(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def prefix_columns(df: DataFrame, prefix: str = CORE_PREFIX) -> DataFrame:
    """Add the namespace to names that lack it."""
    return df.toDF(*[n if n.startswith(prefix) else prefix + n for n in df.columns])


def unique_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def detect_core(columns: Sequence[str]) -> str | None:
    """``occurrence`` or ``taxon`` by the identifier column, occurrence first; None for neither."""
    have = {c.lower() for c in columns}
    if "dwc:occurrenceid" in have:
        return "occurrence"
    return "taxon" if "dwc:taxonid" in have else None


# Columns of the profile of a part, with their types.
_COURSES = [(f"{c}_{k}", t) for c in ("outside", "within")
            for k, t in (("inside", "boolean"), ("head", "bigint"), ("most", "bigint"), ("tail", "bigint"), ("records", "bigint"), ("spans", "bigint"))]
_PART = [("file", "string"), ("start", "bigint"), ("header", "string"), ("lines", "bigint"), ("sep", "string"), ("plain_most", "bigint"),
         ("tab_most", "bigint"), ("repaired_most", "bigint"), *_COURSES]
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
_ROUTE = ("file string, header string, strategy string, sep string, quoted boolean, names array<string>, lines bigint, records bigint, spans bigint, "
          "within array<bigint>, reason string")
# Routes of this size at most are sent to all tasks; beyond it lines are put in order by a shuffle.
ROUTES_LIMIT = 16 * 1024 * 1024
# Kinds of pieces that the lines of a part become.
_RECORD, _BARE, _HEAD, _TAIL, _MIDDLE = range(5)


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _ddl(fields: Sequence[tuple[str, str]]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields)


def profile_parts(lines: DataFrame, sep: str | None = None) -> DataFrame:
    """One row for each part (block) of a file and each separator in question: its quotes and widths.

    A part that opens a file knows its header, hence its separator; others are looked at under every separator.
    """
    ship_package(lines.sparkSession)
    schema = pa.schema([(n, _ARROW[t]) for n, t in _PART])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, header, parts, solid = None, None, [], 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([
                {"file": key[0], "start": key[1], "header": header, "lines": solid, "sep": p.sep, "plain_most": p.plain_most, "tab_most": p.tab_most,
                 "repaired_most": p.repaired_most}
                | {f"{n}_{k}": getattr(c, k) for n, c in (("outside", p.outside), ("within", p.within)) for k in ("inside", "head", "most", "tail", "records", "spans")}
                for p in parts], schema)

        for b in batches:
            for at, end in quoting.stretches(b.column(0), b.column(1)):
                own = (b.column(0)[at].as_py(), b.column(1)[at].as_py())
                if own != key:
                    if parts:
                        yield rows()
                    key, header, parts, solid = own, None, [], 0
                values = b.column(2).slice(at, end - at)
                if key[1] == 0 and header is None:
                    values, header = _after_header(values)
                    if header is None:
                        continue
                if not parts:
                    seps = [sep] if sep else [sniff_delimiter(_bare(header))] if key[1] == 0 else DELIMITERS
                    parts = [quoting.Part(s) for s in seps]
                solid += int(pc.sum(pc.not_equal(pc.utf8_trim_whitespace(values), "")).as_py() or 0)
                for p in parts:
                    p.add(values, key[1] == 0)
        if parts:
            yield rows()

    return lines.mapInArrow(run, _ddl(_PART))


def _bare(header: str) -> str:
    return header.replace("﻿", "")


def _after_header(values: pa.Array) -> tuple[pa.Array, str | None]:
    """The lines after the first one that is not blank, and that line."""
    for i, v in enumerate(values):
        if v.as_py().strip():
            return values.slice(i + 1), v.as_py()
    return values.slice(len(values)), None


def choose_strategy(header: str, sep: str, widest: dict[str, int], closed: bool, strategies: Sequence[str], validate: bool = True
                    ) -> tuple[str | None, str, bool, list[str]]:
    """(strategy, separator, whether quotes count, names) for a file; no strategy if none fits.

    ``widest`` holds the separators of the widest record as read by ``standard`` and as plain lines under ``plain``, ``tab`` and ``repaired``. Where the
    header has several names, a strategy that finds one does not fit. The last resort takes every line by itself and leaves out those
    that have more cells than the header; it splits at tabs if the header does.
    """
    header = _bare(header).rstrip("\r")
    split = next(csv.reader([header], delimiter=sep), [])
    by_tab = header.split("\t")
    options = {
        "standard": (sep, True, split, widest["standard"] if closed else None),
        "quote_none": (sep, False, header.split(sep), widest["plain"]),
        "tab_quote_none": ("\t", False, by_tab, widest["tab"]),
        "repaired": ("\t", False, quoting.repaired(header).split("\t"), widest["repaired"]),
        "skip_bad": ("\t", False, by_tab, -1) if len(by_tab) > 1 else (sep, True, split, -1),
    }
    for name in strategies:
        own, quoted, names, most = options[name]
        if validate and len(names) == 1 < max(len(split), len(by_tab)):
            continue
        if not validate or (most is not None and most < len(names)):
            return name, own, quoted, unique_names(clean_names(names))
    return None, sep, False, unique_names(clean_names(split))


def routes(parts: DataFrame, strategies: Sequence[str] = STRATEGIES, validate: bool = True) -> DataFrame:
    """One row for each file: how it is read. ``parts`` is a profile; a file has as many rows there as parts."""
    wanted = list(strategies)

    def route(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start")
        first = group.iloc[0]
        columns = ["file", "header", "strategy", "sep", "quoted", "names", "lines", "records", "spans", "within", "reason"]
        if first["start"] != 0 or first["header"] is None:
            return pd.DataFrame([[first["file"], None, None, "", False, [], int(group["lines"].sum()), 0, 0, [], "no header line"]], columns=columns)
        sep = first["sep"]
        own = group[group["sep"] == sep]
        chain = []
        for r in own.to_dict("records"):
            courses = [quoting.Course(bool(r[f"{n}_inside"]), r[f"{n}_head"], r[f"{n}_most"], r[f"{n}_tail"], r[f"{n}_records"], r[f"{n}_spans"]) for n in ("outside", "within")]
            chain.append((r["start"], quoting.Part(sep, *courses, r["plain_most"], r["tab_most"], r["repaired_most"])))
        most, records, spans, open_, within = quoting.fold(chain)
        widest = {"standard": int(most), "plain": int(own["plain_most"].max()), "tab": int(own["tab_most"].max()), "repaired": int(own["repaired_most"].max())}
        strategy, sep, quoted, names = choose_strategy(first["header"], sep, widest, not open_, wanted, validate)
        lines = int(own["lines"].sum())
        if strategy != "standard":
            records, spans, within = lines, 0, []
        reason = None if strategy else "no strategy fits"
        return pd.DataFrame([[first["file"], first["header"], strategy, sep, quoted, names, lines, int(records), int(spans), within, reason]], columns=columns)

    return parts.groupBy("file").applyInPandas(route, _ROUTE)


def _assembled(lines: DataFrame, place: DataFrame, few: bool) -> DataFrame:
    """``file, start, kind, text, lines``: records, and pieces of records that cross the edge of a part. Header and blank lines are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, begun, open_, held, inside = None, False, [], 0, False
        out: list[tuple] = []

        def close() -> None:
            if open_:
                out.append((*key, _MIDDLE if held else _TAIL, "\n".join(open_), len(open_)))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
            out.clear()
            return batch

        types, names = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32()], ["file", "start", "kind", "text", "lines"]
        for b in batches:
            for at, end in quoting.stretches(b.column(0), b.column(1)):
                own = (b.column(0)[at].as_py(), b.column(1)[at].as_py())
                sep, quoted, by_line, spans, within = (b.column(i)[at].as_py() for i in range(3, 8))
                if own != key:
                    close()
                    key, begun, open_, inside = own, own[1] != 0, [], bool(within)
                    held = inside  # the open record began in an earlier part
                values = b.column(2).slice(at, end - at)
                if not begun:
                    values, header = _after_header(values)
                    begun = header is not None
                if not spans and not (quoted and by_line):  # every line is a record
                    solid = values.filter(pc.not_equal(pc.utf8_trim_whitespace(values), ""))
                    if out:
                        yield flush()
                    kind = _RECORD if quoted else _BARE
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(v, t), len(solid)) if i != 3 else solid
                                                      for i, (v, t) in enumerate(zip((*key, kind, None, 1), types, strict=True))], names)
                    continue
                for line in values.to_pylist():
                    if not inside and not line.strip():
                        continue
                    after = '"' in line and quoting.scan(line, inside, sep)[1] or inside and '"' not in line
                    if by_line:  # even if a quote in it stays open
                        out.append((*key, _BARE if after else _RECORD, line, 1))
                        continue
                    inside = after
                    open_.append(line)
                    if not inside:
                        out.append((*key, _HEAD if held else _RECORD, "\n".join(open_), len(open_)))
                        open_, held = [], False
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    by_line = F.coalesce(F.col("strategy"), F.lit("")) != "standard"
    at = place.select("file", "sep", "quoted", by_line.alias("by_line"), (F.col("spans") > 0).alias("spans"), "within")
    if few:
        tagged = lines.join(F.broadcast(at), "file")
    else:  # the order of lines survives a shuffle by a number given before it
        numbered = lines.withColumn("n", F.monotonically_increasing_id())
        tagged = numbered.join(at, "file").repartition("file", "start").sortWithinPartitions("file", "start", "n")
    ready = tagged.select("file", "start", "value", "sep", "quoted", "by_line", "spans", F.array_contains("within", F.col("start")).alias("inside"))
    return ready.mapInArrow(run, "file string, start bigint, kind int, text string, lines int")


def _stitched(pieces: DataFrame) -> DataFrame:
    """Records from the pieces at the edges of parts, two at most for a part."""
    def stitch(group: pd.DataFrame) -> pd.DataFrame:
        out, held, n = [], [], 0
        # the end of an open record stands before the beginning of the next one in the same part
        for r in group.sort_values(["start", "kind"]).itertuples():
            held, n = [*held, r.text], n + r.lines
            if r.kind == _HEAD:
                out.append((r.file, r.start, _RECORD, "\n".join(held), n))
                held, n = [], 0
        return pd.DataFrame(out, columns=["file", "start", "kind", "text", "lines"])

    return pieces.groupBy("file").applyInPandas(stitch, "file string, start bigint, kind int, text string, lines int")


def _cells(text: Column, sep: Column, quoted: Column) -> Column:
    """The cells of a record; quotes count if ``quoted``."""
    # a quoted text with what follows it, or a text without a quote at its start
    literal = F.concat(F.lit("\\Q"), sep, F.lit("\\E"))
    one = F.concat(F.lit(r'("[^"]*+(?:""[^"]*+)*+"(?!")[^'), literal, F.lit(r']*+|[^'), literal, F.lit(r']*+)'), literal)
    plain = F.split(text, literal, -1)
    taken = F.regexp_extract_all(F.concat(text, sep), one, F.lit(1))
    inner = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"(?!")(.*)$'

    def bare(t: Column) -> Column:
        return F.when(t.startswith('"'), F.concat(F.replace(F.regexp_extract(t, inner, 1), F.lit('""'), F.lit('"')), F.regexp_extract(t, inner, 2))).otherwise(t)

    return F.when(quoted & F.contains(text, F.lit('"')), F.transform(taken, bare)).otherwise(plain)


@dataclass
class Folder:
    """What was read: rows (text columns, and ``_file`` if asked for), rejected records with their reason, and how each file was read."""

    rows: DataFrame
    rejects: DataFrame
    routes: DataFrame


def read_folder(spark: SparkSession, path: str | Sequence[str], sep: str | None = None, strategies: Sequence[str] = STRATEGIES,
                na_tokens: Sequence[str] = NA_TOKENS, keep_na_literals: bool = False, validate: bool = True, with_file: bool = False) -> Folder:
    """Read delimited files, each by the first strategy that fits it; nothing is dropped without a row in ``rejects``.

    ``rows`` has a text column for each header name of any file, in order of appearance; a file that lacks one has nulls there, as
    short rows do. ``rejects(file, text, lines, reason)`` has the records with more cells than their header (last strategy only), and every line of a file
    that no strategy fits or that has no header. ``routes(file, header, strategy, sep, lines, records, spans, reason)`` has one row for each file with a line; for each, its
    rows and rejects add up to ``records``, and their lines to ``lines``. ``validate=False`` takes the first strategy without looking at widths.
    Missing-value tokens become null; ``keep_na_literals`` keeps texts such as ``NA``. Line breaks inside quotes become ``\\n``.
    """
    if sep is not None and len(sep) != 1:
        raise ValueError("a separator is one character")
    lines = _lines(spark, path)
    place = cut(routes(profile_parts(lines, sep), strategies, validate))
    size, crossing = place.agg(F.sum(F.length("file") + F.length(F.coalesce("header", F.lit(""))) + 8 * F.size("within")), F.max(F.size("within"))).first()
    # columns by the first file that has them; there is one row for each different header
    seen = place.where("strategy is not null").groupBy("names").agg(F.min("file").alias("file")).orderBy("file").collect()
    names = list(dict.fromkeys(n for r in seen for n in r["names"]))
    records = _assembled(lines, place, (size or 0) <= ROUTES_LIMIT)
    if crossing:
        records = cut(records)
        edges = records.where(F.col("kind").isin(_HEAD, _TAIL, _MIDDLE))
        records = records.where(F.col("kind").isin(_RECORD, _BARE)).unionByName(_stitched(edges))
    columns = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    how = place.select("file", "strategy", "sep", "quoted", F.size("names").alias("width"), "reason",
                       F.transform(columns, lambda c: (F.array_position("names", c) - 1).cast("int")).alias("at"))
    known = records.join(F.broadcast(how) if (size or 0) <= ROUTES_LIMIT else how, "file")
    text = F.when(F.col("strategy") == "repaired", _repaired(F.col("text"))).otherwise(F.col("text"))
    cells = _cells(text, F.col("sep"), F.col("quoted") & (F.col("kind") == _RECORD))
    parsed = known.withColumn("cells", F.when(F.col("strategy").isNotNull(), cells))
    wide = F.size("cells") > F.col("width")
    tokens = [""] if keep_na_literals else list(na_tokens)

    def value(i: int) -> Column:
        cell = F.when(F.col("at")[i] >= 0, F.get("cells", F.col("at")[i]))
        return F.when(~cell.isin(*tokens), cell)

    rows = parsed.where("cells is not null").where(~wide).select(*[value(i).alias(n) for i, n in enumerate(names)], *([F.col("file").alias("_file")] if with_file else []))
    rejects = parsed.where(F.col("cells").isNull() | wide).select(
        "file", "text", "lines", F.coalesce("reason", F.format_string("%d cells under %d names", F.size("cells"), "width")).alias("reason"))
    return Folder(rows, rejects, place.drop("quoted", "names", "within"))


def _repaired(text: Column) -> Column:
    return F.regexp_replace(text, r'"([^"]*)"([^\s])', '"$1"\t$2')


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, strategies: Sequence[str] = STRATEGIES,
                   na_tokens: Sequence[str] = NA_TOKENS, keep_na_literals: bool = False, validate: bool = True) -> DataFrame:
    """The rows of :func:`read_folder`; an error if there is no line at all, or a file that no strategy fits."""
    found = read_folder(spark, path, sep, strategies, na_tokens, keep_na_literals, validate)
    lost = found.routes.agg(F.count("*").alias("files"), F.min(F.when(F.col("strategy").isNull(), F.concat("file", F.lit(": "), "reason"))).alias("bad")).first()
    if not lost["files"]:
        raise UnreadableTable(f"{path} is empty")
    if lost["bad"]:
        raise UnreadableTable(f"{lost['bad']} ({list(strategies)})")
    return found.rows


def read_dataset(spark: SparkSession, path: str, **options) -> tuple[DataFrame, str | None]:
    """A dataset with prefixed column names, and its core type (None means it cannot be processed)."""
    df = prefix_columns(clean_header(read_delimited(spark, path, **options)))
    return df, detect_core(df.columns)
