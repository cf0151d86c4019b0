"""Submitted messages: nested JSON with attachments, and the tables inside them."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import NA_TOKENS, let
from plumbline.names import CORE_PREFIX
from plumbline.session import ship_package
from plumbline.sources.delimited import clean_names, sniff_delimiter, unique_names

# Layout of a submission message.
SUBMISSION_DDL = (
    "receivedAt string, messageId string, threadId string, historyId string, labelIds array<string>, snippet string, "
    "headers struct<subject:string,`from`:string,`to`:string,cc:string,date:string,messageId:string,inReplyTo:string,references:string>, "
    "body struct<text:string,html:string>, "
    "attachments array<struct<filename:string,mimeType:string,size:bigint,contentBase64:string>>"
)
CORRUPT = "_corrupt_record"


def parse_messages(files: DataFrame) -> DataFrame:
    """Whole JSON texts (column ``value``) to message columns; a text that is no JSON is kept in
    ``_corrupt_record``."""
    parsed = F.from_json("value", SUBMISSION_DDL).alias("m")
    broken = F.when(F.get_json_object("value", "$").isNull(), F.col("value")).alias(CORRUPT)
    return files.select(parsed, broken).select("m.*", CORRUPT)


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """One row per message file."""
    return parse_messages(spark.read.text(path, wholetext=True))


def split_corrupt(submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, dead letters)."""
    bad = F.col(CORRUPT).isNotNull()
    return submissions.filter(~bad).drop(CORRUPT), submissions.filter(bad).select(CORRUPT)


# Rows handed back to Spark at a time, and the longest header (characters) whose names are remembered.
OUTPUT_ROWS = 5000
LONG_HEAD = 4096


def is_table(a: Column) -> Column:
    """Whether an attachment looks like delimited text, by name or type."""
    name, mime = F.lower(F.coalesce(a["filename"], F.lit(""))), F.lower(F.coalesce(a["mimeType"], F.lit("")))
    return (name.endswith(".csv") | name.endswith(".tsv") | mime.contains("csv") | mime.contains("text/plain")
            | mime.contains("tab-separated"))


def decode_base64(c: Column) -> Column:
    """Text of standard or url-safe base64, padded or not; null when it cannot be decoded. Characters outside
    the alphabet are skipped, bytes that are no UTF-8 become replacement characters."""
    # padding and white space go with the translation, so that the costly replacement is left to texts that hold something else
    plain = F.translate(c, "-_= \t\r\n", "+/")

    def decoded(body: Column) -> Column:
        padded = F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4))))
        binary = F.when(F.length(body) % 4 != 1, F.try_to_binary(padded, F.lit("base64")))
        return F.make_valid_utf8(binary.cast("string"))

    body = let(plain, lambda p: F.when(p.rlike(r"\A[A-Za-z0-9+/]*+\z"), p).otherwise(F.regexp_replace(p, r"[^A-Za-z0-9+/]", "")))
    return let(body, decoded)


def extract_attachments(submissions: DataFrame) -> DataFrame:
    """Add ``filename`` and ``content`` of the first table attachment that can be decoded, null for none.

    Done inside each message's own array, so there is no shuffle.
    """
    tables = F.filter("attachments", is_table)
    decoded = F.filter(
        F.transform(tables, lambda a: F.struct(F.coalesce(a["filename"], F.lit("unknown_file")).alias("filename"),
                                               decode_base64(a["contentBase64"]).alias("content"))),
        lambda d: d["content"].isNotNull())
    first = F.try_element_at(decoded, F.lit(1))
    return submissions.withColumn("__first", first).withColumns(
        {"filename": F.col("__first.filename"), "content": F.col("__first.content")}).drop("__first")


_NA = frozenset(NA_TOKENS)
csv.field_size_limit(1 << 30)  # a field may be as long as a message


@lru_cache(maxsize=1024)
def _delimiter(head: str) -> str:
    return sniff_delimiter(head)


@lru_cache(maxsize=1024)
def _names(header: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(n if n.startswith(CORE_PREFIX) else CORE_PREFIX + n for n in unique_names(clean_names(header)))


def _table_rows(content: str) -> Iterator[tuple[int, dict[str, str] | None, str | None]]:
    """(line, values, problem): a row with more cells than the header has no values but its own text as problem."""
    text = content.lstrip("\ufeff")
    head = text.split("\n", 1)[0].rstrip("\r")
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=(_delimiter if len(head) <= LONG_HEAD else sniff_delimiter)(head))
    header = next(reader, None)
    if not header:
        return
    names = (_names if len(head) <= LONG_HEAD and reader.line_num == 1 else _names.__wrapped__)(tuple(header))
    for i, row in enumerate(r for r in reader if any(cell.strip() for cell in r)):
        if len(row) > len(names):
            yield i, None, f"{len(row)} cells under {len(names)} names: {row!r}"
            continue
        cells = [*row, *[""] * (len(names) - len(row))]
        yield i, {n: ("" if v in _NA else v) for n, v in zip(names, cells, strict=True)}, None


def _isolated_rows(content: str) -> Iterator[tuple[int, dict[str, str] | None, str | None]]:
    """:func:`_table_rows`; an error ends this table only and is its last problem."""
    try:
        yield from _table_rows(content)
    except Exception as error:  # one message must not stop the others
        yield -1, None, f"{type(error).__name__}: {error}"


def submission_rows(messages: DataFrame, id_column: str = "messageId", content: str = "content", problems: bool = False,
                    spread: bool = True) -> DataFrame:
    """(id, line, values): the rows of each message's table as a map from prefixed column to text.

    ``problems`` adds what could not be taken, as rows without values: column ``problem`` holds a row with more cells than
    the header, or the error that ended the reading of a table.

    Tables with different headers stay in one DataFrame. A message is bounded by the mail size limit, so
    one task parses it whole. Messages are spread over tasks by id first, because parsing costs more than
    moving them and they tend to arrive packed into few files; without ``spread`` they are parsed where they are read.
    """
    ship_package(messages.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lines, values, faults = [], [], [], []

        def batch_of_rows() -> pa.RecordBatch:
            offsets, at = [], 0
            for cells in values:
                offsets.append(None if cells is None else at)
                at += len(cells or ())
            keys = pa.array([k for cells in values if cells for k in cells], pa.string())
            items = pa.array([v for cells in values if cells for v in cells.values()], pa.string())
            maps = pa.MapArray.from_arrays(pa.array([*offsets, at], pa.int32()), keys, items)
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lines, pa.int64()), maps, pa.array(faults, pa.string())],
                                             ["id", "line", "values", "problem"])
            for part in (ids, lines, values, faults):
                part.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for line, cells, fault in _isolated_rows(text):
                    ids.append(key)
                    lines.append(line)
                    values.append(cells)
                    faults.append(fault)
                    if len(ids) >= OUTPUT_ROWS:
                        yield batch_of_rows()
        if ids:
            yield batch_of_rows()

    chosen = messages.select(F.col(id_column).cast("string").alias("id"), F.col(content).alias("content")).filter(F.col("content").isNotNull())
    rows = (chosen.repartition("id") if spread else chosen).mapInArrow(parse, "id string, line long, values map<string,string>, problem string")
    return rows if problems else rows.where("problem IS NULL").drop("problem")
