"""Exact duplicates by progressive refinement: length, then a prefix hash, then the full hash.

Two texts are equal when they are identical after each run of ASCII white space has become one space; a null
text counts as empty.

1. One pass over the texts stores id, length and a hash of the first characters of each row, all of them narrow. Lengths that
   one row has are done with; of the others, so are (length, prefix) pairs that one row has.
2. The pairs that are left mark slots of a table sized by their number (see ``keeping``). The second pass reads the whole text
   and computes the full hash only where a row's slot is marked. A row that shares a slot by chance is hashed in vain; nothing is lost.
3. The full hash makes the groups. A group with a third of all rows leaves every task as one row, and the join
   that brings its answer back is a plain equi-join of two stored tables, which adaptive execution splits.

Edge cases: rows repeated with the same id and text are all reported, one of them as kept. A null id never
wins against an id; if a group has null ids only, its ``keep_id`` is null and one of its rows is kept. An empty table
gives an empty result. Columns other than the named ones are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.keeping import MOST_MARKED, Marks, keep_rows
from plumbline.session import cut

PREFIX = 256


def normalised(text: Column) -> Column:
    """The text whose identity counts: runs of ASCII white space as one space, null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _refined(docs: DataFrame, id_col: str, text_col: str, digest: bool, prefix: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(``id, key, sha, times`` of every row, ``key, keep_id, group_size`` of the keys that several rows have), both stored."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("len", F.length("norm")).withColumn("pre", F.xxhash64(F.substring("norm", 1, prefix)))

    measured = cut(rows.groupBy("len", "pre").agg(F.count("*").alias("n")))  # the narrow table, alike rows summed
    lengths = measured.groupBy("len").agg(F.sum("n").alias("n")).where("n > 1").select("len")
    shared = measured.where("n > 1").join(lengths, "len", "left_semi").select("len", "pre")
    full = F.sha2("norm", 256)
    hashed = Marks(shared, "len", "pre", most=most).told(rows, "marked").select(
        "id",
        # a row alone in its slot is alone in (length, prefix), which then names it
        F.when(F.col("marked"), full).otherwise(F.concat_ws(":", F.lit("alone"), "len", "pre")).alias("key"),
        F.when(F.lit(digest), full).alias("sha"),
    )
    hashed = cut(hashed.groupBy("id", "key", "sha").agg(F.count("*").alias("times")))
    groups = cut(hashed.groupBy("key").agg(F.min("id").alias("keep_id"), F.sum("times").alias("group_size")).where("group_size > 1"))
    return hashed, groups


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
                 prefix: int = PREFIX, most: int = MOST_MARKED) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept``.

    ``digest=True`` adds ``text_sha256`` (lowercase hex of the normalised text) of every row, which is then
    computed for rows without a copy as well.
    """
    hashed, groups = _refined(docs, id_col, text_col, digest, prefix, most)
    copy = F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")
    joined = hashed.join(groups, "key", "left").select(
        "id", F.coalesce("keep_id", F.when(F.col("group_size").isNull(), F.col("id"))).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "sha", copy)
    out = [F.col("id").alias(id_col), "keep_id", "group_size",
           (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept")]
    return joined.select(*out, *([F.col("sha").alias("text_sha256")] if digest else []))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_MARKED) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows repeated with one id, one stays. Only texts that may have a copy are
    hashed as a whole, and only those that are dropped (and a few by chance) are moved."""
    hashed, groups = _refined(docs, id_col, text_col, False, PREFIX, most)
    verdict = hashed.join(groups, "key").select("id", F.col("key").alias("tag"), F.col("id").eqNullSafe(F.col("keep_id")).alias("keep"), "times")
    return keep_rows(docs, cut(verdict), id_col, F.sha2(normalised(docs[text_col]), 256), most)
