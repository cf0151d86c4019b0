"""Takes the rows that a narrow verdict keeps, without shuffling the texts of rows that are not in question.

The keys in question mark slots of a table that is ``SPREAD`` times as wide as their number, so that whatever the size of the input one row in
``SPREAD`` shares a marked slot by chance. The marked slots (one number each) are broadcast while there are ``MOST_MARKED`` or fewer; rows whose slot
is not marked pass where they are read, the others meet the verdict in an equi-join. Beyond that number all rows take the join; the result is
the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD = 32
MOST_MARKED = 1 << 22  # numbers that are broadcast at most


class Marks:
    """The marked slots of some keys; ``of`` tells whether a row's slot is marked."""

    def __init__(self, keys: DataFrame, *columns: str, most: int = MOST_MARKED) -> None:
        self._columns = columns
        hashed = keys.select(F.xxhash64(*columns).alias("key")).distinct()
        n = hashed.count()
        self.slots = SPREAD * max(1, n)
        self.none, self.many = n == 0, n > most
        self._table = hashed.select(self._slot(F.col("key")).alias("__slot")).distinct()

    def _slot(self, key: Column) -> Column:
        return F.pmod(key, F.lit(self.slots))

    def split(self, rows: DataFrame, *columns: Column) -> tuple[DataFrame | None, DataFrame]:
        """(rows that are not in question, rows that may be)."""
        if self.many:
            return None, rows
        slotted = rows.withColumn("__slot", self._slot(F.xxhash64(*columns)))
        return (slotted.join(F.broadcast(self._table), "__slot", "left_anti").drop("__slot"),
                slotted.join(F.broadcast(self._table), "__slot", "left_semi").drop("__slot"))

    def told(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with a column ``name``: whether a row may be in question."""
        if self.many or self.none:
            return rows.withColumn(name, F.lit(self.many))
        slotted = rows.withColumn("__slot", self._slot(F.xxhash64(*self._columns)))
        table = F.broadcast(self._table.withColumn("__marked", F.lit(True)))
        return slotted.join(table, "__slot", "left").withColumn(name, F.coalesce("__marked", F.lit(False))).drop("__slot", "__marked")


def keep_rows(docs: DataFrame, verdict: DataFrame, id_col: str, tag: Column, most: int = MOST_MARKED) -> DataFrame:
    """The rows of ``docs``, all columns, without those that ``verdict(id, tag, keep, times)`` drops.

    Rows are told apart by id and ``tag`` (a hash of the text); of ``times`` rows that are alike in both, one is kept. ``verdict``
    has one row at most for each (id, tag) of ``docs``; rows it does not mention stay. It is read several times, so it should be stored.
    """
    changes = verdict.where("NOT keep OR times > 1")
    marks = Marks(changes, "id", most=most)
    if marks.none:
        return docs
    clear, asked = marks.split(docs, docs[id_col])
    said = changes.select(F.col("id").alias("__id"), F.col("tag").alias("__own"), F.col("keep").alias("__keep"))
    asked = asked.withColumn("__tag", tag)
    found = asked.join(said, asked[id_col].eqNullSafe(said["__id"]) & (asked["__tag"] == said["__own"]), "left")
    once = found.where("__keep").dropDuplicates(["__id", "__own"]).select(*docs.columns)
    out = found.where("__keep IS NULL").select(*docs.columns).unionByName(once)
    return out if clear is None else clear.unionByName(out)
