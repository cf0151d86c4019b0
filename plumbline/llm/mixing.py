"""Mixing sources to target weights by hierarchical budgeting.

The sources form a tree, by default domain, language, source. Each node's supply is its tokens times the epochs that are allowed.

1. **Supply**: one pass counts the tokens of each leaf (partial aggregation, so a leaf with a third of all rows is one row per task).
2. **Budgets**, from the root down: a node's budget is dealt among its children by weight. A child that cannot use its share is
   filled up and the rest goes to its siblings by weight; only what a whole subtree cannot use reaches the siblings of its
   ancestor. This is water filling with the supply of subtrees as caps: children in order of cap over weight, and the level at which
   the budget is used up, from window sums among siblings.
3. **Prefix**: a leaf gives whole epochs first. For the rest, its rows stand in the seeded order of the next epoch (a hash of seed,
   epoch and id) and those whose running total stays within the budget are taken. The running total is never made over a
   whole leaf: the order is cut into bins of about ``BIN_ROWS`` rows, bins are summed, and only the rows of the one bin in which
   the budget ends are ordered. The leaf then needs only (bin, position), and rows are judged where they are read: texts are not shuffled.

The table of leaves is broadcast while it has ``MANY_LEAVES`` rows or fewer, else joined by key.

Edge cases: a null in a path column is a node of its own; a null text has no tokens; rows without an id are placed by a hash of their
text. Rows at one position (repeated with one id, or equal texts without one) are taken together. A child of weight zero gets nothing; a leaf without tokens gives nothing. A
budget over the supply gives the whole supply. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut

BIN_ROWS = 2_000
MANY_LEAVES = 100_000
TOP = 1 << 60  # positions are 60-bit numbers


def token_count(text: Column) -> Column:
    """Words between ASCII white space, counted without holding them: each becomes one letter, white space goes."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def _node(path: Sequence[Column]) -> Column:
    return F.to_json(F.array(*[p.cast("string") for p in path]))


def _name(id_: Column, text: Column) -> Column:
    """What places a row in its leaf: the id, or a hash of the text where there is none."""
    return F.coalesce(id_.cast("string"), F.concat(F.lit("no id "), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).cast("string")))


def _position(seed: int, epoch: Column, name: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), name)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _bin(position: Column, bins: Column) -> Column:
    return F.floor(position / F.lit(float(TOP)) * bins).cast("long")


def _filled(children: DataFrame) -> DataFrame:
    """Deals ``budget`` of each ``parent`` among ``children(parent, node, cap, weight, budget)``: ``node, budget``."""
    order = Window.partitionBy("parent").orderBy(F.col("cap") / F.col("weight"), "node")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    c = children.where("weight > 0 and cap > 0")
    c = c.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    # the level is right at the first child that it does not fill
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.row_number().over(order).alias("place"), F.col("level").alias("level")))
    c = c.withColumn("at", open_).withColumn("at", F.min("at").over(Window.partitionBy("parent")))
    share = F.least(F.col("cap").cast("double"), F.col("at.level") * F.col("weight"))
    return c.select("node", F.coalesce(share, F.col("cap").cast("double")).alias("budget"))


def budgets(leaves: DataFrame, depth: int, weights: Mapping[tuple, float], budget_share: float, max_epochs: int) -> DataFrame:
    """``leaf, supply, n, budget`` for ``leaves(n0.., leaf, supply, n)``; n0.. are the nodes on the way down.

    ``weights`` names nodes by their path of strings; a node that is not named has weight 1.
    """
    session = leaves.sparkSession
    named = session.createDataFrame([(list(map(str, path)), float(w)) for path, w in weights.items()] or [([""] * (depth + 1), 1.0)],
                                    "path array<string>, weight double").select(F.to_json("path").alias("node"), "weight")
    total = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("t"))
    level = total.select(F.lit("[]").alias("node"), F.least(F.col("t") * F.lit(float(budget_share)), (F.col("t") * max_epochs).cast("double")).alias("budget"))
    for i in range(1, depth + 1):
        parent = F.lit("[]") if i == 1 else F.col(f"n{i - 1}")
        nodes = leaves.groupBy(parent.alias("parent"), F.col(f"n{i}").alias("node")).agg((F.sum("supply") * max_epochs).alias("cap"))
        nodes = nodes.join(named, "node", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        level = _filled(nodes.join(level.select(F.col("node").alias("parent"), "budget"), "parent"))
    return leaves.join(level.select(F.col("node").alias("leaf"), "budget"), "leaf").select("leaf", "supply", "n", "budget")


def mix(docs: DataFrame, path: Sequence[Column], weights: Mapping[tuple, float], budget_share: float, max_epochs: int = 4, seed: int = 0,
        id_col: str = "doc_id", text_col: str = "text", bin_rows: int = BIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, all columns, with ``__copies``: the epochs in which a row is taken."""
    depth, leaf = len(path), _node(path)
    narrow = cut(docs.select(_name(F.col(id_col), F.col(text_col)).alias("name"), token_count(F.col(text_col).cast("string")).alias("tokens"),
                             *[_node(path[:i]).alias(f"n{i}") for i in range(1, depth + 1)]))
    narrow = narrow.withColumn("leaf", F.col(f"n{depth}"))
    leaves = cut(narrow.groupBy("leaf", *[f"n{i}" for i in range(1, depth + 1)]).agg(F.sum("tokens").alias("supply"), F.count("*").alias("n")))
    plan = cut(budgets(leaves, depth, weights, budget_share, max_epochs).where("supply > 0").select(
        "leaf", F.floor(F.col("budget") / F.col("supply")).cast("long").alias("whole"),
        (F.floor("budget") - F.floor(F.col("budget") / F.col("supply")) * F.col("supply")).cast("long").alias("rest"),
        F.ceil(F.col("n") / bin_rows).cast("long").alias("bins")))
    few = plan.count() <= MANY_LEAVES

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    placed = narrow.join(small(plan), "leaf").select("leaf", "tokens", "rest", _position(seed, F.col("whole"), F.col("name")).alias("position"), "bins")
    placed = placed.withColumn("bin", _bin(F.col("position"), F.col("bins")))
    sums = placed.groupBy("leaf", "bin", "rest").agg(F.sum("tokens").alias("tokens"))
    running = F.sum("tokens").over(Window.partitionBy("leaf").orderBy("bin"))
    ends = sums.withColumn("upto", running).where("upto > rest").groupBy("leaf").agg(
        F.min(F.struct("bin", (F.col("upto") - F.col("tokens")).alias("before"))).alias("end"))
    ends = cut(ends.select("leaf", F.col("end.bin").alias("last_bin"), F.col("end.before").alias("before")))
    last = placed.join(small(ends), "leaf").where("bin = last_bin")
    # rows at one position count together
    total = F.sum("tokens").over(Window.partitionBy("leaf").orderBy("position").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    upto = last.withColumn("total", F.col("before") + total).where("total <= rest").groupBy("leaf").agg(F.max("position").alias("upto"))
    plan = cut(plan.join(ends, "leaf", "left").join(upto, "leaf", "left").select(
        F.col("leaf").alias("__leaf"), F.col("whole").alias("__whole"), F.col("bins").alias("__bins"),
        F.coalesce("last_bin", F.lit(-1)).alias("__last"), F.coalesce("upto", F.lit(-1)).alias("__upto")))

    rows = docs.withColumn("__own", leaf)
    rows = rows.join(small(plan), rows["__own"] == plan["__leaf"])
    position = _position(seed, F.col("__whole"), _name(docs[id_col], docs[text_col]))
    at = _bin(position, F.col("__bins"))
    part = (at < F.col("__last")) | ((at == F.col("__last")) & (position <= F.col("__upto")))
    return rows.withColumn("__copies", F.col("__whole") + part.cast("long")).where("__copies > 0").select(*[docs[c] for c in docs.columns], "__copies")
