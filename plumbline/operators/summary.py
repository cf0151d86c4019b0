"""Run summaries, ranked lists and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import names as N
from plumbline.functions.text import combo_text, pair_fields, test_kind
from plumbline.operators.filters import filter_usecase, flagged, needs_attention

# The four classes of a summary as (name, column, value).
CLASSES = [
    ("non_compliant_validations", "result", N.NOT_COMPLIANT), ("amendments", "status", N.AMENDED),
    ("filled_in", "status", N.FILLED_IN), ("issues", "result", N.POTENTIAL_ISSUE),
]


def counted(default: int = 0) -> Column:
    return F.coalesce(F.col("count").try_cast("bigint"), F.lit(default))


def _class_of(issue_results: Sequence[str] = (N.POTENTIAL_ISSUE,)) -> dict[str, Column]:
    out = {name: F.coalesce(F.col(column) == value, F.lit(False)) for name, column, value in CLASSES}
    out["issues"] = F.coalesce(F.col("result").isin(*issue_results), F.lit(False))
    return out


def tested_columns(results: DataFrame) -> DataFrame:
    """Distinct field names in the acted-upon and consulted texts, one per row."""
    fields = F.array_sort(F.array_distinct(F.concat(pair_fields(F.col("actedUpon")), pair_fields(F.col("consulted")))))
    return results.select(fields.alias("fields")).distinct().select(F.explode("fields").alias("column")).distinct()


def run_summary(results: DataFrame, n_records: int | None = None, issue_results: Sequence[str] = (N.POTENTIAL_ISSUE,),
                keys: Sequence[str] = (), records: DataFrame | None = None) -> DataFrame:
    """One row of run totals, or one for each value of ``keys`` (such as a run id). Without ``n_records`` the record count is the largest sum over
    a test; ``records(keys, n)`` gives it for each key, and a row of zeros to a key that has no results.

    Results are first reduced per (test, field list), a few rows per test, and totals are taken from those.
    """
    classes = _class_of(issue_results)
    fields = F.array_sort(F.array_distinct(F.concat(pair_fields(F.col("actedUpon")), pair_fields(F.col("consulted")))))
    per_test = results.groupBy(*keys, "test_id", fields.alias("fields")).agg(
        F.sum(counted()).alias("all"),
        *[F.sum(F.when(cond, counted()).otherwise(0)).alias(f"sum_{n}") for n, cond in classes.items()],
        *[F.count_if(cond).alias(f"rows_{n}") for n, cond in classes.items()])
    zero = F.lit(0).cast("bigint")
    if n_records is None and records is None:
        # only the largest sum over a test needs the tests themselves
        per_test = per_test.groupBy(*keys, "test_id").agg(
            F.sum("all").alias("all"), F.flatten(F.collect_list("fields")).alias("fields"),
            *[F.sum(f"{p}_{n}").alias(f"{p}_{n}") for n in classes for p in ("sum", "rows")])
    size = F.coalesce(F.max("all"), zero) if n_records is None else F.lit(n_records).cast("bigint")
    out = per_test.groupBy(*keys).agg(
        size.alias("number_of_records_in_dataset"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("fields")))).alias("list_of_all_columns_tested"),
        F.coalesce(F.sum("all"), zero).alias("no_of_tests_results"),
        F.size(F.collect_set("test_id")).cast("bigint").alias("no_of_tests_run"),
        *[F.coalesce(F.sum(f"sum_{n}"), zero).alias(f"no_of_{n}") for n in classes],
        *[F.coalesce(F.sum(f"rows_{n}"), zero).alias(f"no_of_unique_{n}") for n in classes],
    )
    if records is None:
        return out
    own = "number_of_records_in_dataset"
    known = records.select(*keys, F.col("n").alias(own)).join(out.drop(own), [*keys], "left")
    return known.select(*keys, own, *[F.coalesce(c, F.array().cast("array<string>")).alias(c) if c == "list_of_all_columns_tested" else F.coalesce(c, zero).alias(c)
                                      for c in out.columns if c not in (*keys, own)])


def top_results(results: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` rows with the highest count of each class, with ``class`` and ``rank``. The rank filter is
    applied per task before the shuffle, so a class that holds most rows does not meet in one task."""
    tagged = results.select(
        F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in _class_of().items()]))).alias("class"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("actedUpon", "consulted", "test_id", "result")], counted().alias("count"))
    w = Window.partitionBy("class").orderBy(F.col("count").desc(), "test_id", "actedUpon", "consulted", "result")
    return tagged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(
        "class", "rank", "actedUpon", "consulted", "test_id", "count")


def summary_with_top(results: DataFrame, n_records: int | None = None, n: int = 15) -> DataFrame:
    """:func:`run_summary` with the four ranked lists as arrays."""
    top = top_results(results, n).groupBy("class").agg(F.array_sort(F.collect_list(
        F.struct("rank", "actedUpon", "consulted", "test_id", "count"))).alias("rows"))
    lists = top.agg(F.map_from_entries(F.collect_list(F.struct("class", "rows"))).alias("m"))
    names = {"issues": "top_issues", "filled_in": "top_filled_in", "amendments": "top_amendments",
             "non_compliant_validations": "top_non_compliant_validations"}
    # One row from each side: put them below each other and fold them into one.
    totals = run_summary(results, n_records)
    both = totals.unionByName(lists, allowMissingColumns=True)
    one = both.agg(*[F.any_value(F.col(c), F.lit(True)).alias(c) for c in both.columns])
    none = F.array().cast("array<struct<rank:int,actedUpon:string,consulted:string,test_id:string,count:bigint>>")
    return one.select(*totals.columns, *[F.coalesce(F.col("m")[k], none).alias(out) for k, out in names.items()])


def dataset_size(results: DataFrame) -> DataFrame:
    """Largest sum of counts over the tests."""
    return results.groupBy("test_id").agg(F.sum(counted()).alias("s")).agg(
        F.coalesce(F.max("s"), F.lit(0)).alias("dataset_size"))


# Labels of the summary cards, in order.
CARDS = ["records in dataset", "tests across dataset", "test passes", "needs attention", "autocorrections",
         "can't be checked", "compliant"]


def summary_cards(results: DataFrame) -> DataFrame:
    """(position, label, number). Passes are all results but NOT_COMPLIANT; ``compliant`` counts only those
    that passed."""
    def total(cond: Column) -> Column:
        return F.sum(F.when(F.coalesce(cond, F.lit(False)), counted()).otherwise(0))

    per_test = results.groupBy("test_id").agg(
        F.sum(counted()).alias("all"), total(F.col("result") == N.NOT_COMPLIANT).alias("bad"),
        total(F.col("status").isin(*N.ACTIONABLE)).alias("fixed"), total(F.col("result") == N.POTENTIAL_ISSUE).alias("issues"),
        total(F.col("result") == N.COMPLIANT).alias("good"))
    one = per_test.agg(
        F.max("all"), F.count(F.lit(1)), F.sum("all") - F.sum("bad"), F.sum("bad"), F.sum("fixed"), F.sum("issues"), F.sum("good"),
    ).toDF(*[f"c{i}" for i in range(len(CARDS))])
    cards = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(label).alias("label"),
                               F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("bigint").alias("number"))
                      for i, label in enumerate(CARDS)])
    return one.select(F.inline(cards))


def attention_matrix(with_context: DataFrame) -> DataFrame:
    """(ie_class, test_id, count, percent) over needs-attention results, every class × test pair present.

    Counts are summed before anything else, so what follows has at most tests × classes rows; each class row
    is then widened from the list of all test ids.
    """
    ie = F.regexp_replace(F.coalesce("ie_class", F.lit("")), r"^[^:]+:", "")
    summed = needs_attention(with_context).groupBy(
        F.when(ie == "", F.lit("Unknown")).otherwise(ie).alias("ie_class"), "test_id").agg(
        F.sum(counted(1)).alias("count"), F.sum(counted(0)).alias("exact"))
    every = Window.partitionBy(F.lit(1))
    filled = summed.withColumn("tests", F.collect_set("test_id").over(every)).withColumn("total", F.sum("exact").over(every))
    per_class = filled.groupBy("ie_class", "tests", "total").agg(
        F.map_from_entries(F.collect_list(F.struct("test_id", "count"))).alias("counts"))
    cells = per_class.select("ie_class", "total", "counts", F.explode("tests").alias("test_id"))
    count = F.coalesce(F.try_element_at("counts", F.col("test_id")), F.lit(0).cast("bigint"))
    return cells.select("ie_class", "test_id", count.alias("count"),
                        F.when(F.col("total") > 0, count * 100.0 / F.col("total")).otherwise(0.0).alias("percent"))


def attention_pivot(matrix: DataFrame, tests: Sequence[str]) -> DataFrame:
    return matrix.groupBy("ie_class").pivot("test_id", list(tests)).agg(F.first("percent")).fillna(0.0)


def ranked_tests(df: DataFrame) -> DataFrame:
    """Sum of counts per test; show it in :func:`ranked_order`."""
    return df.groupBy("test_id").agg(F.sum(counted(1)).alias("total"))


def ranked_order() -> list:
    return [F.col("total").desc(), F.col("test_id").asc()]


def top_combos(df: DataFrame, k: int = 5, seq: str | None = None) -> DataFrame:
    """Per test the ``k`` combinations with the highest count: combo, count, comment of the first row."""
    order = F.col(seq) if seq else F.struct(F.coalesce("comment", F.lit("")))
    grouped = df.withColumn("combo", combo_text(F.col("actedUpon"), F.col("consulted"))).groupBy("test_id", "combo").agg(
        F.sum(counted(1)).alias("count"), F.min_by(F.coalesce("comment", F.lit("")), order).alias("comment"))
    w = Window.partitionBy("test_id").orderBy(F.col("count").desc(), "combo")
    return grouped.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def flag_heading(df: DataFrame) -> DataFrame:
    """Tests with flagged results and records they affect."""
    return flagged(df).groupBy("test_id").agg(F.sum(counted(1)).alias("s")).agg(
        F.count(F.lit(1)).alias("tests"), F.coalesce(F.sum("s"), F.lit(0)).alias("records"))


def kinds_available(df: DataFrame, usecase: str = "all", column: str = "usecases") -> DataFrame:
    """Kinds of the flagged tests within a use case with their counts."""
    return filter_usecase(flagged(df), usecase, column).groupBy(test_kind(F.col("test_id")).alias("kind")).agg(
        F.sum(counted(1)).alias("count")).filter("kind <> ''")


def breakdown(results: DataFrame) -> DataFrame:
    """Row counts by type, by status and by result, as (dimension, value, rows) from one read."""
    sets = ["test_type", "status", "result"]
    grouped = results.select(*[F.coalesce(c, F.lit("")).alias(c) for c in sets]).groupingSets(
        [[F.col(c)] for c in sets], *[F.col(c) for c in sets]).agg(F.count(F.lit(1)).alias("rows"))
    dimension = F.when(F.col("test_type").isNotNull(), "test_type").when(F.col("status").isNotNull(), "status").otherwise("result")
    return grouped.select(dimension.alias("dimension"), F.coalesce(*sets).alias("value"), "rows")


def page(df: DataFrame, number: int, size: int, order: Sequence) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows in the given total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def store_pages(df: DataFrame, path: str, order: Sequence[str]) -> DataFrame:
    """Store rows sorted by ranges of ``order``, so that a page after a key reads only the row groups that hold it."""
    keys = [N.col(c) for c in order]
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def page_after(df: DataFrame, order: Sequence[str], size: int, after: Sequence | None = None) -> DataFrame:
    """The ``size`` rows that follow the key ``after`` (values of ``order``, which must tell rows apart and hold no nulls), or the first ones.

    The next page starts after the last row of this one, so each task keeps ``size`` rows whatever the number of the page, where
    :func:`page` keeps those of all pages before as well. The first column is compared on its own too, which reaches the scan.
    """
    if after is not None:
        beyond = F.lit(False)
        for i in range(len(order) - 1, -1, -1):
            c, v = N.col(order[i]), F.lit(after[i])
            beyond = (c > v) | ((c == v) & beyond)
        df = df.where((N.col(order[0]) >= F.lit(after[0])) & beyond)
    return df.orderBy(*[N.col(c) for c in order]).limit(size)


def total_pages(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias("pages"))


def head_n(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    return df.orderBy(*order).limit(n)
