"""A whole run: read, test, amend, summarise and store."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.amend import apply_amendments
from plumbline.operators.catalogue import context_of
from plumbline.operators.context import curated
from plumbline.operators.evaluate import Run, run_tests
from plumbline.operators.isolate import run_stored
from plumbline.operators.lookups import References
from plumbline.operators.summary import summary_with_top
from plumbline.rules.registry import Rule, catalogue_of
from plumbline.sources.delimited import detect_core
from plumbline.sources.sinks import run_path, write_run


class NoCore(ValueError):
    """The table has neither an occurrence nor a taxon identifier."""


@dataclass
class Report:
    """What a run leaves behind; every table is read back from where it was stored."""

    core: str
    original: DataFrame
    results: DataFrame
    amended: DataFrame
    failed: DataFrame
    summary: DataFrame
    curated: DataFrame


def run_dataset(df: DataFrame, rules: Iterable[Rule], out: str, run_id: str, refs: References | None = None) -> Report:
    """Store the table, run the tests on the stored columns, store the results, amend from them and summarise. Tests that cannot be
    planned or that raise while they run are listed in ``failed``; the others keep their results.

    Storing first turns text parsing into one pass; the tests then read only the columns each key set needs,
    and everything after the tests reads the small result table.
    """
    core = detect_core(df.columns)
    if core is None:
        raise NoCore("neither dwc:occurrenceID nor dwc:taxonID is present")
    spark: SparkSession = df.sparkSession
    chosen = list(rules)
    paths = write_run(out, run_id, original=df)
    original = spark.read.parquet(paths["original"])
    run: Run = run_stored(original, chosen, run_path(out, run_id, "results"), refs)
    results = run.results
    paths.update(write_run(out, run_id, amended=apply_amendments(original, results)))
    return Report(
        core, original, results, spark.read.parquet(paths["amended"]), run.failed,
        summary_with_top(results, original.count()), curated(results, context_of(catalogue_of(spark, chosen))))


def revalidate(report: Report, rules: Iterable[Rule], refs: References | None = None) -> Run:
    """A second run over the amended table; the first run never looks at amended values."""
    return run_tests(report.amended, rules, refs)
