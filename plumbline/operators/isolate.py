"""Keeping what works when a rule raises while its rows are computed.

A rule that cannot be planned is found when the plan is built (see ``evaluate``). One that raises inside a task is only found by running it: the
results of all rules are written together, and if that fails, halves are tried until the failing rule is alone. Halves that succeed keep
what they wrote, so with one failing rule of n about twice the work of the plain run is done, in log2(n) steps. An input that is dear to
produce (``single_pass``) is read once: its combinations are stored first, and every step works on these.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.evaluate import FAILED_SCHEMA, Combos, Run, run_map_tests, run_tests, shared_combos
from plumbline.operators.lookups import References
from plumbline.rules.registry import Rule
from plumbline.session import checkpoint_dir

# What a failure of the cluster, not of a rule, says of itself.
CLUSTER_FAULTS = ("ExecutorLostFailure", "FetchFailed", "OutOfMemoryError", "No space left on device", "SparkContext was shut down", "Connection refused")


def reason_of(error: Exception) -> str:
    """The first line of the innermost error condition of a failed job."""
    lines = [x.strip() for x in str(error).split("\n")]
    inner = [x.split("Caused by: ", 1)[-1] for x in lines if "[" in x and "TASK_WRITE_FAILED" not in x and (x.startswith("Caused by: ") or x.startswith("["))]
    text = (inner or lines)[-1 if inner else 0]
    return text[text.index("["):] if inner else text


def _is_rule_fault(error: Exception) -> bool:
    return not any(x in str(error) for x in CLUSTER_FAULTS)


def write_isolated(spark: SparkSession, rules: Sequence[Rule], build: Callable[[list[Rule]], DataFrame], path: str) -> tuple[list[Rule], list[tuple[str, str]]]:
    """Write the results of ``rules`` to ``path`` (Parquet, replacing what is there) without those that raise: (rules written, failed).

    ``build`` gives the results of some of the rules. A fault of the cluster ends the call, as it says nothing about a rule.
    """
    scratch, done = f"{checkpoint_dir(spark).rstrip('/')}/isolated-{uuid.uuid4().hex}", []

    def attempt(some: list[Rule], to: str) -> tuple[list[Rule], list[tuple[str, str]]]:
        try:
            build(some).write.mode("overwrite").parquet(to)
        except (PySparkException, Py4JJavaError) as error:
            if not _is_rule_fault(error):
                raise
            if len(some) == 1:
                return [], [(some[0].id, reason_of(error))]
        else:
            done.append(to)
            return some, []
        half = len(some) // 2
        parts = [attempt(part, f"{scratch}/{uuid.uuid4().hex}") for part in (some[:half], some[half:])]
        return [r for p in parts for r in p[0]], [f for p in parts for f in p[1]]

    good, failed = attempt(list(rules), path) if rules else ([], [])
    if failed and done:
        reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in done]).write.mode("overwrite").parquet(path)
    return good, failed


def _stored_combos(df: DataFrame, rules: Sequence[Rule], carry: Sequence[str]) -> Combos | None:
    """:func:`shared_combos`, stored; None if there are none or the input raises, which the rules are then told by."""
    combos = shared_combos(df, rules, carry)
    if combos is None:
        return None
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/combos-{uuid.uuid4().hex}"
    try:
        combos.rows.write.parquet(path)
    except (PySparkException, Py4JJavaError) as error:
        if not _is_rule_fault(error):
            raise
        return None
    return Combos(combos.sets, df.sparkSession.read.parquet(path))


def run_stored(df: DataFrame, rules: Iterable[Rule], path: str, refs: References | None = None, single_pass: bool = False, carry: Sequence[str] = ()) -> Run:
    """:func:`run_tests` with its results stored under ``path`` and read back; rules that raise at run time are in ``failed`` as well."""
    spark = df.sparkSession
    run = run_tests(df, rules, refs, single_pass, carry)
    if not run.rules:
        run.results.write.mode("overwrite").parquet(path)
        return Run(spark.read.parquet(path), run.failed, [])
    combos = _stored_combos(df, run.rules, carry) if single_pass else None
    good, raised = write_isolated(spark, run.rules, lambda some: run_tests(df, some, refs, single_pass, carry, combos).results, path)
    if not good:
        run.results.limit(0).write.mode("overwrite").parquet(path)
    failed = run.failed.unionByName(spark.createDataFrame(raised, FAILED_SCHEMA)) if raised else run.failed
    return Run(spark.read.parquet(path), failed, good)


def write_map_tests(rows: DataFrame, rules: Sequence[Rule], carry: Sequence[str], path: str, refs: References | None = None) -> list[tuple[str, str]]:
    """:func:`run_map_tests` stored under ``path``; (id, reason) of the rules that raised."""
    good, failed = write_isolated(rows.sparkSession, rules, lambda some: run_map_tests(rows, some, carry, refs=refs), path)
    if not good:
        run_map_tests(rows, [], carry).write.mode("overwrite").parquet(path)
    return failed
