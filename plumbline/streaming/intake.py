"""Submissions as a stream: intake, once-only processing, routing and per-batch runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from plumbline.functions.sizing import stored_bytes
from plumbline.functions.text import blank
from plumbline.operators.amend import amend_maps
from plumbline.operators.catalogue import context_of
from plumbline.operators.context import curated
from plumbline.operators.isolate import write_map_tests
from plumbline.operators.lookups import References, missing_tables
from plumbline.operators.summary import run_summary
from plumbline.rules.registry import Rule, catalogue_of
from plumbline.session import ship_package
from plumbline.sources.submissions import CORRUPT, extract_attachments, parse_messages, submission_rows

# Messages per poll and time between polls.
MAX_PER_POLL = 50
POLL_INTERVAL = "1 minute"


def stream_submissions(spark: SparkSession, path: str, max_files: int = MAX_PER_POLL) -> DataFrame:
    """Message files as a stream, at most ``max_files`` per micro-batch."""
    return parse_messages(spark.readStream.option("maxFilesPerTrigger", max_files).text(path, wholetext=True))


def dedupe_submissions(stream: DataFrame, delay: str | None = None, key: str = "messageId", at: str = "receivedAt") -> DataFrame:
    """One row per message id, whatever the message's age: the ids are kept in the state store, keyed, so a batch looks up only its own.

    With ``delay``, for feeds whose arrival times are bounded, an id is forgotten that long after the latest arrival time, and a message older
    than that is late. Of rows with one id in the same batch any may stay. Rows without an id are merged here; the intake passes them by.
    """
    if delay is None:
        return stream.dropDuplicates([key])
    timed = stream.withColumn("received", F.col(at).try_cast("timestamp"))
    return timed.withWatermark("received", delay).dropDuplicatesWithinWatermark([key])


class EarliestOfThread(StatefulProcessor):
    """State of a thread: the earliest message seen. Rows come back with ``first``: whether a message is earlier than all others so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._earliest = handle.getValueState("earliest", "at string, id string")

    def handleInputRows(self, key, rows, timerValues):
        found = list(rows)  # of one thread in one micro-batch
        places = [(r["at"] or "", r["id"] or "") for r in found]
        best, known = min(places), self._earliest.get()
        if known is None or best < tuple(known):
            self._earliest.update(best)
        for r, place in zip(found, places, strict=True):
            yield Row(payload=r["payload"], first=place == best and (known is None or place <= tuple(known)))

    def close(self) -> None:
        pass


# The state store of keyed state; ids and threads are kept on disk, so their number is not bounded by memory.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATE_PARTITIONS = 8  # at least, where the session has as many shuffle partitions
FIRST = "first_of_thread"


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while. A stream keeps a copy of those it was started with."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _state_partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions, but not many more than cores."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(STATE_PARTITIONS, spark.sparkContext.defaultParallelism))


def once_per_thread(stream: DataFrame) -> DataFrame:
    """Messages by id once, with ``first_of_thread``: whether a message is the earliest of its thread so far.

    Both are keyed state without a limit of age: the cost of a batch does not grow with what was taken before. Messages without an id (unreadable
    texts among them) cannot repeat one and belong to no thread; they all pass.
    """
    ship_package(stream.sparkSession)
    schema = stream.schema
    named = stream.where(col_has("messageId"))
    once = dedupe_submissions(named).select(
        F.when(col_has("threadId"), F.col("threadId")).otherwise(F.concat(F.lit("message "), F.col("messageId"))).alias("thread"),
        F.col("receivedAt").alias("at"), F.col("messageId").alias("id"), F.to_json(F.struct(*stream.columns)).alias("payload"))
    told = once.groupBy("thread").transformWithState(EarliestOfThread(), "payload string, first boolean", "append", "none")
    read = told.select(F.from_json("payload", schema).alias("m"), F.col("first").alias(FIRST)).select("m.*", FIRST)
    nameless = stream.where(~col_has("messageId")).withColumn(FIRST, F.lit(True))
    return read.unionByName(nameless.coalesce(_state_partitions(stream.sparkSession)))


def col_has(name: str) -> Column:
    return ~blank(F.col(name))


def is_top_level() -> Column:
    """No reply headers."""
    return blank(F.col("headers.inReplyTo")) & blank(F.col("headers.references"))


def top_level(df: DataFrame, per_thread: bool = False, at: str = "receivedAt") -> DataFrame:
    """Messages that are no replies; ``per_thread`` (batch only) also asks for the earliest of their thread.

    The earliest message is found by a partial aggregate, so a long thread is never gathered in a task.
    """
    if not per_thread:
        return df.filter(is_top_level())
    first = df.groupBy("threadId").agg(F.min(F.struct(F.col(at).alias("at"), F.col("messageId").alias("id"))).alias("first"))
    return df.filter(is_top_level()).join(first.select(F.col("first.id").alias("messageId")), "messageId", "left_semi")


def route(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(with attachments, without)."""
    has = F.coalesce(F.size("attachments") > 0, F.lit(False))
    return df.filter(has), df.filter(~has)


# Columns of the parts of a batch that are set aside.
_REASON = ["messageId", "threadId", "receivedAt", "reason"]
PROCESSED = "processed"
COMMIT = "batch_id int, tables array<string>, messages bigint, processed bigint"
CURATED_ROWS = 500  # of each run, as in the report of a single run
TABLES = ["intake", "no_attachment", "parsed", "rejected", "results", "left_out", "amended", "summary", "curated", "outcome", "dead_letter"]

# A batch whose stored messages have at most so many bytes is run with one task for each step: groupings and joins then need no exchange, joins build no
# broadcast and expressions are not compiled, which would take longer than their rows. A larger one is dealt over the tasks that adaptive plans choose.
ONE_TASK = 1024 * 1024
ADAPTIVE = {"spark.sql.adaptive.enabled": "true"}  # a stream turns it off for its state; what a run does is read from files
IN_ONE_TASK = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
SIDE_BY_SIDE = 8  # steps at once


class Batches:
    """The two halves of :func:`process_batch`: taking the messages of a micro-batch, and the runs over what was taken."""

    def __init__(self, out: str, rules: Iterable[Rule], refs: References | None = None) -> None:
        self.out, self.chosen, self.refs = out, list(rules), refs or References()
        self.runnable = [r for r in self.chosen if r.type != "Measure" and r.columns and not missing_tables(r, self.refs)]
        self.waiting = [(r.id, "reference table not given: " + ",".join(missing_tables(r, self.refs))) for r in self.chosen if missing_tables(r, self.refs)]
        self._own: SparkSession | None = None

    def _path(self, name: str, batch_id: int) -> str:
        return f"{self.out}/{name}/batch_id={batch_id}"

    def take(self, batch: DataFrame, batch_id: int) -> StructType:
        """Store the messages; returns their schema."""
        first = batch if FIRST in batch.columns else batch.withColumn(FIRST, F.lit(True))
        messages = extract_attachments(first)
        with _settings(batch.sparkSession, ADAPTIVE):
            messages.write.mode("overwrite").parquet(self._path("intake", batch_id))
        return messages.schema

    def _session(self, spark: SparkSession) -> SparkSession:
        """A session of the runs with the settings of ``spark``, since a stream plans its next batch in ``spark`` meanwhile."""
        if self._own is None:
            self._own = spark.newSession()
            for k, v in spark.conf.getAll.items():
                if spark.conf.isModifiable(k):
                    self._own.conf.set(k, v)
            for k, v in ADAPTIVE.items():
                self._own.conf.set(k, v)
        return self._own

    def finish(self, spark: SparkSession, batch_id: int, schema: StructType | None = None) -> None:
        """The runs over the messages that were stored, and the commit."""
        spark = self._session(spark)
        reader = spark.read if schema is None else spark.read.schema(schema)
        messages = reader.parquet(self._path("intake", batch_id))
        little = stored_bytes(messages) <= ONE_TASK

        def read(path: str, schema: StructType | None = None) -> DataFrame:
            table = (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
            return table.coalesce(1) if little else table

        def store(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(self._path(name, batch_id))
            return read(self._path(name, batch_id), df.schema)

        bad = F.col(CORRUPT).isNotNull()
        top = is_top_level() & F.col(FIRST)
        # a message without an id is told apart by its content
        messages = (messages.coalesce(1) if little else messages).withColumn("run_id", F.when(col_has("messageId"), F.col("messageId")).otherwise(
            F.concat(F.lit("no id "), F.sha2(F.to_json(F.struct(*messages.columns)), 256))))
        fine, empty = route(messages.filter(~bad & top))

        def set_aside(parsed: DataFrame) -> DataFrame:
            outcome = store(self._outcomes(messages, parsed, bad, top), "outcome")
            store(outcome.where(~F.col("reason").isin(PROCESSED, "reply", "no attachment")).select(*_REASON), "dead_letter")
            return outcome

        # steps that do not read each other's tables run side by side
        with _settings(spark, IN_ONE_TASK if little else {}), ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            def start(step: Callable, *given) -> Future:
                return pool.submit(inheritable_thread_target(spark)(step), *given)

            steps = [start(lambda: store(empty.select(*_REASON[:3], F.lit("no attachment").alias("reason")), "no_attachment"))]
            # The parsed rows are read once per key set, so they are stored and each message is parsed once.
            parsed = store(submission_rows(fine, "run_id", problems=True, spread=not little).withColumnRenamed("id", "run_id"), "parsed")
            outcome = start(set_aside, parsed)
            steps.append(start(lambda: store(parsed.where("problem IS NOT NULL").select("run_id", "line", "problem"), "rejected")))
            rows = parsed.where("problem IS NULL").drop("problem")
            raised = write_map_tests(rows, self.runnable, ["run_id"], self._path("results", batch_id), self.refs)
            results = read(self._path("results", batch_id))
            counted = rows.groupBy("run_id").agg(F.count("*").alias("n"))
            catalogue = catalogue_of(spark, self.chosen)
            context = context_of(catalogue.coalesce(1) if little else catalogue)
            left_out = spark.createDataFrame(self.waiting + raised, "test_id string, reason string").coalesce(1)
            steps += [
                start(lambda: store(amend_maps(rows, results, self.runnable, ["run_id"]), "amended")),
                start(lambda: store(run_summary(results, keys=["run_id"], records=counted), "summary")),
                start(lambda: store(curated(results, context, CURATED_ROWS, keys=["run_id"]), "curated")),
                start(lambda: store(left_out, "left_out"))]
            total = outcome.result().agg(F.count("*").alias("messages"), F.count_if(F.col("reason") == PROCESSED).alias("processed"))
            commit = total.select(F.array(*[F.lit(t) for t in TABLES]).alias("tables"), "messages", "processed")
            for step in steps:
                step.result()
            commit.write.mode("overwrite").parquet(self._path("commits", batch_id))

    def _outcomes(self, messages: DataFrame, parsed: DataFrame, bad: Column, top: Column) -> DataFrame:
        has = [F.map_contains_key("values", F.lit(c)) for c in ("dwc:occurrenceID", "dwc:taxonID")]
        applies = F.lit(False)
        for keys in {r.columns for r in self.runnable}:
            applies = applies | reduce(lambda a, b: a & b, [F.map_contains_key("values", F.lit(k)) for k in keys])
        per_run = parsed.groupBy("run_id").agg(
            F.count("values").alias("n"), F.bool_or(F.coalesce(has[0] | has[1], F.lit(False))).alias("core"),
            F.bool_or(F.coalesce(applies, F.lit(False))).alias("applies"), F.max(F.when(F.col("line") < 0, F.col("problem"))).alias("error"))
        reason = (
            F.when(bad, F.concat(F.lit("invalid JSON: "), F.col(CORRUPT)))
            .when(~top, "reply")
            .when(~F.coalesce(F.size("attachments") > 0, F.lit(False)), "no attachment")
            .when(F.col("content").isNull(), "no readable table")
            .when(F.col("error").isNotNull(), F.concat(F.lit("failed: "), F.col("error")))
            .when(F.coalesce("n", F.lit(0)) == 0, "no rows")
            .when(~F.col("applies"), F.when(F.col("core"), "no rule applies").otherwise("no identifier column"))
            .otherwise(PROCESSED)
        )
        return messages.join(per_run, "run_id", "left").withColumn("reason", reason).select("run_id", *_REASON)


def process_batch(out: str, rules: Iterable[Rule], refs: References | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that does a whole run for every submission of a micro-batch, all together.

    Writes below ``out``, each in the folder of its batch and with ``run_id`` (the message id) as leading key: ``parsed`` (the original rows), ``results``,
    ``amended`` (all rows after the amendments), ``summary`` (one row for each run), ``curated`` (first rows of each run with the texts of their
    test), ``no_attachment``, ``dead_letter``, ``rejected`` (rows of tables that could not be taken), ``left_out`` (rules that were not run: their reference table
    is not given, or they raised) and ``outcome`` with one row for every message: processed, reply, no attachment, unreadable, no identifier, no
    rule that applies, or failed. ``commits`` is written last; :func:`committed` reads only batches that are there, so a batch is seen whole or not at
    all. A batch that is committed is not run again; one that is not replaces its own folders.
    """
    batches = Batches(out, rules, refs)

    def run(batch: DataFrame, batch_id: int) -> None:
        if not is_committed(batch.sparkSession, out, batch_id):
            batches.finish(batch.sparkSession, batch_id, batches.take(batch, batch_id))

    return run


class RunsBeside:
    """:func:`process_batch` for a stream: the runs of one batch go on while the next one is taken; at most one batch is behind.

    An error of the runs stops the stream and is raised by :meth:`wait`. What was taken and not run then, or when the driver was lost, is run by
    :meth:`resume`.
    """

    def __init__(self, batches: Batches) -> None:
        self._batches = batches
        self._last: Future | None = None
        self.stop_stream: Callable[[], None] | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if is_committed(spark, self._batches.out, batch_id):
            return
        schema = self._batches.take(batch, batch_id)
        self.wait()
        pool = ThreadPoolExecutor(1)
        self._last = pool.submit(self._batches.finish, spark, batch_id, schema)
        self._last.add_done_callback(self._ended)
        pool.shutdown(wait=False)  # its thread ends with the runs

    def _ended(self, runs: Future) -> None:
        if runs.exception() is not None and self.stop_stream is not None:
            self.stop_stream()

    def wait(self) -> None:
        """Until the runs of every batch that was taken have ended."""
        if self._last is not None:
            self._last.result()

    def resume(self, spark: SparkSession, checkpoint: str) -> None:
        """The runs of batches that the stream has done with and that are not committed."""
        out = self._batches.out
        stored, done = (_read_if_there(spark, f"{out}/{name}", schema) for name, schema in (("intake", "messageId string, batch_id int"), ("commits", COMMIT)))
        if stored is None:
            return
        ids = stored.select("batch_id").distinct()
        for row in sorted((ids if done is None else ids.join(done, "batch_id", "left_anti")).collect()):
            if _is_there(spark, f"{checkpoint}/commits/{row.batch_id}"):
                self._batches.finish(spark, row.batch_id)


class Intake(StreamingQuery):
    """A running intake; :meth:`awaitTermination` returns when its runs have ended too."""

    def __init__(self, query: StreamingQuery, runs: RunsBeside) -> None:
        super().__init__(query._jsq)
        self._runs, runs.stop_stream = runs, query.stop

    def awaitTermination(self, timeout: int | None = None) -> bool | None:
        ended = super().awaitTermination(timeout)
        if ended is not False:
            self._runs.wait()
        return ended

    def stop(self) -> None:
        super().stop()
        self._runs.wait()


def _is_there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def _read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table at ``path``; None if there is no such folder. Any other error is one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def is_committed(spark: SparkSession, out: str, batch_id: int) -> bool:
    found = _read_if_there(spark, f"{out}/commits/batch_id={batch_id}", "messages bigint")
    return found is not None and not found.isEmpty()


def committed(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of the intake with ``batch_id``, as far as its batches are whole."""
    done = _read_if_there(spark, f"{out}/commits", COMMIT)
    stored = spark.read.parquet(f"{out}/{name}")
    return stored.where("false") if done is None else stored.join(F.broadcast(done.select("batch_id")), "batch_id", "left_semi")


def start_intake(stream: DataFrame, out: str, checkpoint: str, rules: Iterable[Rule], once: bool = False, refs: References | None = None) -> Intake:
    """Run the intake over each micro-batch. ``once`` handles what is there and stops.

    The runs of a batch go on while the next one is taken (:class:`RunsBeside`), so wait for the end with ``awaitTermination`` of what is returned.

    A batch opens and commits every partition of the state, and lists each of its files; both are dealt over the cores there are, not over as
    many tasks as a large shuffle would take. The session's own number of shuffle partitions holds for the runs themselves.
    """
    spark = stream.sparkSession
    runs = RunsBeside(Batches(out, rules, refs))
    runs.resume(spark, checkpoint)
    spark.conf.set(*STATE_STORE)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    few = str(_state_partitions(spark))
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", few)  # the source reads it from this session with each batch
    with _settings(spark, {"spark.sql.shuffle.partitions": few, "spark.sql.adaptive.coalescePartitions.initialPartitionNum": shuffles}):
        writer = once_per_thread(stream).writeStream.foreachBatch(runs).option("checkpointLocation", checkpoint)
        return Intake((writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL_INTERVAL)).start(), runs)
