from __future__ import annotations

import json
import threading

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_sources import attachment, encode
from test_sources import message as plain_message

from plumbline.operators.lookups import References
from plumbline.rules import base as B
from plumbline.rules.dwc import REGISTRY
from plumbline.rules.registry import Registry
from plumbline.streaming import intake, running

RULES = REGISTRY.select("VALIDATION_COUNTRYCODE_NOTEMPTY", "VALIDATION_COUNTRY_NOTEMPTY", "VALIDATION_TAXONRANK_STANDARD")


def message(i, attachments, thread=None, **more):
    """A message in a thread of its own."""
    return plain_message(i, attachments, thread or f"t{i}", **more)


def test_intake_once_only_with_restart(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()

    def drop(name, m):
        (inbox / f"{name}.json").write_text(m if isinstance(m, str) else json.dumps(m, indent=1))

    table = encode("occurrenceID,country,countryCode\n1,France,FR\n2,France,NA\n")
    drop("a", message(1, [attachment("t.csv", "", table)]))
    drop("b", message(1, [attachment("t.csv", "", table)]))  # the same message again
    drop("c", message(2, []))
    drop("d", message(3, [attachment("bad.csv", "", "A")]))
    drop("e", message(4, [attachment("t.csv", "", table)], reply="<x>"))
    drop("f", "{broken")

    def run():
        intake.start_intake(intake.stream_submissions(spark, str(inbox)), out, state, RULES, once=True).awaitTermination()

    def counts():
        rows = spark.read.parquet(f"{out}/results").collect()
        return sorted((r["run_id"], r["test_id"], r["result"], r["count"]) for r in rows)

    run()
    first = [("m1", "VALIDATION_COUNTRYCODE_NOTEMPTY", "COMPLIANT", 1), ("m1", "VALIDATION_COUNTRYCODE_NOTEMPTY", "NOT_COMPLIANT", 1),
             ("m1", "VALIDATION_COUNTRY_NOTEMPTY", "COMPLIANT", 1), ("m1", "VALIDATION_COUNTRY_NOTEMPTY", "COMPLIANT", 1)]
    assert counts() == first
    assert [r["messageId"] for r in spark.read.parquet(f"{out}/no_attachment").collect()] == ["m2"]
    reasons = sorted(r["reason"] for r in spark.read.parquet(f"{out}/dead_letter").collect())
    assert len(reasons) == 2 and reasons[0].startswith("invalid JSON") and reasons[1] == "no readable table"

    run()  # nothing new: nothing is done twice
    assert counts() == first
    drop("g", message(5, [attachment("r.tsv", "", encode("taxonID\ttaxonRank\n1\tspecies\n"))]))
    drop("h", message(1, [attachment("t.csv", "", table)]))  # seen before the restart
    run()
    assert counts() == [*first, ("m5", "VALIDATION_TAXONRANK_STANDARD", "COMPLIANT", 1)]


def test_earliest_message_of_a_thread(spark):
    ddl = "messageId string, threadId string, receivedAt string, headers struct<inReplyTo:string,references:string>"
    df = spark.createDataFrame([("a", "t1", "1", (None, None)), ("b", "t1", "2", (None, "")), ("c", "t2", "1", ("x", None)), ("d", "t2", "2", (None, None))], ddl)
    assert {r["messageId"] for r in intake.top_level(df).collect()} == {"a", "b", "d"}
    assert {r["messageId"] for r in intake.top_level(df, per_thread=True).collect()} == {"a"}


def test_running_counts_and_late_rows(spark, tmp_path):
    src, out, state = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "state")
    ddl = "k string, t timestamp"

    def add(rows):
        spark.createDataFrame(rows, "k string, s string").selectExpr("k", "cast(s as timestamp) as t").coalesce(1).write.mode("append").parquet(str(src))

    def stream():
        return spark.readStream.schema(ddl).parquet(str(src))

    add([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00")])
    running.store_counts(stream(), ["k"], out, state).awaitTermination()
    add([("a", "2024-01-03 00:00:00"), ("c", "2024-01-03 00:00:00")])
    running.store_counts(stream(), ["k"], out, state).awaitTermination()
    assert {r["k"]: r["count"] for r in running.latest_counts(spark.read.parquet(out), ["k"]).collect()} == {"a": 3, "b": 1, "c": 1}

    timed = running.stream_combos(running.with_watermark(stream(), "t", "10 minutes"), ["k"], "t", "1 hour")
    sink, state2 = str(tmp_path / "sink"), str(tmp_path / "state2")

    def pump():
        q = timed.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", state2).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    pump()
    add([("a", "2024-01-01 00:10:00")])  # far behind the watermark by now
    assert running.late_rows(pump()) == 1


def test_intake_loses_no_message(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()

    def drop(name, m):
        (inbox / f"{name}.json").write_text(m if isinstance(m, str) else json.dumps(m, indent=1))

    def run():
        intake.start_intake(intake.stream_submissions(spark, str(inbox)), out, str(tmp_path / "state"), RULES, once=True).awaitTermination()

    good = [attachment("t.csv", "", encode("occurrenceID,country,countryCode\n1,France,FR\n"))]
    drop("a", message(1, good))
    drop("b", "{broken")
    drop("c", "{broken too")
    for name in "de":
        nameless = message(9, good)
        nameless["messageId"] = None if name == "d" else ""
        drop(name, nameless)
    drop("f", message(2, [attachment("t.csv", "", encode("foo,bar\n1,2\n"))]))
    drop("g", message(3, [attachment("t.csv", "", encode("occurrenceID,country,countryCode\n1,a,b,LOST\n2,France,FR\n"))]))
    drop("h", message(4, [attachment("t.csv", "", encode("occurrenceID,x\n1,2\n"))]))
    drop("i", message(5, [attachment("t.csv", "", encode("occurrenceID,country,countryCode\n1," + "x" * 200_000 + ",FR\n"))]))
    run()
    old = message(6, good)
    old["receivedAt"] = "2001-01-01T00:00:00Z"
    drop("j", old)
    drop("k", message(1, good))  # a repeat
    run()
    outcome = spark.read.parquet(f"{out}/outcome").collect()
    assert sorted((r.messageId or "", r.reason) for r in outcome) == [
        ("", "invalid JSON: {broken"), ("", "invalid JSON: {broken too"), ("", "processed"), ("", "processed"), ("m1", "processed"),
        ("m2", "no identifier column"), ("m3", "processed"), ("m4", "no rule applies"), ("m5", "processed"), ("m6", "processed")]
    assert ["LOST" in r.problem for r in spark.read.parquet(f"{out}/rejected").collect()] == [True]
    assert spark.read.parquet(f"{out}/results").select("run_id").distinct().count() == 6


def feed(spark, tmp_path, rules=RULES, refs=None):
    """(put a message into the inbox, run the intake over what is there, its output)."""
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()

    def drop(name, m):
        (inbox / f"{name}.json").write_text(json.dumps(m, indent=1))

    def run():
        query = intake.start_intake(intake.stream_submissions(spark, str(inbox)), out, str(tmp_path / "state"), rules, once=True, refs=refs)
        query.awaitTermination()
        return query
    return drop, run, out


def outcomes(spark, out):
    return sorted((r["messageId"], r["reason"]) for r in spark.read.parquet(f"{out}/outcome").collect())


def test_threads_and_ids_are_state_without_age(spark, tmp_path):
    good = [attachment("t.csv", "", encode("occurrenceID,country,countryCode\n1,France,FR\n"))]
    drop, run, out = feed(spark, tmp_path)
    drop("a", message(1, good, "t", at="2024-03-02T00:00:00Z"))
    drop("b", message(2, good, "t", at="2024-03-03T00:00:00Z"))  # in the same batch, later
    run()
    assert outcomes(spark, out) == [("m1", "processed"), ("m2", "reply")]
    drop("c", message(3, good, "t", at="2024-03-04T00:00:00Z"))  # later in a later batch
    drop("d", message(4, good, "u", at="2024-01-02T00:00:00Z"))  # sixty days old, another thread
    drop("e", message(1, good, "t", at="2024-03-02T00:00:00Z"))  # a repeat
    drop("f", message(5, good, "t", at="2024-01-01T00:00:00Z"))  # earlier than all of its thread
    drop("g", {**message(6, good), "threadId": None})
    drop("h", {**message(7, good), "threadId": ""})
    query = run()
    assert outcomes(spark, out) == [("m1", "processed"), ("m2", "reply"), ("m3", "reply"), ("m4", "processed"), ("m5", "processed"), ("m6", "processed"),
                                    ("m7", "processed")]
    states = {op["operatorName"]: op["numRowsTotal"] for op in query.recentProgress[-1]["stateOperators"]}
    assert states["dedupe"] == 7  # the state grows with ids; a batch reads only its own


def whole_run_rules():
    rules = Registry()
    rules.add(REGISTRY["VALIDATION_COUNTRY_NOTEMPTY"])
    rules.add(REGISTRY["VALIDATION_COUNTRY_FOUND"])
    rules.add(REGISTRY["AMENDMENT_COUNTRYCODE_STANDARDIZED"])
    rules.rule("VALIDATION_NUMBER", acted=["dwc:country"])(lambda v: B.verdict(v["dwc:country"].cast("int") > 0, "y", "n"))
    rules.rule("AMENDMENT_Z_LAST", "Amendment", acted=["dwc:countryCode"])(
        lambda v: F.when(v["dwc:countryCode"] == "usa", B.changed({"dwc:countryCode": F.lit("ZZ"), "dwc:missing": F.lit("x")}, "z")).otherwise(B.unchanged("same")))
    rules.add(REGISTRY["VALIDATION_SCIENTIFICNAME_FOUND"])
    return rules


def test_a_whole_run_for_each_submission(spark, refs, tmp_path):
    drop, run, out = feed(spark, tmp_path, whole_run_rules(), References(iso=refs.iso))
    drop("a", message(1, [attachment("t.csv", "", encode("occurrenceID,country,countryCode\n1,France,fr\n2,Nowhere,FR\n3,France,usa\n"))]))
    drop("b", message(2, [attachment("t.csv", "", encode("taxonID,country\n1,Canada\n"))]))
    drop("c", message(3, []))
    run()
    amended = {(r["run_id"], r["line"]): r["values"] for r in intake.committed(spark, out, "amended").collect()}
    assert {k: v.get("dwc:countryCode") for k, v in amended.items()} == {("m1", 0): "FR", ("m1", 1): "FR", ("m1", 2): "ZZ", ("m2", 0): None}
    assert all("dwc:missing" not in v for v in amended.values())
    summary = {r["run_id"]: r for r in intake.committed(spark, out, "summary").collect()}
    assert {k: (r["number_of_records_in_dataset"], r["no_of_tests_run"], r["no_of_non_compliant_validations"], r["no_of_amendments"]) for k, r in summary.items()} == {
        "m1": (3, 4, 1, 3), "m2": (1, 1, 0, 0)}  # m2 has no country code, which one of the two country tests consults
    found = {(r["run_id"], r["actedUpon"]): r["result"] for r in intake.committed(spark, out, "results").where("test_id = 'VALIDATION_COUNTRY_FOUND'").collect()}
    assert found[("m1", "dwc:country=Nowhere")] == "NOT_COMPLIANT" and found[("m2", "dwc:country=Canada")] == "COMPLIANT"
    curated = intake.committed(spark, out, "curated")
    assert {r["run_id"] for r in curated.collect()} == {"m1"} and curated.where("description = ''").count() <= curated.count()
    left = {r["test_id"]: r["reason"] for r in intake.committed(spark, out, "left_out").collect()}
    assert "backbone" in left["VALIDATION_SCIENTIFICNAME_FOUND"] and "CAST_INVALID_INPUT" in left["VALIDATION_NUMBER"] and len(left) == 2
    assert outcomes(spark, out) == [("m1", "processed"), ("m2", "processed"), ("m3", "no attachment")]


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    good = [attachment("t.csv", "", encode("occurrenceID,country,countryCode\n1,France,FR\n"))]
    messages = intake.parse_messages(spark.createDataFrame([(json.dumps(message(i, good)),) for i in (1, 2)], "value string"))
    out = str(tmp_path / "out")
    monkeypatch.setattr(intake, "curated", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        intake.process_batch(out, RULES)(messages, 0)
    assert intake.committed(spark, out, "results").count() == 0 and spark.read.parquet(f"{out}/results").count() > 0
    monkeypatch.undo()
    intake.process_batch(out, RULES)(messages, 0)
    once = intake.committed(spark, out, "results").count()
    assert once == spark.read.parquet(f"{out}/results").count() > 0
    intake.process_batch(out, RULES)(messages.where("false"), 0)  # committed: not run again
    assert intake.committed(spark, out, "results").count() == once
    intake.process_batch(out, RULES)(messages.where("false"), 1)
    assert intake.committed(spark, out, "outcome").count() == 2
    (tmp_path / "out" / "commits" / "batch_id=7").mkdir()
    (tmp_path / "out" / "commits" / "batch_id=7" / "part-0.parquet").write_text("no parquet")
    with pytest.raises((PySparkException, Py4JJavaError)):  # an unreadable store is not an empty one
        intake.is_committed(spark, out, 7)


def test_counts_in_a_base_and_deltas(spark, tmp_path, monkeypatch):
    out, cols = str(tmp_path / "out"), ["k"]
    step = running.count_batch(out, cols, "t", "1 hour", merge_every=3)
    want = {}
    for b in range(8):
        rows = [("a" if i % 2 else f"k{b}", f"2024-01-01 {b:02d}:{i:02d}:00") for i in range(6)]
        for k, _ in rows:
            want[k] = want.get(k, 0) + 1
        if b == 5:
            rows += [("late", "2024-01-01 00:00:00"), ("late", "2024-01-01 03:00:00"), ("fine", "2024-01-01 04:30:00"), (None, None)]
            want |= {"fine": 1, "": 1}
        batch = spark.createDataFrame(rows, "k string, s string").selectExpr("k", "cast(s as timestamp) as t")
        step(batch, b)
        if b in (1, 3):  # a repeated batch replaces itself, one that is in the base is left out
            step(batch, b)
        assert {r["k"]: r["count"] for r in running.current_counts(spark, out, cols, b).collect()} == want
        assert running.last_batch(spark, out) == b
        files = running._parts(spark, out, cols, b).inputFiles()
        assert len({f.rsplit("/", 2)[1] for f in files}) <= 4  # a base and three deltas at most
    assert sorted(str(r["t"]) for r in spark.read.parquet(f"{out}/late").collect()) == ["2024-01-01 00:00:00", "2024-01-01 03:00:00"]
    assert [r["late"] for r in spark.read.parquet(f"{out}/commits").orderBy("batch").collect()] == [0] * 5 + [2, 0, 0]


def test_intake_deals_its_state_over_the_cores(spark, tmp_path):
    from plumbline.plans import queries_reference as Q
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (10, "c")], "s_suppkey long, s_name string").coalesce(1).write.parquet(str(tmp_path / "d" / "supplier.parquet"))
    inbox = Q._inbox(spark, str(tmp_path / "d"))
    files = spark.read.format("binaryFile").load(inbox).selectExpr("substring_index(path, '/', -2) AS at", "decode(content, 'UTF-8') AS text").collect()
    assert len(files) == 6 and {r.at.split("/")[0] for r in files} == {inbox.rsplit("/", 1)[1]}  # no folder for each message
    assert sorted(r.text.count("\n") for r in files) == [1, 1, 1, 1, 2, 2] and sum(r.text == "{broken\n" for r in files) == 2

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out, state = str(tmp_path / "out"), tmp_path / "state"
        intake.start_intake(intake.stream_submissions(spark, inbox), out, str(state), RULES, once=True).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    most = max(intake.STATE_PARTITIONS, spark.sparkContext.defaultParallelism)
    assert 0 < len([p for p in (state / "state" / "0").iterdir() if p.name.isdigit()]) <= most
    assert sorted(r.reason.split(":")[0] for r in spark.read.parquet(f"{out}/outcome").collect()) == ["invalid JSON", "invalid JSON", "no attachment", "processed"]
    assert len(list((tmp_path / "out" / "results").rglob("*.parquet"))) <= most  # the runs of a batch are planned by what is there


def stored_tables(spark, out):
    """Rows of each table of an intake, as texts in order."""
    return {t: sorted(str(r) for r in intake.committed(spark, out, t).collect()) for t in intake.TABLES}


def test_a_small_batch_is_run_with_few_jobs(spark, tmp_path, monkeypatch):
    tables = ["occurrenceID,country,countryCode\n1,France,\n2,France,FR\n3,,FR\n", "taxonID,taxonRank\n1,species\n", "occurrenceID,country\n1,a,LOST\n", "x,y\n1,2\n"]
    sent = [message(i, [attachment("t.csv", "", encode(tables[i % 4]))] if i % 5 else [], reply="<x>" if i % 7 == 0 else None) for i in range(30)]
    rules = [*RULES, *whole_run_rules()]
    lines = [*(json.dumps(m) for m in sent), "{broken", json.dumps({**sent[1], "messageId": None})]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(str(tmp_path / "in"))
    messages = intake.parse_messages(spark.read.text(str(tmp_path / "in")))
    seen = {}
    for name, most in (("small", None), ("dealt", 0)):
        if most is not None:
            monkeypatch.setattr(intake, "ONE_TASK", most)
        spark.sparkContext.setJobGroup(f"batch {name}", "")
        try:
            intake.process_batch(str(tmp_path / name), rules)(messages, 0)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        seen[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"batch {name}"))
    assert stored_tables(spark, str(tmp_path / "small")) == stored_tables(spark, str(tmp_path / "dealt"))
    assert {r.reason for r in intake.committed(spark, str(tmp_path / "small"), "outcome").collect()} >= {"processed", "reply", "no attachment", "invalid JSON: {broken"}
    assert seen["small"] < 30 < seen["dealt"], seen


def test_runs_go_on_beside_the_next_poll(spark, tmp_path, monkeypatch):
    good = [attachment("t.csv", "", encode("occurrenceID,country,countryCode\n1,France,FR\n"))]
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    steps, lock, taken = [], threading.Lock(), threading.Event()
    take, finish = intake.Batches.take, intake.Batches.finish

    def noted(what, step, batch_id, *given):
        got = step(*given)
        with lock:
            steps.append((what, batch_id))
        return got

    def slow_finish(self, spark, batch_id, schema=None):
        assert batch_id or taken.wait(120)  # the first runs end only after the second poll is taken
        noted("run", finish, batch_id, self, spark, batch_id, schema)

    def noted_take(self, batch, batch_id):
        got = noted("taken", take, batch_id, self, batch, batch_id)
        if batch_id == 1:
            taken.set()
        return got

    def run():
        intake.start_intake(intake.stream_submissions(spark, str(inbox), max_files=1), out, state, RULES, once=True).awaitTermination()

    monkeypatch.setattr(intake.Batches, "finish", slow_finish)
    monkeypatch.setattr(intake.Batches, "take", noted_take)
    for i in range(3):
        (inbox / f"{i}.json").write_text(json.dumps(message(i, good), indent=1))
    run()
    assert steps.index(("taken", 1)) < steps.index(("run", 0)) < steps.index(("run", 1)) < steps.index(("run", 2)) and len(steps) == 6
    assert outcomes(spark, out) == [(f"m{i}", "processed") for i in range(3)]
    assert intake.committed(spark, out, "results").count() == spark.read.parquet(f"{out}/results").count() > 0

    (inbox / "3.json").write_text(json.dumps(message(3, good), indent=1))
    with monkeypatch.context() as m:
        m.setattr(intake, "curated", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):  # the error of the last runs is not lost with the stream's end
            run()
    assert intake.committed(spark, out, "outcome").count() == 3
    run()  # nothing new, but what was taken is run
    assert intake.committed(spark, out, "outcome").count() == 4 and steps[-1] == ("run", 3)
    before = len(steps)
    run()
    assert len(steps) == before


def test_failing_runs_stop_the_stream(spark, tmp_path, monkeypatch):
    drop, run, out = feed(spark, tmp_path)
    drop("a", message(1, [attachment("t.csv", "", encode("occurrenceID,country,countryCode\n1,France,FR\n"))]))
    with monkeypatch.context() as m:
        m.setattr(intake, "curated", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        query = intake.start_intake(intake.stream_submissions(spark, str(tmp_path / "in")), out, str(tmp_path / "state"), RULES)
        with pytest.raises(RuntimeError):  # though no other message comes
            query.awaitTermination(180)
        assert not query.isActive
    assert intake.committed(spark, out, "outcome").count() == 0
    run()
    assert outcomes(spark, out) == [("m1", "processed")] and intake.committed(spark, out, "curated").count() == spark.read.parquet(f"{out}/curated").count()
