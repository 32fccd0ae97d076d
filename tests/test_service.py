"""Approvals, session turns over table and stream, sinks that repeat and stop, the keyed store."""

import pytest
from pyspark.sql import functions as F

from tidemill.operators import approvals
from tidemill.plans import service
from tidemill.sources import sinks
from tidemill.streaming import turns

LOG = "order_id string, at int, kind string, session string, tool string, lines array<int>, refund long, approve boolean, status string"


def decided(spark, *entries, threshold=approvals.THRESHOLD):
    rows = [("O-1", k, e[0], *e[1:]) for k, e in enumerate(entries)]
    return [(r.outcome, r.number) for r in approvals.decide(spark.createDataFrame(rows, LOG), threshold).orderBy("at").collect()]


def status(s):
    return ("status", None, None, None, None, None, s)


def cancel(refund=108_200, session="a"):
    return ("ask", session, "cancel_order", None, refund, None, None)


def back(*lines, refund, session="a"):
    return ("ask", session, "request_return", list(lines), refund, None, None)


def decision(approve, tool="cancel_order", lines=None, session="a"):
    return ("decide", session, tool, lines, None, approve, None)


def test_a_large_refund_waits_and_is_asked_for_once(spark):
    assert decided(spark, status("preparing"), cancel(), cancel(), cancel(session="b"), cancel()) == [("changed", None), ("queued", 1), ("reused", 1), ("queued", 2), ("reused", 1)]
    assert decided(spark, status("preparing"), cancel(), threshold=200_000)[1] == ("executed", None)
    assert decided(spark, status("preparing"), cancel(99_999), cancel(99_999))[1:] == [("executed", None), ("refused", None)]


def test_approval_runs_the_write_and_is_decided_once(spark):
    found = decided(spark, status("preparing"), cancel(), decision(True), decision(True), decision(False), cancel())
    assert found[1:] == [("queued", 1), ("approved", 1), ("conflict", None), ("conflict", None), ("refused", None)]


def test_rejection_writes_nothing(spark):
    assert decided(spark, status("preparing"), cancel(), decision(False), cancel(), decision(True))[1:] == [("queued", 1), ("rejected", 1), ("queued", 2), ("approved", 2)]
    assert decided(spark, status("preparing"), decision(True)) == [("changed", None), ("conflict", None)]


def test_an_approval_that_comes_too_late_fails(spark):
    assert decided(spark, status("preparing"), cancel(), status("shipped"), decision(True), decision(True))[1:] == [("queued", 1), ("changed", None), ("failed", 1), ("conflict", None)]


def test_returns_of_one_order_add_up(spark):
    ret = lambda *lines: decision(True, "request_return", list(lines))
    found = decided(spark, status("delivered"), back(1, refund=90_400), back(2, refund=36_700), back(3, 2, refund=40_000), ret(2), ret(2, 3), back(1, refund=1))
    assert found[1:] == [("executed", None), ("queued", 1), ("queued", 2), ("approved", 1), ("failed", 2), ("refused", None)]
    both = approvals.decide(spark.createDataFrame([("O-1", k, *e) for k, e in enumerate([status("delivered"), back(2, 1, refund=150_000), back(1, 2, refund=150_000)])] + [("O-2", 9, *back(1, refund=200_000)), ("O-2", 1, *status("delivered"))], LOG))
    versions = {(r.order_id, r.number): (r.status, r.times, r.target) for r in approvals.approvals(both).collect()}
    assert versions == {("O-1", 1): ("pending", 2, "request_return 1,2"), ("O-2", 1): ("pending", 1, "request_return 1")}


def test_a_log_is_folded_entry_by_entry(spark):
    log = [status("delivered"), back(1, refund=60_000), back(2, refund=50_000), back(2, refund=50_000), decision(True, "request_return", [2]), back(3, refund=1), back(1, refund=1), decision(True, "request_return", [3])]
    entries = [(f"O-{o}", k, *e) for k, e in enumerate(log) for o in range(40)]
    expected = [("changed", None), ("executed", None), ("queued", 1), ("reused", 1), ("approved", 1), ("queued", 2), ("refused", None), ("approved", 2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        done = approvals.decide(spark.createDataFrame(entries, LOG))
        assert sorted((r.order_id, r.at, r.outcome, r.number) for r in done.collect()) == sorted((f"O-{o}", k, *e) for k, e in enumerate(expected) for o in range(40))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # No row holds the log of a whole order, in which every entry would copy all that was done before it.
    assert "collect_list" not in done._jdf.queryExecution().toString()


def test_entries_are_made_without_interpreted_lambdas(spark):
    log = service.approval_log(spark, "/root/testdata/sf0.001")
    assert "lambda" not in log._jdf.queryExecution().optimizedPlan().toString()
    assert log.filter("kind IS NULL OR at IS NULL").isEmpty() and log.filter("kind = 'status' AND at = 150 AND order_id % 5 > 0").isEmpty()
    assert log.filter("at = 0").count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_unknown_values_are_neither_equal_nor_unequal(spark):
    ret = lambda *lines: decision(None, "request_return", list(lines))
    assert decided(spark, status("delivered"), back(None, refund=1), back(2, refund=1), ret(2))[1:] == [("executed", None), ("executed", None), ("conflict", None)]
    found = decided(spark, status("delivered"), back(1, refund=200_000), back(1, refund=200_000, session=None), back(1, refund=200_000, session=None), decision(None, "request_return", [1]), back(1, refund=None))
    assert found[1:] == [("queued", 1), ("queued", 2), ("queued", 3), ("approved", 1), ("refused", None)]


def test_a_stream_of_turns_equals_the_table(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "conv_id long, turn long, role string, tool string"
    roles = ["user", "tool", "tool", "tool", "assistant"]
    rows = [(c, t, roles[(t + c) % 5], f"t{t % 2}" if roles[(t + c) % 5] == "tool" else None) for c in range(4) for t in range(23)]
    for part in (rows[:11], rows[11:40], rows[40:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "batches"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "batches"))
    for idle in (0, 600_000):
        q = turns.streamed(stream, 2, 3, idle).writeStream.outputMode("append").format("memory").queryName(f"turns{idle}").option("checkpointLocation", str(tmp_path / f"c{idle}")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        found = sorted(map(tuple, spark.table(f"turns{idle}").collect()))
        assert found == sorted(map(tuple, turns.turns(spark.createDataFrame(rows, schema), 2, 3).collect())) and {r[-1] for r in found} == {"asked", "called", "limited", "replied", "closed"}


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    write = sinks.batches(str(tmp_path / "run"))
    write(spark.range(5), 0)
    write(spark.range(5, 8), 1)
    write(spark.range(5, 8), 1)
    assert sorted((r.id, r.batch) for r in spark.read.parquet(str(tmp_path / "run")).collect()) == [(k, 0) for k in range(5)] + [(k, 1) for k in range(5, 8)]


def test_a_run_stops_after_three_failures_in_a_row(spark, tmp_path):
    states = ["ok", "infra_error", "infra_error", "ok", "infra_error", "infra_error", "infra_error", "ok"]
    for k, s in enumerate(states):
        spark.createDataFrame([(k, s)], "trial int, status string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    write = sinks.batches(str(tmp_path / "out"), sinks.stop_after(["trial"]))
    done = 0
    with pytest.raises(sinks.RunStopped):
        for k, s in enumerate(states):
            write(spark.createDataFrame([(k, s)], "trial int, status string"), k)
            done += 1
    assert done == 6 and spark.read.parquet(str(tmp_path / "out")).count() == 7
    stream = spark.readStream.schema("trial int, status string").json(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(sinks.batches(str(tmp_path / "all"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "all")).count() == len(states)


def test_audit_events_have_one_schema(spark):
    good = spark.createDataFrame([("s", "2026-09-14 00:00:00", "tool_call", ("cancel_order", True))], "session_id string, at string, kind string, payload struct<name:string,ok:boolean>").withColumn("extra", F.lit(1))
    row = sinks.audit_events(good)
    assert row.schema.names == sinks.AUDIT.names and row.first().payload == '{"name":"cancel_order","ok":true}'
    for bad in [(None, "2026-09-14", "reply", "{}"), ("s", None, "reply", "{}"), ("s", "2026-09-14", "dance", "{}"), ("s", "2026-09-14", None, "{}")]:
        with pytest.raises(Exception, match="no audit event"):
            sinks.audit_events(spark.createDataFrame([bad], "session_id string, at string, kind string, payload string")).collect()


def test_the_store_computes_what_it_lacks_once(spark, tmp_path):
    path, asked = str(tmp_path / "store"), []

    def compute(keys):
        asked.append(sorted(r.key for r in keys.collect()))
        return keys.select("key", F.upper("text").alias("said"))

    df = lambda *keys: spark.createDataFrame([(k, f"text {k}") for k in keys], "key string, text string")
    assert sinks.fill(df("a", "b", "a"), path, compute, 4) == 2
    assert sinks.fill(df("b", "a"), path, compute, 4) == 0
    assert sinks.fill(df("c", "a"), path, compute, 4) == 1
    assert asked == [["a", "b"], ["c"]]
    assert {r.key: r.said for r in sinks.lookup(df("a", "c", "z"), path, 4).collect()} == {"a": "TEXT A", "c": "TEXT C", "z": None}
