"""What fits a kind of signal and what doesn't; batches that are repeated or fail half-way."""

import json

import pytest

from signalloom.sources import signals
from signalloom.sources.kinds import KINDS

CPU = {"metric_name": "system.cpu.time", "unit": "ns", "timestamp_unix_nanos": 5, "window": {"start_unix_nanos": 1, "end_unix_nanos": 2}, "user_nanos": 1, "system_nanos": 2, "idle_nanos": 3, "iowait_nanos": 4, "steal_nanos": 5, "runnable_tasks": None}
SPAN = {"name": "n", "start_unix_nanos": 1, "correlation_kind": "synthetic", "confidence": "low", "attributes": [{"key": "a", "value": "b"}], "process": {"pid": 3, "command": "c"}}


def line(kind, payload, **more):
    return json.dumps({"schema_version": 1, "kind": kind, "source": "t", "host": "h", "payload": payload} | more)


GOOD = [line("node_cpu_observation", CPU), line("node_cpu_observation", CPU | {"new_field": [1]}), line("trace_span_observation", SPAN), line("trace_span_observation", {k: v for k, v in SPAN.items() if k != "process"})]
BAD = {
    "a field is missing": line("node_cpu_observation", {k: v for k, v in CPU.items() if k != "idle_nanos"}),
    "a field is null": line("node_cpu_observation", CPU | {"unit": None}),
    "a number is a text": line("node_cpu_observation", CPU | {"user_nanos": "1"}),
    "a text is a number": line("node_cpu_observation", CPU | {"unit": 7}),
    "an optional field has another type": line("node_cpu_observation", CPU | {"runnable_tasks": "many"}),
    "a field within is missing": line("node_cpu_observation", CPU | {"window": {"start_unix_nanos": 1}}),
    "a structure is a list": line("node_cpu_observation", CPU | {"window": [1, 2]}),
    "an unknown word": line("trace_span_observation", SPAN | {"confidence": "very"}),
    "an attribute without a value": line("trace_span_observation", SPAN | {"attributes": [{"key": "a"}]}),
    "a number that is too large": line("node_cpu_observation", CPU | {"user_nanos": 2**70}),
    "no object": line("node_cpu_observation", [1]),
}


def test_payloads(spark, tmp_path):
    (tmp_path / "x.txt").write_text("\n".join([*GOOD, *BAD.values()]))
    tables, quarantine = signals.read_signals(spark, f"file://{tmp_path}", ["node_cpu_observation", "trace_span_observation"])
    assert [t.count() for t in tables.values()] == [2, 2]
    assert sorted(r.line for r in quarantine.collect()) == sorted(BAD.values())
    assert {(r.source, r.host, r.user_nanos, r.window.end_unix_nanos, r.runnable_tasks) for r in tables["node_cpu_observation"].collect()} == {("t", "h", 1, 2, None)}


def test_there_are_44_kinds():
    assert len(KINDS) == 44


def test_a_batch_counts_once(spark, tmp_path):
    root = f"file://{tmp_path}/tables"
    first, second = (spark.createDataFrame([(x,) for x in rows], "value string") for rows in (GOOD + ["{"], GOOD[:1] + list(BAD.values())[:2]))
    put = signals.dispatch(root)
    put(first, 0)
    put(second, 1)
    put(second, 1)  # again, after all of it was written
    # a batch that has failed half-way: a table was written, the epoch isn't done
    second.selectExpr("value AS line", "'x' AS reason").write.parquet(f"{root}/_quarantine/epoch=2")
    assert signals.dispatched(spark, root, "node_cpu_observation").count() == 3
    assert signals.dispatched(spark, root, "trace_span_observation").count() == 2
    assert sorted(r.reason for r in signals.dispatched(spark, root, "_quarantine").collect()) == ["not_an_envelope", "payload", "payload"]
    assert signals.dispatched(spark, root, "exec").count() == 0


@pytest.mark.parametrize("value", ["", "null", "[]", "7", '{"kind": "exec"}', '{"schema_version": 1, "kind": "exec", "source": "t"}'])
def test_what_is_no_envelope(spark, value):
    assert signals.parsed(spark.createDataFrame([(value,)], "value string")).first()["reason"] == "not_an_envelope"
