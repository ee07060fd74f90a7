"""Edge rules on literal rows."""


from signalloom.operators import network, peer, profiling
from signalloom.sources import prometheus, signals

CONN = "seq long, ts long, kind string, host string, pid long, fd int, protocol string, address_family string, remote_address string, remote_port int, container_id string, namespace string, pod_name string, pod_uid string, container_name string, bytes_sent long, bytes_received long"


def conn(spark, *rows):
    return spark.createDataFrame([(k, ts, kind, "h", 1, fd, "tcp", "ipv4", "10.0.0.1", 80, "c", ns, "p", "u", "m", sent, 0) for k, (ts, kind, fd, ns, sent) in enumerate(rows)], CONN)


def test_snapshots_then_close(spark):
    rows = conn(spark, (1, "snapshot", 3, "n", 10), (2, "snapshot", 3, "n", 25), (3, "close", 3, "n", 30), (4, "snapshot", 3, "n", 5))
    assert [r.sent for r in network.flow_intervals(rows).orderBy("seq").collect()] == [10, 15, 5, 5]


def test_reset_and_missing_fd(spark):
    rows = conn(spark, (1, "snapshot", 3, "n", 10), (2, "snapshot", 3, "n", 4), (3, "snapshot", None, "n", 9), (4, "close", None, "n", 7))
    assert {(r.seq, r.sent) for r in network.flow_intervals(rows).collect()} == {(0, 10), (1, 4), (3, 7)}


def test_without_pod_no_summary_but_warning(spark):
    rows = network.flow_intervals(conn(spark, (1, "snapshot", 3, None, 10)))
    assert network.flow_summaries(rows).count() == 0
    assert [r.reason for r in network.flow_warnings(rows).collect()] == ["missing_pod"]


def test_active_alternates(spark):
    rows = conn(spark, (1, "open", 3, "n", 0), (2, "open", 3, "n", 0), (3, "close", 3, "n", 0), (4, "close", 3, "n", 0), (5, "open", None, "n", 0))
    assert [r.seq for r in network.active(rows).orderBy("seq").collect()] == [0, 2]


FLOW = ", ".join(f"{c} string" for c in peer.SERIES) + ", seq long, ts long, interval_start long, bytes long"


def flow(spark, *rows):
    return spark.createDataFrame([("h", "tcp", "ipv4", "egress", "a", name, "t", "b", "o", "t", k, ts, ts, n) for k, (name, ts, n) in enumerate(rows)], FLOW)


def test_overflow_keeps_bytes(spark):
    out = peer.peer_flow_bytes(flow(spark, ("x", 1, 5), ("y", 2, 7), ("z", 3, 9), ("x", 4, 1)), most=1).collect()
    assert {(r.source_owner_name, r.overflow, r.value) for r in out} == {("x", False, 6), ("__other__", True, 16)}


def test_idle_series_begins_anew_and_zero_keeps_alive(spark):
    rows = flow(spark, ("x", 0, 5), ("x", peer.IDLE - 1, 0), ("x", 2 * peer.IDLE - 3, 1), ("x", 4 * peer.IDLE, 2), ("y", 0, 0))
    out = {(r.seq, r.session) for r in peer.peer_sessions(rows).collect()}
    assert out == {(0, 1), (1, 1), (2, 1), (3, 2)}


def test_stable_under_repartition(spark):
    rows = conn(spark, *[(k, ("open", "snapshot", "close")[k % 3], k % 4, "n", k * 7 % 23) for k in range(60)])
    want = sorted(map(tuple, network.flow_intervals(rows.repartition(1)).select("seq", "sent").collect()))
    assert sorted(map(tuple, network.flow_intervals(rows.repartition(17)).select("seq", "sent").collect())) == want


def test_kernel_symbols(spark):
    symbols = spark.createDataFrame([("h", 0, "zero"), ("h", 100, "a"), ("h", 200, "b")], "host string, address long, name string")
    frames = spark.createDataFrame([("h", 50), ("h", 150), ("h", 200), ("h", 201)], "host string, ip long")
    assert {(r.ip, r.function) for r in profiling.resolve_kernel(frames, symbols).collect()} == {(50, None), (150, "a"), (200, "b"), (201, None)}


def test_the_cap_with_idle_series(spark):
    """One series at a time: y finds no place, z does once x has been silent; bytes over the cap are kept."""
    rows = flow(spark, ("x", 1, 5), ("y", 2, 7), ("x", 3, 2), ("z", 20, 9), ("z", 21, 1))
    got = {(r.source_owner_name, r.born, r.overflow, r.value) for r in peer.peer_flow_bytes(rows, most=1, idle=10).collect()}
    assert got == {("x", 1, False, 7), (peer.OTHER, None, True, 7), ("z", 20, False, 10)}


def test_prometheus_lines(spark):
    lines = spark.createDataFrame([("# HELP x", 0), ('x{a="1,\\"2",b="z"} 5', 1), ("y 1", 2), ("y 2", 3), ("y NaN", 4), ("bad line here x", 5)], "line string, line_no long")
    got = {(r.name, tuple(sorted(r.labels.items())), r.value) for r in prometheus.parse_prometheus(lines).collect()}
    assert got == {("x", (("a", '1,"2'), ("b", "z")), 5.0), ("y", (), 2.0)}


def test_signals_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("h", 1, "sh", ["sh", "--token", "abc"], 5)], "host string, pid long, command string, arguments array<string>, timestamp_unix_nanos long")
    path = str(tmp_path / "signals")
    signals.write_signals(signals.signal_lines(rows, "exec", "t"), path)
    bad = tmp_path / "signals" / "kind=bad"
    bad.mkdir()
    (bad / "x.txt").write_text('{"schema_version":9,"kind":"exec","source":"t","payload":{}}\nnot json\n{"schema_version":1,"kind":"nothing","source":"t","payload":{}}\n{"schema_version":1,"kind":"exec","source":"t","payload":{"pid":"x"}}\n')
    tables, quarantine = signals.read_signals(spark, f"{path}/kind=*", ["exec"])
    assert [(r.pid, r.arguments) for r in tables["exec"].collect()] == [(1, ["sh", "--token", "<redacted>"])]
    assert sorted(r.reason for r in quarantine.collect()) == ["not_an_envelope", "payload", "schema_version", "unknown_kind"]
    assert signals.read_lines(spark, f"{path}/kind=exec", streaming=True).isStreaming


def test_plan_has_few_shuffles(spark):
    rows = conn(spark, (1, "open", 3, "n", 0))
    plan = network.open_counters(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2
