"""Stream forms run over the provided tables: a file stream, read to its end, into a table in the shared folder."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import kinds, signals
from ..operators import peer, requests
from ..operators.common import shared_folder
from ..streaming import processors, state, streams, watch
from .adapters import adapt, oracle
from .registry import query


def _folder(spark) -> str:
    return shared_folder(spark, "stream")


def _events(spark, d) -> DataFrame:
    """Events as they come, with what the adapters derive row by row."""
    path = f"{d}/events.parquet"
    # a file stream reads folders: the table is picked out of its own
    raw = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(d)
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "purchase", "close").when(F.col("event_type") == "error", "failure").otherwise("snapshot")
    ts = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") * 1000
    return raw.select(F.col("event_id").alias("seq"), ts.alias("ts"), F.concat(F.lit("node-"), (F.col("user_id") % 4).cast("string")).alias("host"), F.col("user_id").alias("pid"), (k % 8).cast("int").alias("fd"),
        F.concat(F.lit("10.0."), (F.col("user_id") % 8).cast("string"), F.lit("."), (k % 16).cast("string")).alias("remote_address"), (8000 + k % 4).cast("int").alias("remote_port"), kind.alias("kind"), F.floor(F.col("value") * 100).cast("long").alias("cents"), k.alias("k"))


def _drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns the table it wrote."""
    spark, base = df.sparkSession, _folder(df.sparkSession)
    out = f"{base}/out"

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    with processors.with_rocksdb(spark):
        df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


#: Batches that the replayed streams come in, and files of each.
_BATCHES, _FILES = 3, 2


def _replayed(df: DataFrame, place: str, **late) -> DataFrame:
    """A table as a stream that comes in ``_BATCHES`` batches by the whole number ``place`` (a column), from a folder in the shared one; with ``late``, a row far behind the others comes last."""
    spark, path = df.sparkSession, f"{_folder(df.sparkSession)}/replay"
    low, high = df.agg(F.min(place), F.max(place)).first()
    width = (high or 0) - (low or 0) + 1
    for k in range(_BATCHES):
        part = df.where(F.floor((F.col(place) - (low or 0)) * _BATCHES / width) == k)
        part.repartition(_FILES, place).write.mode("append").parquet(path)
    if late:
        _late_row(df, late).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", _FILES).parquet(path)


def _event_table(spark, d) -> DataFrame:
    """The events of ``_events`` as a table."""
    return adapt(spark, d, "conn_raw").drop("bytes_sent", "bytes_received").join(adapt(spark, d, "ev").select("seq", "k"), "seq")


@query("t2_dedup_stream", oracle(["conn_raw"], "SELECT kind, host, pid, fd, count(DISTINCT remote_port) AS ports FROM conn_raw GROUP BY kind, host, pid, fd"))
def t2(spark, d):
    keys = ("kind", "host", "pid", "fd", "remote_port")
    return _drain(streams.dedup_stream(_events(spark, d).select(*keys, "ts"), keys, "3650 days").select(*keys)).groupBy("kind", "host", "pid", "fd").agg(F.count("remote_port").alias("ports"))


@query("t3_profile_windows", oracle(["conn_raw"], "SELECT host, kind, CAST(floor(ts / 3600000000000) AS BIGINT) AS hour, CAST(least(count(*), 64) AS BIGINT) AS observed, CAST(greatest(count(*) - 64, 0) AS BIGINT) AS dropped, least(count(DISTINCT pid), 64) AS distinct_stacks FROM conn_raw GROUP BY 1, 2, 3"))
def t3(spark, d):
    rows = _events(spark, d).select("seq", "ts", "host", "kind", F.lit(1).cast("long").alias("sample_count"), F.col("pid").cast("string").alias("stack_id"))
    out = _drain(streams.profile_windows(_with_late_row(rows, host=F.lit("late"), kind=F.lit("late"), stack_id=F.lit(""), sample_count=F.lit(1)), ["host", "kind"], "1 hour"))
    return out.where("host <> 'late'").select("host", "kind", F.floor(F.unix_seconds("window.start") / 3600).cast("long").alias("hour"), "observed", "dropped", "distinct_stacks")


_CYCLES = """c AS (SELECT c.*, e.k, CASE WHEN e.k % 4 > 0 THEN (e.k // 250) * 1000 END AS opened_at FROM conn_raw c JOIN ev e USING (seq) WHERE kind IN ('snapshot', 'close')),
  f AS (SELECT *, coalesce(last_value(opened_at IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), first_value(opened_at IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), -1) AS cycle FROM c WINDOW w AS (PARTITION BY host, pid, fd, remote_address, remote_port ORDER BY seq)),
  r AS (SELECT *, last_value(CASE WHEN kind = 'close' THEN ts END IGNORE NULLS) OVER w AS ended, count(CASE WHEN kind = 'close' THEN 1 END) OVER w AS run FROM f WINDOW w AS (PARTITION BY host, pid, fd, remote_address, remote_port, cycle ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  p AS (SELECT *, max(CASE WHEN ended IS NULL OR ts > ended THEN 1 ELSE 0 END) OVER (PARTITION BY host, pid, fd, remote_address, remote_port, cycle, run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS passes FROM r),
  n AS (SELECT *, lag(k) OVER (PARTITION BY host, pid, fd, remote_address, remote_port, cycle, run ORDER BY seq) AS was FROM p WHERE kind = 'close' OR passes = 1)
  SELECT seq, CASE WHEN was IS NULL OR k < was THEN k ELSE k - was END AS sent FROM n"""


@query("t4_flow_interval_stream", oracle(["conn_raw"], f"WITH {_CYCLES}"))
def t4(spark, d):
    """Several batches; a connection is used again and again, and its times don't follow its arrivals, so that snapshots come late."""
    k = F.col("k")
    rows = _event_table(spark, d).withColumns({"bytes_sent": k, "bytes_received": k, "opened_at": F.when(k % 4 > 0, F.floor(k / 250) * 1000)})
    return _drain(processors.flow_interval_stream(_replayed(rows, "seq"), None)).select("seq", "sent")


@query("t5_active_gauge_stream", oracle(["conn_raw"], "SELECT seq, CASE WHEN kind = 'open' THEN 1 ELSE -1 END AS delta FROM (SELECT *, lag(kind) OVER (PARTITION BY host, pid, fd, remote_address, remote_port ORDER BY ts, seq) AS was FROM conn_raw WHERE kind IN ('open', 'close')) WHERE CASE WHEN kind = 'open' THEN was IS DISTINCT FROM 'open' ELSE was = 'open' END"))
def t5(spark, d):
    """Several batches, in order of time."""
    return _drain(state.active_gauge_stream(_replayed(_event_table(spark, d), "ts"), None)).select("seq", "delta")


@query("t6_peer_stream", oracle(["conn_raw"], "WITH b AS (SELECT c.*, k % 3 AS n FROM conn_raw c JOIN ev USING (seq)), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY b.host, b.remote_address ORDER BY ts, seq) < 900000000000 THEN 0 ELSE 1 END AS fresh FROM b), s AS (SELECT *, sum(fresh) OVER (PARTITION BY host, remote_address ORDER BY ts, seq) AS sid FROM g) SELECT host, remote_address, CAST(sum(n) AS BIGINT) AS value FROM s GROUP BY host, remote_address, sid HAVING sum(n) > 0"))
def t6(spark, d):
    rows = _events(spark, d).select("seq", "ts", "host", "remote_address", (F.col("k") % 3).alias("bytes"))
    late = _with_late_row(rows, host=F.lit("late"), bytes=F.lit(1))
    return _drain(streams.peer_stream(late, ["host", "remote_address"])).where("host <> 'late'").select("host", "remote_address", "value")


#: A time after all events: rows at it pass the watermark, so that what waits for an answer or an end comes out.
_LATE = 4_102_444_800_000_000_000


def _late_row(rows: DataFrame, columns: dict) -> DataFrame:
    made = {"seq": F.lit(-1), "ts": F.lit(_LATE)} | columns
    return rows.sparkSession.range(1).select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])


def _with_late_row(rows: DataFrame, **columns) -> DataFrame:
    """A stream and one row far behind its last (with seq -1), which is filtered out of the results."""
    spark, path = rows.sparkSession, f"{_folder(rows.sparkSession)}/late"
    _late_row(rows, columns).write.parquet(path)
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(path))


_PEERS, _CAP = ("host", "remote_address"), 3
_NOBODY = "CAST([] AS STRUCT(a VARCHAR, e BIGINT, b BIGINT)[])"
_ADMITTED = f"""WITH RECURSIVE f AS (SELECT c.seq, c.host, c.remote_address, c.ts, e.k % 3 AS bytes, row_number() OVER (PARTITION BY c.host ORDER BY c.ts, c.seq) AS i FROM conn_raw c JOIN ev e USING (seq)),
  m AS (SELECT DISTINCT host, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, {_NOBODY} AS live, CAST(NULL AS BIGINT) AS born, CAST(NULL AS BIGINT) AS bytes, CAST(NULL AS VARCHAR) AS a FROM f
    UNION ALL SELECT host, i, seq, CASE WHEN here THEN list_transform(q, lambda x: CASE WHEN x.a = remote_address THEN struct_pack(a := x.a, e := greatest(x.e, ts), b := x.b) ELSE x END) WHEN bytes > 0 AND len(q) < {_CAP} THEN list_append(q, struct_pack(a := remote_address, e := ts, b := ts)) ELSE q END,
      CASE WHEN here THEN list_filter(q, lambda x: x.a = remote_address)[1].b WHEN bytes > 0 AND len(q) < {_CAP} THEN ts END, bytes, remote_address
    FROM (SELECT *, len(list_filter(q, lambda x: x.a = remote_address)) > 0 AS here FROM (SELECT f.*, list_filter(m.live, lambda x: f.ts - x.e < {peer.IDLE}) AS q FROM m JOIN f ON m.host = f.host AND f.i = m.i + 1)))"""
_PLACES = oracle(["conn_raw"], _ADMITTED.replace("WITH RECURSIVE ", "WITH ", 1)).replace("WITH ", "WITH RECURSIVE ", 1)


def _peer_flows(spark, d) -> DataFrame:
    return _event_table(spark, d).select("seq", "ts", "host", "remote_address", (F.col("k") % 3).alias("bytes"))


@query("a9_live_cap", _PLACES + " SELECT seq, born, born IS NULL AS overflow FROM m WHERE i > 0 AND (born IS NOT NULL OR bytes > 0)")
def a9_live(spark, d):
    """At most three series of a host are alive at a time; those that fall silent free their place."""
    return peer.admitted(_peer_flows(spark, d), _PEERS, ("host",), _CAP)[0].select("seq", "born", "overflow")


@query("t6_peer_cap_stream", _PLACES + " SELECT host, CASE WHEN born IS NOT NULL THEN a END AS remote_address, born, CAST(sum(bytes) AS BIGINT) AS value FROM m WHERE i > 0 AND (born IS NOT NULL OR bytes > 0) GROUP BY ALL")
def t6_cap(spark, d):
    """The same over several batches; the series alive are a table that each batch reads and writes anew."""
    base = _folder(spark)
    rows = _peer_flows(spark, d)
    put = streams.peer_cap(base, _PEERS, ("host",), _CAP)
    _replayed(rows, "ts").writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    out = spark.read.parquet(f"{base}/bytes")
    return out.groupBy("host", F.when(~F.col("overflow"), F.col("remote_address")).alias("remote_address"), "born").agg(F.sum("value").alias("value"))


#: Nanoseconds between arrivals, until a pending row is sent, and until a series is forgotten.
_STEP, _PENDING, _SILENT = 1_000_000, 150_000_000, 900_000_000
_GUARD = f"""m AS (SELECT seq, CAST(user_id AS STRING) AS series, (seq + 1) * {_STEP} AS arrived, (k % 3) * 7 + CAST(floor(seq / 400) AS BIGINT) AS ms FROM ev),
  l AS (SELECT *, sum(CASE WHEN was IS NULL OR arrived - was >= {_SILENT} THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY seq) AS life FROM (SELECT *, lag(arrived) OVER (PARTITION BY series ORDER BY seq) AS was FROM m)),
  f AS (SELECT *, max(ms) OVER (PARTITION BY series, life ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM l),
  g AS (SELECT *, arrived - lag(arrived) OVER (PARTITION BY series, life, ms ORDER BY seq) >= {_PENDING} AS gap FROM f WHERE top IS NULL OR ms >= top),
  h AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY series, life, ms ORDER BY seq) AS chain FROM g),
  o AS (SELECT series, max(seq) AS seq FROM h WHERE chain = 0 GROUP BY series, life, ms),
  n AS (SELECT series, count(*) FILTER (WHERE ms < top) AS dropped, count(*) FILTER (WHERE ms = top) AS suppressed FROM f GROUP BY series)
  SELECT series, seq, 0 AS dropped, 0 AS suppressed FROM o UNION ALL SELECT series, NULL, dropped, suppressed FROM n WHERE dropped + suppressed > 0"""


@query("t7_timestamp_guard_stream", oracle(["ev"], f"WITH {_GUARD}"))
def t7(spark, d):
    """Several batches; rows of a millisecond are spread over them."""
    rows = adapt(spark, d, "ev").select(F.col("user_id").cast("string").alias("series"), "seq", ((F.col("seq") + 1) * _STEP).alias("arrived"), (((F.col("k") % 3) * 7 + F.floor(F.col("seq") / 400)) * 1_000_000).alias("ts"))
    out = _drain(processors.timestamp_guard_stream(_replayed(rows, "seq", series=F.lit("late"), arrived=F.lit(_LATE)), _PENDING, _SILENT, "0 seconds")).where("series <> 'late'")
    return out.groupBy("series", "seq").agg(F.sum("dropped").alias("dropped"), F.sum("suppressed").alias("suppressed"))


@query("t8_match_requests_stream", oracle(["conn_raw"], "SELECT a.seq, b.ts IS NOT NULL AS answered FROM conn_raw a LEFT JOIN conn_raw b ON a.pid = b.pid AND a.seq = b.seq - 1 AND b.kind = 'close' AND b.ts >= a.ts AND b.ts <= a.ts + 3600000000000 WHERE a.kind = 'open'"))
def t8(spark, d):
    rows = _events(spark, d).withColumns({"connection": F.col("pid").cast("string"), "correlation_id": F.when(F.col("kind") == "open", F.col("seq")).otherwise(F.col("seq") - 1)})
    sides = [_with_late_row(rows.where(F.col("kind") == k), host=F.lit(f"late-{k}"), connection=F.lit("late"), correlation_id=F.lit(-1)) for k in ("open", "close")]
    out = _drain(streams.match_requests_stream(*sides, "1 hour"))
    return out.where("seq >= 0").select("seq", F.col("answered_at").isNotNull().alias("answered"))


_TURN, _MOST, _WAIT = "CASE (turn + conv_id) % 8 WHEN 3 THEN 1 WHEN 7 THEN 1 WHEN 5 THEN 2 ELSE 0 END", 2, 3_000_000
_EMPTY = "CAST(NULL AS BIGINT)"


def _given_up(items: str, why: str) -> str:
    return f"list_transform({items}, lambda x: struct_pack(seq := x.seq, e := {_EMPTY}, r := {_EMPTY}, why := '{why}'))"


_MATCHED = "lambda x: struct_pack(seq := x.seq, e := n.ts, r := n.seq, why := 'matched')"
_FIFO = f"""WITH RECURSIVE e AS (SELECT *, {_TURN} AS k, row_number() OVER (PARTITION BY connection ORDER BY ts, {_TURN}, seq) AS i FROM convs),
  m AS (SELECT DISTINCT connection, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(seq BIGINT, ts BIGINT)[]) AS q, CAST([] AS STRUCT(seq BIGINT, e BIGINT, r BIGINT, why VARCHAR)[]) AS done FROM e
    UNION ALL SELECT n.connection, n.i, CASE n.k WHEN 0 THEN list_append(n.live[greatest(len(n.live) - {_MOST - 2}, 1) :], struct_pack(seq := n.seq, ts := n.ts)) WHEN 1 THEN n.live[2:] ELSE [] END,
      {_given_up("n.q[: len(n.q) - len(n.live)]", "expired")} || CASE n.k WHEN 0 THEN {_given_up(f"n.live[: greatest(len(n.live) - {_MOST - 1}, 0)]", "overflow")} WHEN 1 THEN list_transform(n.live[:1], {_MATCHED}) ELSE list_transform(n.live, {_MATCHED}) END
    FROM (SELECT e.*, m.q, list_filter(m.q, lambda x: e.ts - x.ts < {_WAIT}) AS live FROM m JOIN e ON m.connection = e.connection AND e.i = m.i + 1) n),
  d AS (SELECT connection, unnest(done) AS u FROM m)
  SELECT a.host, a.connection, a.seq, a.ts AS start, d.u.e AS "end", d.u.r AS response_seq, coalesce(d.u.why, 'expired') AS outcome FROM e a LEFT JOIN d ON a.connection = d.connection AND a.seq = d.u.seq WHERE a.k = 0"""


@query("t8_match_fifo_stream", oracle(["convs"], _FIFO.replace("WITH RECURSIVE ", "WITH ", 1)).replace("WITH ", "WITH RECURSIVE ", 1))
def t8_fifo(spark, d):
    """Several batches that cut conversations; requests without an answer come out of the timer."""
    later = 1_000_000_000  # no time is 0, where watermarks begin
    rows = adapt(spark, d, "convs").withColumns({"k": F.expr(_TURN), "ts": F.col("ts") + later})
    both = requests.fifo_rows(rows.where("k = 0"), rows.where("k > 0").withColumn("all", F.col("k") == 2), "all").withColumn("_turn", F.col("seq") % 1000)
    # batches go by turn and not by time, so the watermark may not pass a row before the last of them
    return _drain(processors.match_fifo_stream(_replayed(both, "_turn", host=F.lit("late"), connection=F.lit("late"), kind=F.lit(0)), _WAIT, _MOST, "3650 days")).where("host <> 'late'").withColumns({"start": F.col("start") - later, "end": F.col("end") - later})


@query("t9_fan_out", oracle(["conn_raw"], "SELECT kind, count(*) AS n FROM conn_raw GROUP BY kind"))
def t9(spark, d):
    base = _folder(spark)

    def good(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("append").parquet(f"{base}/out")

    def bad(batch: DataFrame, epoch: int) -> None:
        raise RuntimeError("this sink is down")

    events = _events(spark, d).select("seq", "kind")
    events.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(streams.fan_out({"bad": bad, "good": good})).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{base}/out").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _chunks(spark, d) -> DataFrame:
    """Conversations as HTTP messages whose heads say the length: the stream of a connection is cut every 37 bytes, and at the ends of messages."""
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    head = F.concat(F.lit("POST /"), F.col("turn").cast("string"), F.lit(" HTTP/1.1\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"))
    made = rows.select("conv_id", "turn", F.concat(F.encode(head, "UTF-8"), text).alias("m")).withColumn("n", F.octet_length("m").cast("long"))
    at = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    cut = made.withColumn("at", at).withColumn("i", F.explode(F.sequence(F.floor(F.col("at") / 37), F.floor((F.col("at") + F.col("n") - 1) / 37))))
    low, high = F.greatest(F.col("i") * 37, F.col("at")), F.least(F.col("i") * 37 + 37, F.col("at") + F.col("n"))
    return cut.select(F.lit("h").alias("host"), F.col("conv_id").cast("string").alias("connection"), F.lit("in").alias("direction"), low.alias("offset"), (low + 1_000_000_000).alias("ts"), F.substring("m", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("data"))


def _messages(heads: DataFrame) -> DataFrame:
    return heads.select(F.col("connection").cast("long").alias("connection"), F.regexp_extract("head", "^POST /([0-9]+) ", 1).cast("long").alias("message"), F.regexp_extract("head", "Length: ([0-9]+)", 1).cast("long").alias("n"), "error")


@query("t10_http_heads", "SELECT conv_id AS connection, turn AS message, strlen(text) AS n, CAST(NULL AS VARCHAR) AS error FROM conversations")
def t10(spark, d):
    return _messages(state.http_heads(_chunks(spark, d)))


@query("t10_http_heads_stream", "SELECT conv_id AS connection, turn AS message, strlen(text) AS n, CAST(NULL AS VARCHAR) AS error FROM conversations")
def t10_stream(spark, d):
    """Chunks in no order over several batches."""
    chunks = _replayed(_chunks(spark, d).withColumn("_place", F.pmod(F.xxhash64("connection", "offset"), F.lit(64))), "_place").drop("_place")
    return _messages(_drain(processors.http_heads_stream(chunks)))


@query("t1_signal_stream", oracle(["conn_raw"], "SELECT remote_address, count(*) AS n FROM conn_raw WHERE kind = 'open' GROUP BY remote_address"))
def t1(spark, d):
    """A file stream in, counted."""
    return _drain(_events(spark, d).where("kind = 'open'").groupBy("remote_address").agg(F.count(F.lit(1)).alias("n")), "complete")


def _written_signals(spark, d) -> str:
    """Documents as exec signals in a folder, with some lines that fit nothing."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.where("doc_id % 5 > 0").select(F.col("source").alias("host"), F.col("doc_id").alias("pid"), F.lit("run").alias("command"), F.array("lang").alias("arguments"), F.col("doc_id").alias("timestamp_unix_nanos"))
    path = f"{_folder(spark)}/signals"
    signals.write_signals(signals.signal_lines(rows, "exec", "plans"), path)
    bad = F.when(F.col("doc_id") % 2 == 0, "not json").otherwise('{"schema_version":7,"kind":"exec","source":"plans","payload":{}}')
    docs.where("doc_id % 5 = 0").select(bad.alias("value")).write.text(f"{path}/kind=bad")
    return f"{path}/kind=*"


@query("s1_read_signals", "SELECT source AS host, doc_id AS pid, lang AS argument FROM documents WHERE doc_id % 5 > 0")
def s1(spark, d):
    tables, _ = signals.read_signals(spark, _written_signals(spark, d), ["exec"])
    return tables["exec"].select("host", "pid", F.col("arguments")[0].alias("argument"))


@query("s1_quarantine", "SELECT CASE WHEN doc_id % 2 = 0 THEN 'not_an_envelope' ELSE 'schema_version' END AS reason, count(*) AS n FROM documents WHERE doc_id % 5 = 0 GROUP BY 1")
def s1_bad(spark, d):
    _, quarantine = signals.read_signals(spark, _written_signals(spark, d), ["exec"])
    return quarantine.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _made(kind: str, n, k: int = 0):
    """A value for a field of a payload, from a number."""
    if kind in kinds.WORDS:
        words = kinds.WORDS[kind].split()
        return F.get(F.array(*map(F.lit, words)), F.pmod(n + k, F.lit(len(words))).cast("int"))
    if kind in ("attributes", "frames"):
        return F.array(_made(kind[:-1], n, k), _made(kind[:-1], n + 1, k))
    if kind in kinds.PARTS:
        return F.struct(*[_filled(f, n, i).alias(f.name) for i, f in enumerate(kinds.fields_of(kinds.PARTS[kind]), k)])
    text = F.concat(F.lit(f"s{k}-"), n.cast("string"))
    plain = {"long": (n + k).cast("long"), "int": (F.pmod(n, F.lit(1000)) + k).cast("int"), "double": n + 0.5, "string": text, "boolean": n % 2 == 0, "strings": F.array(text), "map": F.create_map(F.lit("app"), text)}
    return plain[kind]


def _filled(f: kinds.Field, n, k: int):
    """A field; one that needn't be there is missing for a third of the numbers."""
    made = _made(f.kind, n, k)
    return made if f.needed else F.when(F.pmod(n + k, F.lit(3)) > 0, made)


def _every_kind(spark, d) -> dict[str, DataFrame]:
    """A table for each kind of signal: document k has the kind k % 44."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    n = F.col("doc_id")
    tables = {}
    for k, kind in enumerate(kinds.KINDS):
        fields = [_filled(f, n, i).cast(kinds.sql_type(f.kind)).alias(f.name) for i, f in enumerate(kinds.fields_of(kinds.KINDS[kind]))]
        tables[kind] = docs.where(n % len(kinds.KINDS) == k).select(n.cast("string").alias("host"), *fields)
    return tables


def _as_json(rows: DataFrame, kind: str) -> DataFrame:
    payload = F.to_json(F.struct(*[f.name for f in kinds.fields_of(kinds.KINDS[kind])]))
    return rows.select(F.lit(kind).alias("kind"), "host", payload.alias("payload"))


def _all_of(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@query("s1_every_kind", f"SELECT kind, count(*) AS n, count(*) AS same FROM (SELECT list_extract({list(kinds.KINDS)}, CAST(doc_id % {len(kinds.KINDS)} + 1 AS BIGINT)) AS kind FROM documents) GROUP BY kind")
def s1_every(spark, d):
    """Rows of every kind to lines and back: parsed once in a stream that deals them to tables; how many come back, and how many as they were."""
    base, tables = _folder(spark), _every_kind(spark, d)
    _all_of(signals.signal_lines(t, k, "plans") for k, t in tables.items()).select(F.col("line").alias("value")).coalesce(8).write.text(f"{base}/lines")
    signals.read_lines(spark, f"{base}/lines", streaming=True).writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(signals.dispatch(f"{base}/tables")).start().awaitTermination()
    back = _all_of(_as_json(signals.dispatched(spark, f"{base}/tables", k), k) for k in kinds.KINDS)
    sent = _all_of(_as_json(t, k) for k, t in tables.items()).select(F.col("kind").alias("k"), F.col("host").alias("h"), F.col("payload").alias("p"))
    met = back.join(sent, (back["kind"] == sent["k"]) & (back["host"] == sent["h"]), "left")
    return met.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("payload") == F.col("p"), 1)).alias("same"))


@query("t1_dispatch", """SELECT CASE doc_id % 6 WHEN 0 THEN 'not_an_envelope' WHEN 1 THEN 'unknown_kind' WHEN 2 THEN 'payload' WHEN 3 THEN 'schema_version' WHEN 4 THEN 'process_exit' ELSE 'dns_query' END AS place, count(*) AS n FROM documents GROUP BY 1""")
def t1_dispatch(spark, d):
    """Lines of two kinds, and of none, in several batches, of which the last is written twice."""
    base, n = _folder(spark), F.col("doc_id")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")

    def line(version: int, kind: str, payload):
        return F.to_json(F.struct(F.lit(version).alias("schema_version"), F.lit(kind).alias("kind"), F.lit("plans").alias("source"), payload.alias("payload")))

    def of(kind: str):
        return F.struct(*[_filled(f, n, i).alias(f.name) for i, f in enumerate(kinds.fields_of(kinds.KINDS[kind]))])

    value = F.when(n % 6 == 0, "{not json").when(n % 6 == 1, line(1, "other", of("exec"))).when(n % 6 == 2, line(1, "exec", F.struct(F.lit("x").alias("pid")))).when(n % 6 == 3, line(2, "exec", of("exec"))).when(n % 6 == 4, line(1, "process_exit", of("process_exit"))).otherwise(line(1, "dns_query", of("dns_query")))
    put = signals.dispatch(f"{base}/tables")

    def twice(batch: DataFrame, epoch: int) -> None:
        put(batch, epoch)
        put(batch, epoch)

    _replayed(docs.select("doc_id", value.alias("value")), "doc_id").select("value").writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(twice).start().awaitTermination()
    places = [signals.dispatched(spark, f"{base}/tables", "_quarantine").select(F.col("reason").alias("place"))]
    places += [signals.dispatched(spark, f"{base}/tables", k).select(F.lit(k).alias("place")) for k in ("process_exit", "dns_query")]
    return _all_of(places).groupBy("place").agg(F.count(F.lit(1)).alias("n"))


_WATCHED = "SELECT pod_name, CASE WHEN k % 8 = 2 THEN 'back' WHEN k % 7 = 0 THEN 'new' ELSE 'listed' END AS node_name FROM (SELECT *, CAST(container_id AS BIGINT) AS k FROM pods) WHERE (k % 5 < 4 OR k % 8 = 2 OR k % 7 = 0) AND (k % 8 = 2 OR k % 7 = 0 OR k % 8 <> 3)"


@query("s6_pod_watch_stream", oracle(["pods"], _WATCHED))
def s6_stream(spark, d):
    """Several batches: changes that an error makes void, a new list, then changes of which some come late and some twice."""
    pods = adapt(spark, d, "pods").withColumn("k", F.col("container_id").cast("long")).select("k", "namespace", "pod_name", "pod_uid", "node_name")
    k, base = F.col("k"), _folder(spark)
    # places and versions lie farther apart than any two pods' numbers
    step = 1 << 40

    def events(place: int, seq, type_: str, node: str, where) -> DataFrame:
        return pods.where(where).select((F.lit(place * step) + k).alias("place"), seq.alias("seq"), F.lit(type_).alias("type"), "namespace", "pod_name", "pod_uid", F.lit(node).alias("node_name"))

    error = spark.range(1).select(F.lit(step * 3 // 2).alias("place"), F.lit(step * 3 // 2).cast("long").alias("seq"), F.lit("ERROR").alias("type"), *[F.lit(None).cast("string").alias(c) for c in ("namespace", "pod_name", "pod_uid", "node_name")])
    log = _all_of([
        events(0, k, "MODIFIED", "void", F.lit(True)), events(1, step + k, "DELETED", "void", k % 2 == 0), error,
        events(1, 2 * step + k, "DELETED", "gone", k % 8 == 3), events(2, 3 * step + k, "ADDED", "back", k % 8 == 2), events(2, 3 * step + k, "ADDED", "new", (k % 7 == 0) & (k % 8 != 2)),
        events(2, step * 5 // 2 + k, "MODIFIED", "late", k % 8 == 2), events(2, step * 19 // 10 + k, "MODIFIED", "late", (k % 8 == 3) & (k % 7 != 0)), events(2, 3 * step + k, "BOOKMARK", "none", k % 8 == 5),
    ])
    put = watch.pod_watch(base, lambda: pods.where(k % 5 < 4).withColumn("node_name", F.lit("listed")).drop("k"), keep=10 * step)

    def twice(batch: DataFrame, epoch: int) -> None:
        put(batch.drop("place"), epoch)
        put(batch.drop("place"), epoch)

    _replayed(log, "place").writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(twice).start().awaitTermination()
    return watch.watched_pods(spark, base).select("pod_name", "node_name")
