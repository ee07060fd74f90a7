"""Requests: matching, identity, spans, warnings.

A request row has host, connection, seq, protocol, role, start, end, trace_id, span_id, parent_span_id, traceparent,
correlation_kind, confidence, service_name, method, status_code, attributes (array of key, value), pid, container_id, namespace, and
may have cgroup_id, peer_domain, peer_address, peer_port.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounds import ERROR_KEYS, bound_request_attributes
from ..functions.hashing import bounded_or_hash, request_ids
from ..functions.policy import selector
from ..functions.text import grpc_status, parse_traceparent, valid_span_id, valid_trace_id
from .common import dedup, in_order
from .running import running, sessions

#: Requests in flight on a connection, and nanoseconds until a request is given up.
IN_FLIGHT, TIMEOUT = 32, 30_000_000_000
#: Names of request spans by protocol.
SPAN_NAMES = {"http": "http request", "grpc": "grpc request", "kafka": "kafka request", "mongodb": "mongodb command", "mysql": "mysql query", "nats": "nats message", "postgresql": "postgresql query", "redis": "redis command", "websocket": "websocket frame"}
#: Keys of the attributes that say where a span's identity comes from.
PROVENANCE = {"role": "signalloom.capture.role", "context": "signalloom.trace.context.role", "source": "signalloom.trace.identity.source"}
FINGERPRINT = ("host", "protocol", "role", "start", "end", "trace_id", "span_id", "pid", "method", "status_code")


def _appended(first: Column, second: Column) -> Column:
    """Attributes of the request, then those of the response whose keys are new."""
    keys = F.transform(first, lambda a: a["key"])
    return F.concat(first, F.filter(second, lambda a: ~F.array_contains(keys, a["key"])))


def match_by_id(requests: DataFrame, responses: DataFrame, timeout: int = TIMEOUT) -> DataFrame:
    """Requests with their response by connection and correlation id (J8). No or several candidates within the timeout: no match, a row without end.

    Nothing is paired: read backwards in time, each response knows the one after it and each request the first one at or after it, which is all that counting up to two takes. So an
    id that is used again and again costs its rows, in slices.
    """
    keys = ("host", "connection", "correlation_id")
    known = " and ".join(f"{k} is not null" for k in keys)
    answers = running(responses.where(known).select(*keys, "ts", F.col("attributes").alias("theirs"), (-F.col("ts")).alias("back")), keys, ("back",), {"following": ("last", "ts")}, inclusive=False)
    asked = requests.select(*keys, "seq", "ts", "attributes", (-F.col("ts")).alias("back"), F.lit(1).alias("kind"))
    both = asked.unionByName(answers.select(*keys, "back", F.lit(0).alias("kind"), F.struct("ts", "theirs", "following").alias("answer")), allowMissingColumns=True)
    # at equal times an answer is met before the request, going backwards
    found = running(both, keys, ("back", "kind"), {"next": ("last", "answer")}).where("kind = 1")
    until = F.col("ts") + timeout
    one = F.coalesce((F.col("next.ts") <= until) & (F.col("next.following").isNull() | (F.col("next.following") > until)), F.lit(False)) & F.expr(known)
    empty = F.slice("attributes", 1, 0)
    return found.select(*keys, "seq", F.col("ts").alias("start"), F.when(one, F.col("next.ts")).alias("end"), _appended(F.col("attributes"), F.when(one, F.coalesce("next.theirs", empty)).otherwise(empty)).alias("attributes"))


def fifo(timeout: int, most: int, strict: bool = False):
    """The requests in flight on a connection: (queue of (seq, ts), feed). ``feed`` takes ts, kind and seq and returns (seq, start, end, response_seq, outcome) of what is done."""
    flying: deque = deque()

    def feed(ts, kind, seq):
        out = []
        if kind == 0 or strict:
            while flying and ts - flying[0][1] >= timeout:
                out.append((*flying.popleft(), None, None, "expired"))
        if kind == 0:
            if len(flying) >= most:
                out.append((*flying.popleft(), None, None, "overflow"))
            flying.append((seq, ts))
        else:
            for _ in range(len(flying) if kind == 2 else min(1, len(flying))):
                out.append((*flying.popleft(), ts, seq, "matched"))
        return out

    return flying, feed


def fifo_rows(requests: DataFrame, responses: DataFrame, answers_all: str | None = None) -> DataFrame:
    """Requests (kind 0), responses (1) and those that answer all (2) in one table: host, connection, ts, kind, seq."""
    kind = F.when(F.coalesce(F.col(answers_all), F.lit(False)), 2).otherwise(1) if answers_all else F.lit(1)
    return requests.select("host", "connection", "ts", F.lit(0).alias("kind"), "seq").unionByName(responses.select("host", "connection", "ts", kind.alias("kind"), "seq"))


def match_fifo(requests: DataFrame, responses: DataFrame, timeout: int = TIMEOUT, most: int = IN_FLIGHT, answers_all: str | None = None, strict: bool = False) -> DataFrame:
    """Requests of a connection with the response that answers them, in order (J8): host, connection, seq, start, end, response_seq, outcome.

    A response answers the oldest request in flight, or all of them where the Boolean column ``answers_all`` says so; without one
    in flight it is ignored. Before a new request those that have waited for ``timeout`` or longer are given up (``expired``), and with ``most``
    still in flight the oldest is (``overflow``). Requests that are never answered have no end; those left at the end are ``pending``. At equal times
    requests come before responses, then by seq. With ``strict`` a response doesn't find requests that have waited so long either.

    A connection is cut where a request comes at least ``timeout`` after the one before it: nothing is in flight there. Each piece is read in order by one
    task that holds ``most`` requests; what is in flight at the end of a piece is given up by the next one, if there is one.
    """
    both = fifo_rows(requests, responses, answers_all).withColumn("_asked", F.when(F.col("kind") == 0, F.col("ts")))
    cut = sessions(both, ("host", "connection"), ("ts", "kind", "seq"), "_asked", timeout, "piece", "pieces")
    pieces = cut.select("host", "connection", "piece", "ts", "kind", "seq", (F.col("piece") == F.col("pieces")).alias("last"))

    def begin():
        (flying, feed), left = fifo(timeout, most, strict), []

        def row(ts, kind, seq, last):
            left[:] = ["pending" if last else "expired"]
            return feed(ts, kind, seq)

        return row, lambda: [(*f, None, None, left[0]) for f in flying]

    return in_order(pieces, ("host", "connection", "piece"), ("ts", "kind", "seq"), begin, "host string, connection string, piece long, seq long, start long, end long, response_seq long, outcome string").drop("piece")


#: How a process shows that an agent in it exports traces already.
AGENT_ENVIRONMENT = ("JAVA_TOOL_OPTIONS", "JDK_JAVA_OPTIONS", "_JAVA_OPTIONS")
NODE_MODULE, JAVA_AGENT = "@opentelemetry/auto-instrumentations-node/register", "opentelemetry-javaagent"


def has_tracing_agent(environ: Column, argv: Column) -> Column:
    """Whether a process exports traces itself, from its environment (a map) and arguments."""

    def value(key: str) -> Column:
        return F.lower(F.trim(F.coalesce(environ[key], F.lit(""))))

    options = [F.coalesce(environ[k], F.lit("")) for k in AGENT_ENVIRONMENT]
    off_flags = ("-Dotel.sdk.disabled=true", "-Dotel.traces.exporter=none", "-Dotel.traces.sampler=always_off")
    off = value("OTEL_SDK_DISABLED").isin("true", "1") | (value("OTEL_TRACES_EXPORTER") == "none") | (value("OTEL_TRACES_SAMPLER") == "always_off") | value("OTEL_DOTNET_AUTO_TRACES_ENABLED").isin("false", "0")
    for o in options:
        for flag in off_flags:
            off = off | o.contains(flag)
    off = off | F.exists(argv, lambda a: a.isin(*off_flags))
    java = F.exists(argv, lambda a: a.contains("-javaagent:") & a.contains(JAVA_AGENT))
    for o in options:
        java = java | (o.contains("-javaagent:") & o.contains(JAVA_AGENT))
    node = F.coalesce(environ["NODE_OPTIONS"], F.lit("")).contains(NODE_MODULE) | F.exists(argv, lambda a: a.contains(NODE_MODULE))
    return ~off & (java | node)


def suppression(requests: DataFrame, processes: DataFrame | None, ownership: Sequence[tuple] = ()) -> DataFrame:
    """``requests`` with ``suppressed``: why no span is made, or null (P14): its labels say who owns tracing, or its process has an agent."""
    owned = selector(F.col("labels"), ownership) if ownership else F.lit(False)
    out = requests
    agent = F.lit(False)
    if processes is not None:
        known = processes.groupBy(F.col("host").alias("_h"), F.col("pid").alias("_p")).agg(F.max(has_tracing_agent(F.col("environ"), F.col("argv"))).alias("_agent"))
        out = out.join(known, (F.col("host") == F.col("_h")) & (F.col("pid") == F.col("_p")), "left").drop("_h", "_p")
        agent = F.coalesce("_agent", F.lit(False))
    return out.withColumn("suppressed", F.when(owned, "owned_by_label").when(agent, "tracing_agent")).drop("_agent")


def with_context(requests: DataFrame) -> DataFrame:
    """``requests`` with the observed context: valid ids, else the traceparent; ``context_warning`` if it is broken or missing."""
    parsed = parse_traceparent(F.col("traceparent"))
    own = valid_trace_id(F.col("trace_id")) & valid_span_id(F.col("span_id"))
    some = F.col("trace_id").isNotNull() | F.col("span_id").isNotNull()
    out = requests.withColumn("_tp", F.when(F.col("traceparent").isNotNull(), parsed))
    good = F.col("_tp").isNotNull() & F.col("_tp.reason").isNull()
    warning = F.when(own | good, None).when(some | F.col("traceparent").isNotNull(), "malformed_trace_context").otherwise("missing_trace_context")
    return out.withColumns({"seen_trace": F.when(own, F.col("trace_id")).when(good, F.col("_tp.trace_id")), "seen_span": F.when(own, F.col("span_id")).when(good, F.col("_tp.span_id")), "context_warning": warning}).drop("_tp")


def passes_through(requests: DataFrame) -> DataFrame:
    """``requests`` without client requests whose context is valid and observed: their caller reports them."""
    through = (F.col("role") == "client") & F.col("seen_trace").isNotNull() & F.col("context_warning").isNull() & (F.col("correlation_kind") != "generated_trace_context")
    return requests.where(~F.coalesce(through, F.lit(False)))


#: The attributes, in whatever order they come, of which the first names a request's target.
TARGET_KEYS = ("url.path", "http.route", "http.request.target", "db.operation.name")


def _identity_ids(requests: DataFrame, needed: Column) -> Column:
    """Generated ids (F5) from protocol, role, start, end, pid, cgroup, method, target, status and peer; null where not ``needed``."""

    def known(name: str, kind: str) -> Column:
        return F.col(name) if name in requests.columns else F.lit(None).cast(kind)

    def number(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("0"))

    fits = F.filter("attributes", lambda a: a["key"].isin(*TARGET_KEYS) & (F.octet_length(a["value"]) <= 256))
    head = F.concat_ws("|", F.initcap("protocol"), F.coalesce(F.concat(F.lit("Some("), F.initcap("role"), F.lit(")")), F.lit("None")), number(F.col("start")), number(F.col("end")), number(F.col("pid")), number(known("cgroup_id", "long")))
    peer = F.coalesce(known("peer_domain", "string"), known("peer_address", "string"))
    kind = F.when(known("peer_domain", "string").isNotNull(), "domain").when(peer.isNotNull(), "address")
    return request_ids(F.when(needed, head), F.col("method"), F.get(fits, 0)["value"], number(F.col("status_code")), kind, peer, F.coalesce(known("peer_port", "int").cast("string"), F.lit("unknown")))


def request_spans(requests: DataFrame, processes: DataFrame | None = None, ownership: Sequence[tuple] = ()) -> DataFrame:
    """Spans (D4): suppression, client pass-through, dedup, then identity.

    Without an observed context the ids are generated. A server's span is a child of the span on the wire. Attributes are bounded.
    """
    live = passes_through(with_context(suppression(requests, processes, ownership).where("suppressed is null")))
    seen, server = F.col("seen_trace").isNotNull(), F.col("role") == "server"
    one = dedup(live, FINGERPRINT, ("seq",))
    # a request whose span is on the wire needs no ids of its own
    one = one.withColumn("_ids", _identity_ids(one, ~seen | F.coalesce(server, F.lit(False))))
    synthetic = F.col("correlation_kind") == "synthetic"
    attributes = bound_request_attributes(F.col("attributes"))

    def provide(kept: Column, when: Column, key: str, value) -> Column:
        one_ = F.array(F.struct(F.lit(PROVENANCE[key]).alias("key"), value.alias("value")))
        return F.when(when, F.concat(F.slice(kept, 1, 7), one_)).otherwise(kept)

    attributes = provide(attributes, F.col("role").isNotNull(), "role", F.col("role"))
    attributes = provide(attributes, server & seen, "context", F.lit("remote_parent"))
    attributes = provide(attributes, ~seen, "source", F.lit("generated"))
    return one.select(
        "host", "seq", F.coalesce(*[F.when(F.col("protocol") == k, v) for k, v in SPAN_NAMES.items()], F.lit("protocol request")).alias("name"), "protocol", "role",
        F.coalesce("seen_trace", "_ids.trace_id").alias("trace_id"),
        F.when(seen & ~F.coalesce(server, F.lit(False)), F.col("seen_span")).otherwise(F.col("_ids.span_id")).alias("span_id"),
        F.when(seen & server, F.col("seen_span")).otherwise(F.col("parent_span_id")).alias("parent_span_id"), "start", "end",
        F.when(synthetic, "synthetic").when(seen, "observed_trace_context").otherwise("generated_trace_context").alias("correlation_kind"),
        F.when(synthetic, F.col("confidence")).otherwise("high").alias("confidence"),
        bounded_or_hash(F.col("service_name"), 253).alias("service_name"), bounded_or_hash(F.col("method"), 128).alias("method"), "status_code", "pid", "container_id", "namespace", attributes.alias("attributes"),
    )


def request_warnings(requests: DataFrame, processes: DataFrame | None = None, ownership: Sequence[tuple] = ()) -> DataFrame:
    """Warnings (D5): suppressed requests, missing or broken context, missing attribution; once for each type, protocol, pid and time."""
    marked = with_context(suppression(requests, processes, ownership))
    kinds = F.filter(
        F.array(
            F.when(F.col("suppressed").isNotNull(), F.concat(F.lit("suppressed_"), F.col("suppressed"))),
            F.when(F.col("suppressed").isNull(), F.col("context_warning")),
            F.when(F.col("suppressed").isNull() & F.col("container_id").isNull() & F.col("namespace").isNull(), F.lit("missing_attribution")),
        ),
        lambda x: x.isNotNull(),
    )
    rows = marked.select(F.explode(kinds).alias("warning"), "host", "protocol", "pid", F.col("start").alias("ts"))
    return dedup(rows, ("warning", "host", "protocol", "pid", "ts"))


def status_message(protocol: Column, status_code: Column, attributes: Column) -> Column:
    """The error message of a span, or null."""

    def valid(v: Column) -> Column:
        return (v != "") & (F.octet_length(v) <= 256) & ~v.rlike(r"[\x00-\x1f\x7f]")

    def bad(a: Column) -> Column:
        k, v = a["key"], a["value"]
        return valid(v) & (
            ((k == "http.response.status_code") & (F.coalesce(v.try_cast("int"), F.lit(0)) >= 400)) | ((k == "rpc.grpc.status_code") & (v != "0")) | ((k == "db.response.status_code") & ~v.isin("OK", "1"))
            | ((k == "messaging.kafka.response.error_code") & (v != "0")) | ((k == "messaging.nats.status_code") & (F.upper(v) == "ERR"))
        )

    named = F.get(F.filter(attributes, lambda a: (a["key"] == ERROR_KEYS[0])), 0)["value"]
    return (
        F.when((protocol == "http") & (status_code >= 400), F.concat(F.lit("HTTP status code "), status_code.cast("string")))
        .when((protocol == "grpc") & (status_code != 0), F.concat(F.lit("gRPC status code "), status_code.cast("string"), F.lit(" ("), grpc_status(status_code), F.lit(")")))
        .otherwise(F.coalesce(F.when(valid(named), named), F.get(F.filter(attributes, bad), 0)["value"]))
    )
