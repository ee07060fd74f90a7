"""Bounded text, names and addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that carry secrets, matched anywhere in a key whatever its case.
SENSITIVE = ("password", "passwd", "secret", "token", "authorization", "cookie", "api_key", "api-key", "apikey", "credential", "private_key", "jwt")
#: What resource metrics add to them.
SENSITIVE_RESOURCE = ("auth", "api-token")
#: Argument keys in the order in which they are looked for.
SENSITIVE_ARGUMENTS = ("authorization", "auth-token", "api-token", "api_key", "api-key", "apikey", "password", "passwd", "secret", "credential", "token")
#: Process names.
SHELLS = ("sh", "bash", "dash", "ash", "zsh", "ksh")
NETWORK_TOOLS = ("curl", "wget", "nc", "ncat", "netcat", "socat")
#: TCP states by number.
TCP_STATES = {1: "established", 2: "syn_sent", 3: "syn_recv", 4: "fin_wait1", 5: "fin_wait2", 6: "time_wait", 7: "close", 8: "close_wait", 9: "last_ack", 10: "listen", 11: "closing", 12: "new_syn_recv"}
#: gRPC status names by number.
GRPC_STATUS = ("ok", "cancelled", "unknown", "invalid_argument", "deadline_exceeded", "not_found", "already_exists", "permission_denied", "resource_exhausted", "failed_precondition", "aborted", "out_of_range", "unimplemented", "internal", "unavailable", "data_loss", "unauthenticated")


def truncate_utf8(value: Column, limit: int) -> Column:
    """At most ``limit`` bytes, cut between characters."""
    raw = F.encode(value, "UTF-8")

    def continues(k: int) -> Column:  # byte k (from 1) goes on with a character
        return F.substring(F.hex(F.substring(raw, k, 1)), 1, 1).isin("8", "9", "A", "B")

    # the longest prefix whose next byte begins a character; a character has four bytes at most
    choices = F.coalesce(*[F.when(~continues(k + 1), F.lit(k)) for k in range(limit, max(limit - 4, -1), -1)], F.lit(0))
    return F.when(F.octet_length(value) <= limit, value).otherwise(F.decode(F.substring(raw, F.lit(1), choices), "UTF-8"))


def is_sensitive(key: Column, extra: tuple[str, ...] = ()) -> Column:
    """Whether a key names a secret."""
    return F.lower(key).rlike("|".join(map(re.escape, SENSITIVE + tuple(extra))))


def normalize_domain(name: Column) -> Column:
    """Trimmed, without trailing dots, lower case; null unless a valid host name of at most 253 bytes (F1)."""
    clean = F.lower(F.regexp_replace(F.trim(name), r"\.+$", ""))
    label = "[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
    return F.when((F.octet_length(clean) <= 253) & clean.rlike(rf"^{label}(\.{label})*$"), clean)


def workload_key(namespace: Column, pod_uid: Column, pod_name: Column, container_name: Column) -> Column:
    """namespace/(uid or pod)/(container or empty); null without a namespace."""
    return F.when(namespace.isNotNull(), F.concat(namespace, F.lit("/"), F.coalesce(pod_uid, pod_name), F.lit("/"), F.coalesce(container_name, F.lit(""))))


def basename(executable: Column, arguments: Column, command: Column) -> Column:
    """The name of a process after the last slash."""
    return F.substring_index(F.coalesce(executable, F.get(arguments, 0), command), "/", -1)


def is_shell(name: Column) -> Column:
    return name.isin(*SHELLS)


def is_network_tool(name: Column) -> Column:
    return name.isin(*NETWORK_TOOLS)


def tcp_state(number: Column) -> Column:
    """Label of a TCP state number, null if unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in TCP_STATES.items() for x in kv]), number.cast("int"))


def grpc_status(code: Column) -> Column:
    """Name of a gRPC status."""
    return F.coalesce(F.get(F.array(*map(F.lit, GRPC_STATUS)), code.cast("int")), F.lit("unknown"))


def tcp_metric(stat: Column, direction: Column, new_state: Column) -> Column:
    """The counter of a TCP observation, or null."""
    return (
        F.when(stat == "retransmit", "network.tcp.retransmits")
        .when((stat == "reset") & (direction == "send"), "network.tcp.resets.sent")
        .when((stat == "reset") & (direction == "receive"), "network.tcp.resets.received")
        .when(stat == "reset", "network.tcp.resets")
        .when((stat == "state_transition") & (new_state == "established"), "network.tcp.transitions.established")
        .when((stat == "state_transition") & (new_state == "close"), "network.tcp.transitions.closed")
    )


def is_external_ipv4(address: Column) -> Column:
    """IPv4 outside private, loopback, link-local, multicast, broadcast and unspecified ranges; anything else is false."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    plain = F.regexp_replace(address, r"^(?i)::ffff:(?=[0-9.]+$)", "")
    parts = F.transform(F.split(plain, r"\."), lambda x: x.try_cast("int"))
    a, b = F.get(parts, 0), F.get(parts, 1)
    inside = (a == 10) | (a == 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | a.between(224, 239) | (plain == "255.255.255.255") | (plain == "0.0.0.0")
    return F.coalesce(plain.rlike(rf"^{octet}(\.{octet}){{3}}$") & ~inside, F.lit(False))


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def _groups(address: Column) -> Column:
    """The eight groups of an IPv6 address (a dotted tail counts as two) as 32 lower hex digits, or null if it isn't one."""

    def words(side: Column) -> Column:
        return F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))

    def filled(left: Column, right: Column, sides: Column) -> Column:
        missing = 8 - F.size(left) - F.size(right)
        return F.when((sides == 2) & (missing >= 1), F.concat(left, F.array_repeat(F.lit("0"), missing), right)).when((sides == 1) & (missing == 0), left)

    def joined(whole: Column) -> Column:
        return F.when(F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))

    def undotted(parts: Column) -> Column:  # head, then the four numbers of the tail
        two = [F.lpad(F.lower(F.hex(F.get(parts, k).try_cast("int"))), 2, "0") for k in range(1, 5)]
        return F.concat(F.get(parts, 0), two[0], two[1], F.lit(":"), two[2], two[3])

    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    dotted = rf"^(.*:){octet}\.{octet}\.{octet}\.{octet}$"
    plain = F.lower(F.when(address.rlike(dotted), _let(F.split(F.regexp_replace(address, dotted, "$1 $2 $3 $4 $5"), " "), undotted)).otherwise(address))
    return F.when(address.contains(":"), _let(F.split(plain, "::"), lambda s: _let(words(F.get(s, 0)), lambda left: _let(words(F.coalesce(F.get(s, 1), F.lit(""))), lambda right: _let(filled(left, right, F.size(s)), joined)))))


def is_external(address: Column) -> Column:
    """Addresses outside private, loopback, link-local, multicast, broadcast and unspecified ranges (F2); IPv6 that maps IPv4 goes by that, anything else is false."""

    def six(g: Column) -> Column:
        four = F.concat_ws(".", *[F.conv(F.substring(g, 25 + 2 * k, 2), 16, 10) for k in range(4)])
        inside = g.isin("0" * 32, "0" * 31 + "1") | g.rlike("^(ff|f[cd]|fe[89ab])")
        return F.when(g.startswith("0" * 20 + "ffff"), is_external_ipv4(four)).otherwise(~inside)

    return F.when(address.contains(":"), F.coalesce(_let(_groups(address), six), F.lit(False))).otherwise(is_external_ipv4(address))


def container_of_path(path: Column) -> Column:
    """The 64-hex container id in a cgroup path of a known runtime."""
    marker = path.rlike("docker|containerd|crio|cri-o|libpod|kubepods")
    found = F.regexp_extract(path, r"(?<![0-9a-fA-F])([0-9a-fA-F]{64})(?![0-9a-fA-F])", 1)
    return F.when(marker & (found != ""), found)


def runtime_of_path(path: Column) -> Column:
    return F.when(path.contains("containerd"), "containerd").when(path.contains("crio") | path.contains("cri-o"), "cri-o").when(path.contains("libpod"), "podman").when(path.contains("docker"), "docker")


def pod_uid_of_path(path: Column) -> Column:
    """The pod uid of a cgroup path, with dashes."""
    found = F.regexp_extract(path, r"pod([0-9a-fA-F]{8}[-_][0-9a-fA-F]{4}[-_][0-9a-fA-F]{4}[-_][0-9a-fA-F]{4}[-_][0-9a-fA-F]{12})", 1)
    return F.when(found != "", F.translate(found, "_", "-"))


def prom_identifier(name: Column) -> Column:
    """A metric or label name: other characters and a leading digit become ``_``."""
    clean = F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    clean = F.regexp_replace(clean, "^[0-9]", "_")
    return F.when(clean == "", "_").otherwise(clean)


def glob(pattern: str, value: Column) -> Column:
    """``*`` any run, ``?`` one character; equality when neither occurs."""
    if not set(pattern) & {"*", "?"}:
        return value == pattern
    return value.rlike("(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$")


def valid_trace_id(value: Column) -> Column:
    """32 lower hex digits, not all zero."""
    return F.coalesce(value.rlike("^[0-9a-f]{32}$") & ~value.rlike("^0+$"), F.lit(False))


def valid_span_id(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{16}$") & ~value.rlike("^0+$"), F.lit(False))


def parse_traceparent(value: Column) -> Column:
    """struct(version, trace_id, span_id, flags, reason); the ids are null where reason is not."""
    parts = F.split(value, "-")
    version, trace, span, flags = (F.get(parts, k) for k in range(4))
    sized = (F.size(parts) == 4) & (F.length(version) == 2) & (F.length(trace) == 32) & (F.length(span) == 16) & (F.length(flags) == 2)
    reason = (
        F.when(value.isNull() | ~sized, "malformed")
        .when(~F.concat(version, trace, span, flags).rlike("^[0-9a-f]*$"), "invalid_hex")
        .when(version == "ff", "reserved_version")
        .when(trace.rlike("^0+$"), "all_zero_trace_id")
        .when(span.rlike("^0+$"), "all_zero_span_id")
    )
    ok = reason.isNull()
    return F.struct(F.when(ok, version).alias("version"), F.when(ok, trace).alias("trace_id"), F.when(ok, span).alias("span_id"), F.when(ok, flags).alias("flags"), reason.alias("reason"))


def valid_tracestate(value: Column) -> Column:
    """Whether a tracestate keeps to its grammar: 512 bytes, 32 members, no repeated key."""
    members = F.transform(F.split(value, ","), lambda m: F.trim(F.translate(m, "\t", " ")))
    key = r"[a-z][a-z0-9_*/-]{0,255}|[a-z0-9][a-z0-9_*/-]{0,240}@[a-z][a-z0-9_*/-]{0,13}"
    text = r"[\x20-\x2b\x2d-\x3c\x3e-\x7e]{0,255}[\x21-\x2b\x2d-\x3c\x3e-\x7e]"
    keys = F.transform(members, lambda m: F.substring_index(m, "=", 1))
    good = F.forall(members, lambda m: m.rlike(f"^({key})={text}$"))
    return F.coalesce((F.octet_length(value).between(1, 512)) & (F.size(members) <= 32) & good & (F.size(F.array_distinct(keys)) == F.size(keys)), F.lit(False))


def quantity(value: Column) -> Column:
    """A resource quantity: CPU in millicores (n, u, m or plain cores), memory in MiB (Ki, Mi, Gi)."""
    number = F.regexp_extract(value, r"^([0-9.]+)", 1).try_cast("double")
    unit = F.regexp_extract(value, r"^[0-9.]+([A-Za-z]*)$", 1)
    return F.when(unit == "n", number / 1e6).when(unit == "u", number / 1e3).when(unit == "m", number).when(unit == "Ki", number / 1024).when(unit == "Mi", number).when(unit == "Gi", number * 1024).when(unit == "", number * 1000)


def bucket(ts: Column, width: int) -> Column:
    """The start of the window of ``width`` that holds ``ts``."""
    return ts - F.pmod(ts, F.lit(width))
