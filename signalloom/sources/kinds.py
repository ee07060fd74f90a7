"""The payload of each kind of signal: fixed names of the wire form."""

from __future__ import annotations

from typing import NamedTuple

#: Parts of payloads: ``!`` marks a field that must be there.
PARTS = {
    "process": "pid long!, ppid long, uid long, command string!, executable string, cgroup_id long",
    "container": "container_id string!, runtime string",
    "kubernetes": "namespace string!, pod_name string!, pod_uid string, container_name string, node_name string, labels map",
    "window": "start_unix_nanos long!, end_unix_nanos long!",
    "flow_end": "address string, port int, namespace string, owner_name string, owner_type string, container container, kubernetes kubernetes",
    "end": "owner_name string, owner_type string, workload kubernetes, container container, address string, port int, domain string",
    "peer": "address string, port int, domain string, workload kubernetes, container container",
    "identity": "namespace string!, owner_name string!, owner_type string!",
    "resource": "host_name string, container container, kubernetes kubernetes",
    "resource_process": "pid long!, ppid long, uid long, command string!, executable string, container container, kubernetes kubernetes",
    "cgroup": "cgroup_path string!, container container, kubernetes kubernetes",
    "matched_process": "pid long!, command string!, executable string, arguments strings!",
    "matched_connection": "protocol net!, remote_address string!, remote_port int!, local_address string, local_port int, fd int",
    "attribute": "key string!, value string!",
    "frame": "domain domain, symbol string, module string, file string, line long, module_offset long",
}
#: Words that a field of such a type may have.
WORDS = {
    "net": "tcp udp",
    "family": "ipv4 ipv6",
    "direction": "egress ingress unknown",
    "stat": "retransmit reset state_transition",
    "state": "established syn_sent syn_recv fin_wait1 fin_wait2 time_wait close close_wait last_ack listen closing new_syn_recv",
    "reset": "send receive",
    "query_type": "a aaaa cname mx txt srv ptr other",
    "code": "no_error nx_domain serv_fail refused other",
    "severity": "low medium high",
    "confidence": "low medium high",
    "trace": "observed_trace_context generated_trace_context protocol_observed network_inferred dependency_inferred synthetic",
    "protocol": "http grpc kafka mongodb mysql nats postgresql redis websocket unknown",
    "role": "client server",
    "profiling": "cpu memory lock unknown",
    "sampled": "observed_profile_sample synthetic runtime_inferred",
    "domain": "unknown user kernel managed_runtime",
}
_WHO = "container container, kubernetes kubernetes"
_NET = "protocol net!, address_family family!"
_ENDS = "local_address string, local_port int, remote_address string!, remote_port int!, fd int"
_METRIC = "metric_name string!, unit string!"
_SPREAD = f"{_METRIC}, count long!, sum_nanos long!, min_nanos long!, max_nanos long!, window window!"
_SEEN = f"{_METRIC}, timestamp_unix_nanos long!, window window!"
_MAYBE = "process process, protocol net, address_family family"
_DNS = f"query_name string, query_type query_type, response_code code, server_address string, server_port int, {_WHO}"
_DNS_EVENT = f"transport_protocol net!, server_address string, server_port int, timestamp_unix_nanos long!, {_WHO}"
_OF = "resource resource!, process resource_process, cgroup cgroup, attributes attributes!"
_SPAN = "trace_id string, span_id string, parent_span_id string, start_unix_nanos long!, end_unix_nanos long, duration_nanos long, correlation_kind trace!, confidence confidence!"
_WARNING = "warning_type string!, message string!, timestamp_unix_nanos long!, source_signal_kind string!, source_module string!"
_ABOUT = f"process process, {_WHO}, peer peer"
_REQUEST = f"service_name string, method string, status_code int, {_ABOUT}, attributes attributes!"
_PROFILE = "profiling_kind profiling!, correlation_kind sampled!, confidence confidence!"
#: The fields of each kind's payload.
KINDS = {
    "exec": f"pid long!, ppid long, uid long, command string!, executable string, arguments strings!, cgroup_id long, timestamp_unix_nanos long!, {_WHO}",
    "process_exit": f"pid long!, ppid long, uid long, command string!, cgroup_id long, exit_code int, runtime_nanos long, timestamp_unix_nanos long!, {_WHO}",
    "process_lifecycle_duration": f"pid long!, command string!, started_at_unix_nanos long!, exited_at_unix_nanos long!, duration_nanos long!, {_WHO}",
    "network_connection_open": f"process process!, {_NET}, {_ENDS}, timestamp_unix_nanos long!, {_WHO}",
    "network_connection_close": f"process process!, {_NET}, {_ENDS}, opened_at_unix_nanos long, closed_at_unix_nanos long!, duration_nanos long, bytes_sent long, bytes_received long, {_WHO}",
    "network_connection_snapshot": f"process process!, {_NET}, {_ENDS}, opened_at_unix_nanos long, observed_at_unix_nanos long!, bytes_sent long!, bytes_received long!, {_WHO}",
    "network_connection_failure": f"process process!, {_NET}, remote_address string!, remote_port int!, fd int, errno int!, timestamp_unix_nanos long!, {_WHO}",
    "network_flow_summary": f"source flow_end!, destination flow_end!, {_NET}, bytes long!, packets long, direction direction!, first_seen_unix_nanos long!, last_seen_unix_nanos long!",
    "network_flow_warning": f"{_WARNING}, {_NET}, remote_address string!, remote_port int!, process process!, {_WHO}",
    "network_counter_metric": f"{_METRIC}, value long!, window window!, {_MAYBE}, local_address string, local_port int, remote_address string, remote_port int, errno int, {_WHO}",
    "network_peer_flow_metric": f"{_METRIC}, value long!, window window!, {_NET}, direction direction!, source identity!, destination identity!, overflow boolean",
    "network_duration_metric": f"{_SPREAD}, {_MAYBE}, remote_address string, remote_port int, {_WHO}",
    "network_gauge_metric": f"{_METRIC}, value long!, window window!, {_MAYBE}, remote_address string, remote_port int, {_WHO}",
    "network_tcp_stat_observation": f"stat stat!, address_family family!, local_address string, local_port int, remote_address string, remote_port int, old_state state, new_state state, reset_direction reset, timestamp_unix_nanos long!, process process, {_WHO}",
    "dns_query": f"process process!, query_name string!, query_type query_type!, transaction_id int, {_DNS_EVENT}",
    "dns_response": f"process process!, query_name string!, query_type query_type!, transaction_id int, response_code code!, latency_nanos long, {_DNS_EVENT}",
    "dns_counter_metric": f"{_METRIC}, value long!, window window!, {_DNS}",
    "dns_latency_metric": f"{_SPREAD}, {_DNS}",
    "dependency_edge": "source end!, destination end!, protocol net!, observations long!, first_seen_unix_nanos long!, last_seen_unix_nanos long!",
    "runtime_security_finding": f"rule_id string!, severity severity!, matched_process matched_process!, matched_connection matched_connection, {_WHO}",
    "node_cpu_observation": f"{_SEEN}, user_nanos long!, system_nanos long!, idle_nanos long!, iowait_nanos long!, steal_nanos long!, runnable_tasks long, blocked_tasks long",
    "node_load_observation": f"{_SEEN}, load1 double!, load5 double!, load15 double!, runnable_tasks long, total_tasks long",
    "node_memory_observation": f"{_SEEN}, mem_total_bytes long!, mem_available_bytes long, mem_free_bytes long, swap_total_bytes long, swap_free_bytes long",
    "node_filesystem_observation": f"{_SEEN}, mount_point string!, filesystem_type string, total_bytes long!, available_bytes long!",
    "node_disk_io_observation": f"{_SEEN}, device string!, reads_completed long!, writes_completed long!, read_bytes long!, written_bytes long!",
    "process_resource_observation": f"{_SEEN}, process resource_process!, cpu_time_nanos long, memory_rss_bytes long, virtual_memory_bytes long, open_fds long, socket_count long, thread_count long",
    "cgroup_cpu_observation": f"{_SEEN}, cgroup cgroup!, usage_nanos long, user_nanos long, system_nanos long, throttled_periods long, throttled_nanos long",
    "cgroup_memory_observation": f"{_SEEN}, cgroup cgroup!, current_bytes long, peak_bytes long, max_bytes long",
    "cgroup_pids_observation": f"{_SEEN}, cgroup cgroup!, process_count long, thread_count long, max_processes long",
    "cgroup_file_descriptor_observation": f"{_SEEN}, cgroup cgroup!, open_fds long, socket_count long",
    "resource_gauge_metric": f"{_METRIC}, value long!, window window!, {_OF}",
    "resource_counter_metric": f"{_METRIC}, value long!, window window!, {_OF}",
    "trace_span_observation": f"name string!, {_SPAN}, service_name string, {_ABOUT}, attributes attributes!",
    "service_interaction_span_observation": f"name string!, {_SPAN}, source end!, destination end!, protocol net!, process process, error_type string, attributes attributes!",
    "trace_service_path_observation": "path_key string!, source end!, destination end!, protocol net!, observations long!, first_seen_unix_nanos long!, last_seen_unix_nanos long!, correlation_kind trace!, confidence confidence!, attributes attributes!",
    "trace_correlation_warning": f"{_WARNING}, correlation_kind trace!, {_ABOUT}",
    "protocol_request_observation": f"protocol protocol!, role role, {_SPAN}, {_REQUEST}",
    "extracted_trace_context_observation": f"protocol protocol!, timestamp_unix_nanos long!, trace_id string, span_id string, parent_span_id string, correlation_kind trace!, confidence confidence!, {_ABOUT}, attributes attributes!",
    "request_span_observation": f"name string!, protocol protocol!, {_SPAN}, {_REQUEST}",
    "request_correlation_warning": f"{_WARNING}, correlation_kind trace!, protocol protocol!, {_ABOUT}",
    "profile_sample_observation": f"timestamp_unix_nanos long!, {_PROFILE}, sample_count long!, sampling_period_nanos long, stack_id string!, stack_frames frames!, process process, {_WHO}, thread_id long, thread_name string, attributes attributes!",
    "profiling_stack_trace_observation": f"timestamp_unix_nanos long!, {_PROFILE}, stack_id string!, stack_frames frames!, process process, {_WHO}, attributes attributes!",
    "profiling_session_observation": f"window window!, {_PROFILE}, profile_id string!, observed_sample_count long!, dropped_sample_count long!, distinct_stack_count long!, sampling_period_nanos long, process process, {_WHO}, source string!, attributes attributes!",
    "profiling_warning_observation": f"{_WARNING}, {_PROFILE}, process process, {_WHO}, attributes attributes!",
}

_PLAIN = {"long": "BIGINT", "int": "INT", "double": "DOUBLE", "string": "STRING", "boolean": "BOOLEAN", "strings": "ARRAY<STRING>", "map": "MAP<STRING, STRING>"}


class Field(NamedTuple):
    name: str
    kind: str
    needed: bool


def fields_of(text: str) -> list[Field]:
    out = []
    for part in text.split(", "):
        name, kind = part.split(" ")
        out.append(Field(name, kind.rstrip("!"), kind.endswith("!")))
    return out


def sql_type(kind: str) -> str:
    """A field's type in SQL."""
    if kind in WORDS:
        return "STRING"
    if kind in ("attributes", "frames"):
        return f"ARRAY<{sql_type(kind[:-1])}>"
    if kind in PARTS:
        return f"STRUCT<{', '.join(f'{f.name}: {sql_type(f.kind)}' for f in fields_of(PARTS[kind]))}>"
    return _PLAIN[kind]


def schema(kind: str) -> str:
    """The columns of a kind's payload."""
    return ", ".join(f"{f.name} {sql_type(f.kind)}" for f in fields_of(KINDS[kind]))
