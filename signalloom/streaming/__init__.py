"""The same derivations on streams, with event-time watermarks."""

from .processors import flow_interval_stream, http_heads_stream, match_fifo_stream, timestamp_guard_stream, with_rocksdb
from .state import active_gauge_stream, http_heads
from .streams import dedup_stream, fan_out, match_requests_stream, peer_cap, peer_stream, profile_windows
from .watch import pod_watch, watched_pods

__all__ = ["active_gauge_stream", "dedup_stream", "fan_out", "flow_interval_stream", "http_heads", "http_heads_stream", "match_fifo_stream", "match_requests_stream", "peer_cap", "peer_stream", "pod_watch", "profile_windows", "timestamp_guard_stream", "watched_pods", "with_rocksdb"]
