"""Bounded labels, attributes and arguments: pure expressions over maps and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SENSITIVE_ARGUMENTS, SENSITIVE_RESOURCE, is_sensitive, truncate_utf8


def _entries(labels: Column) -> Column:
    return F.array_sort(F.map_entries(labels))


def _last_wins(entries: Column) -> Column:
    """A map of (key, value) entries; of equal keys the last stays."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


def bound_labels(labels: Column, most: int = 16, key_bytes: int = 128, value_bytes: int = 256) -> Column:
    """The first ``most`` labels by key, without empty keys, truncated."""
    kept = F.slice(F.filter(_entries(labels), lambda e: e["key"] != ""), 1, most)
    return _last_wins(F.transform(kept, lambda e: F.struct(truncate_utf8(e["key"], key_bytes).alias("key"), truncate_utf8(e["value"], value_bytes).alias("value"))))


def select_labels(labels: Column, allow: tuple[str, ...], most: int) -> Column:
    """Allowed labels without control characters or blanks, at most ``most`` by key."""
    safe = F.map_filter(labels, lambda k, v: k.isin(*allow) & ~k.rlike(r"[\s\p{Cntrl}]") & ~v.rlike(r"[\s\p{Cntrl}]"))
    return F.map_from_entries(F.slice(_entries(safe), 1, most))


def drop_sensitive(attributes: Column, extra: tuple[str, ...] = ()) -> Column:
    """Attributes (array of key, value) without secret-bearing keys."""
    return F.filter(attributes, lambda a: ~is_sensitive(a["key"], extra))


def bound_trace_attributes(attributes: Column, most: int = 16, key_bytes: int = 128, value_bytes: int = 256) -> Column:
    """Trace family: oversize attributes are dropped, the first ``most`` stay (P5)."""
    fits = F.filter(drop_sensitive(attributes), lambda a: (F.octet_length(a["key"]) <= key_bytes) & (F.octet_length(a["value"]) <= value_bytes))
    return F.slice(fits, 1, most)


def bound_resource_attributes(attributes: Column, most: int = 16, key_bytes: int = 128, value_bytes: int = 256) -> Column:
    """Resource family: oversize attributes are truncated (P5)."""
    kept = F.slice(drop_sensitive(attributes, SENSITIVE_RESOURCE), 1, most)
    return F.transform(kept, lambda a: F.struct(truncate_utf8(a["key"], key_bytes).alias("key"), truncate_utf8(a["value"], value_bytes).alias("value")))


#: Attributes that tell of an error.
ERROR_KEYS = ("error.type", "http.response.status_code", "rpc.grpc.status_code", "db.response.status_code", "messaging.kafka.response.error_code", "messaging.nats.status_code")


def bound_request_attributes(attributes: Column, most: int = 8, key_bytes: int = 128, value_bytes: int = 256) -> Column:
    """Request family: the first ``most`` that aren't oversize; a new error attribute beyond them takes the place of the last other one (P5)."""

    def is_error(a: Column) -> Column:
        return a["key"].isin(*ERROR_KEYS)

    def put(kept: Column, a: Column) -> Column:
        last = F.array_max(F.transform(kept, lambda x, i: F.when(is_error(x), -1).otherwise(i)))
        others = F.filter(kept, lambda x, i: i != last)
        new = is_error(a) & ~F.exists(kept, lambda x: x["key"] == a["key"]) & (last >= 0)
        return F.when(F.size(kept) < most, F.array_append(kept, a)).when(new, F.array_append(others, a)).otherwise(kept)

    fits = F.filter(attributes, lambda a: (F.octet_length(a["key"]) <= key_bytes) & (F.octet_length(a["value"]) <= value_bytes))
    return F.aggregate(fits, F.slice(fits, 1, 0), put)


#: Attribute keys that a profile's own fields take.
PROFILE_RESERVED = ("schema", "profile_id", "profile_kind", "correlation_kind", "confidence", "sample_count", "stack_id", "frame_count")
TOP = 9223372036854775807


def bound_profile_attributes(attributes: Column, most: int = 16, key_bytes: int = 128, value_bytes: int = 256) -> Column:
    """Profile family: reserved keys go as well, oversize attributes are truncated (P5)."""
    kept = F.slice(F.filter(drop_sensitive(attributes), lambda a: ~F.lower(a["key"]).isin(*PROFILE_RESERVED)), 1, most)
    return F.transform(kept, lambda a: F.struct(truncate_utf8(a["key"], key_bytes).alias("key"), truncate_utf8(a["value"], value_bytes).alias("value")))


def saturating_add(a: Column, b: Column) -> Column:
    """The sum of two counters, or the greatest number where it would pass it."""
    return F.coalesce(F.try_add(a.cast("long"), b.cast("long")), F.when(a.isNotNull() & b.isNotNull(), F.lit(TOP)))


def saturating_sum(value: Column) -> Column:
    """The sum of a group, or ``TOP`` where it is above (F15); added up as decimals, which don't overflow."""
    total = F.sum(value.cast("decimal(19,0)"))
    return F.when(total > TOP, TOP).otherwise(total).cast("long")


def saturating_sub(a: Column, b: Column) -> Column:
    """The difference of two counters, 0 at least."""
    return F.greatest(a.cast("long") - b.cast("long"), F.when(a.isNotNull() & b.isNotNull(), F.lit(0).cast("long")))


def map_difference(before: Column, after: Column) -> Column:
    """struct(gone, fresh, changed): keys in order that one map lacks or that have another value."""
    a, b = F.map_keys(before), F.map_keys(after)
    changed = F.filter(F.array_intersect(a, b), lambda k: ~before[k].eqNullSafe(after[k]))
    return F.struct(F.array_sort(F.array_except(a, b)).alias("gone"), F.array_sort(F.array_except(b, a)).alias("fresh"), F.array_sort(changed).alias("changed"))


def merge_attributes(first: Column, second: Column, most: int = 16) -> Column:
    """Sorted, distinct, at most ``most``."""
    return F.slice(F.array_distinct(F.array_sort(F.concat(first, second))), 1, most)


def redact_argv(arguments: Column) -> Column:
    """Arguments with secrets replaced: after ``key=``, in the argument that follows a bare key, and whole after ``bearer ``."""

    def after_key(a: Column) -> Column:
        """What follows the first of the ordered keys that occurs; null if none does."""
        low, end = F.lower(a), F.lit(None).cast("int")
        for key in reversed(SENSITIVE_ARGUMENTS):
            at = F.instr(low, key)
            end = F.when(at > 0, at + len(key)).otherwise(end)
        return end

    def step(state: Column, a: Column) -> Column:
        end = after_key(a)
        rest = F.substr(a, end)
        separator = F.regexp_extract(rest, r"(?s)^([^=: ]*[=: ])", 1)
        prefix = F.concat(F.substr(a, F.lit(1), end - 1), separator)
        bearer = F.lower(a).startswith("bearer ")
        bare = end.isNotNull() & ((separator == "") | (F.length(prefix) == F.length(a)))
        out = F.when(state["next"], F.lit("<redacted>")).when(bearer, F.lit("<redacted>")).when(end.isNull() | bare, a).otherwise(F.concat(prefix, F.lit("<redacted>")))
        return F.struct(F.array_append(state["out"], out).alias("out"), (~state["next"] & ~bearer & bare).alias("next"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("next"))
    return F.aggregate(arguments, start, step, lambda s: s["out"])
