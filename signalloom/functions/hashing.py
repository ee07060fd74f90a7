"""FNV-1a, whose multiplication wraps: Arrow batches in numpy, as SQL arithmetic can't."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of FNV-1a with 64 bits.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


def _hashes(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """The hash of each run of bytes; one step for the k-th byte of all runs that are so long."""
    out = np.full(len(sizes), seed, np.uint64)
    order = np.argsort(-sizes, kind="stable")
    starts, ranked, live = starts[order], sizes[order], len(sizes)
    for k in range(int(ranked[0]) if len(ranked) else 0):
        while live and ranked[live - 1] <= k:
            live -= 1
        rows = order[:live]
        out[rows] = (out[rows] ^ flat[starts[:live] + k]) * np.uint64(PRIME)
    return out


def fnv1a64_many(values: list[bytes], seed: int = OFFSET) -> np.ndarray:
    """The hash of each value."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    return _hashes(np.frombuffer(b"".join(values), np.uint8), np.cumsum(sizes) - sizes, sizes, seed)


def fnv1a64_array(values: pa.Array, seed: int = OFFSET) -> pa.Array:
    """The hash of each string or binary value as 16 lower hex digits, read where Arrow holds the bytes; null for null."""
    if not len(values):
        return pa.array([], pa.string())
    held = values.cast(pa.large_binary())
    _, offsets, data = held.buffers()
    ends = np.frombuffer(offsets, np.int64, len(held) + 1, held.offset * 8)
    hashes = _hashes(np.frombuffer(data or b"", np.uint8), ends[:-1], np.diff(ends), seed)
    return pa.array([f"{h:016x}" for h in hashes.tolist()], pa.string(), mask=held.is_null().to_numpy(zero_copy_only=False))


def hash_function(seed: int):
    """The hash as a function of Arrow batches."""

    def run(values: pa.Array) -> pa.Array:
        return fnv1a64_array(values, seed)

    return F.arrow_udf(run, T.StringType())


def fnv1a64(value: Column, seed: int = OFFSET) -> Column:
    """16 lower hex digits; null for null."""
    return hash_function(seed)(value)


def bounded_or_hash(value: Column, limit: int, prefix: str = "hash:") -> Column:
    """The value, or its hash with a prefix if it is longer than ``limit`` bytes."""
    return F.when(F.octet_length(value) <= limit, value).otherwise(F.concat(F.lit(prefix), fnv1a64(value)))


def label_hash(key: str, value: Column) -> Column:
    """The hash that stands in for an identity label: key, 0xFF, value (F8)."""
    return fnv1a64(F.concat(F.encode(F.lit(key), "UTF-8"), F.unhex(F.lit("FF")), F.encode(value, "UTF-8")))


#: What the offset is combined with for the halves of a trace id and for a span id.
SEEDS = (OFFSET ^ 0x9E3779B97F4A7C15, OFFSET ^ 0xD1B54A32D192ED03, OFFSET ^ 0x94D049BB133111EB)


def _ids(values: list[bytes]) -> pd.DataFrame:
    a, b, c = (np.maximum(fnv1a64_many(values, s), np.uint64(1)).tolist() for s in SEEDS)
    return pd.DataFrame({"trace_id": [f"{x:016x}{y:016x}" for x, y in zip(a, b, strict=True)], "span_id": [f"{x:016x}" for x in c]})


_IDS = "trace_id string, span_id string"


def generated_ids(identity: Column) -> Column:
    """struct(trace_id, span_id) from an identity string; never all zero."""

    def run(values: pd.Series) -> pd.DataFrame:
        return _ids([v.encode() for v in values])

    return F.pandas_udf(run, _IDS)(identity)


def request_ids(head: Column, method: Column, target: Column, status: Column, kind: Column, peer: Column, port: Column) -> Column:
    """struct(trace_id, span_id) of a request (F5): ``head``, then the hashes of method and target (0 if null), the status and the peer; null where ``head`` is."""

    def hashed(values: list[str | None]) -> list[int]:
        return [0 if v is None else h for v, h in zip(values, fnv1a64_many([(v or "").encode() for v in values]).tolist(), strict=True)]

    def run(head: pd.Series, method: pd.Series, target: pd.Series, status: pd.Series, kind: pd.Series, peer: pd.Series, port: pd.Series) -> pd.DataFrame:
        live = head.notna().to_numpy()
        parts = [[None if pd.isna(v) else v for v in c[live]] for c in (head, method, target, status, kind, peer, port)]
        h, m, t, s, k, p, o = parts
        at = ["unknown-peer" if kind is None else f"{kind}:{x:016x}:{port}" for kind, x, port in zip(k, hashed(p), o, strict=True)]
        made = _ids([f"{a}|{b}|{c}|{d}|{e}".encode() for a, b, c, d, e in zip(h, hashed(m), hashed(t), s, at, strict=True)])
        out = pd.DataFrame({n: pd.Series([None] * len(head), dtype=object) for n in ("trace_id", "span_id")})
        out.loc[live] = made.to_numpy()
        return out

    return F.pandas_udf(run, _IDS)(head, method, target, status, kind, peer, port)


def hash_sql(text: str, seed: int = OFFSET) -> str:
    """DuckDB SQL of the hash of the bytes of an expression, as 16 hex digits: 128-bit integers hold the product."""
    steps = f"list_prepend(CAST({seed} AS HUGEINT), list_transform(list_filter(string_split(regexp_replace(hex({text}), '(..)', '\\1 ', 'g'), ' '), lambda p: p <> ''), lambda p: CAST(CAST('0x' || p AS INT) AS HUGEINT)))"
    return f"lpad(lower(hex(CAST(list_reduce({steps}, lambda h, b: (xor(h, b) * {PRIME}) % 18446744073709551616) AS UBIGINT))), 16, '0')"


def stack_id(frames: Column) -> Column:
    """Hash of frames (domain, symbol, module, file, line, module_offset) (F6): fields end with U+001F, frames with U+001E; an unknown domain isn't written."""

    def text(value: Column) -> Column:
        return F.coalesce(F.concat(F.lit("some:"), value), F.lit("none"))

    def frame(f: Column) -> Column:
        domain = F.when(F.coalesce(f["domain"], F.lit("unknown")) != "unknown", F.concat(F.lit("domain:"), f["domain"], F.lit("\x1f"))).otherwise("")
        numbers = [F.coalesce(f[n].cast("string"), F.lit("")) for n in ("line", "module_offset")]
        return F.concat(domain, F.concat_ws("\x1f", text(f["symbol"]), text(f["module"]), text(f["file"]), *numbers), F.lit("\x1e"))

    return F.concat(F.lit("stack:"), fnv1a64(F.array_join(F.transform(frames, frame), "")))
