"""Removal of repeated byte strings with difference-cover suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts earlier.

1. Each window of LENGTH bytes is represented by the smallest hash of its GRAM-byte
   grams (leftmost of equals). Equal windows have equal representatives, so a
   representative that occurs once in the corpus has no repeated window. Those are
   found by fragments of the hash range, and the suffixes behind them never enter the sort.
2. For a representative that repeats, the bytes of its windows (a context) go to the task of
   its hash. Equal contexts of a task are one, with their places, so that a passage
   in a third of all documents is sent once a task.
3. There the suffixes of different contexts are sorted with a difference cover modulo 3: the triples at two of three
   places are sorted and named, the names are sorted by recursion, the rest is merged in.
   Neighbours that share LENGTH bytes are occurrences of one string; all but the first are repeats.

Windows that are equal meet in one task, whatever documents they come from; nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import documents, partitions, written

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
#: Windows in one pass over a text, so that a place fits beside 40 bits of a hash; bytes per difference-cover sort.
PIECE, SORT = 1 << 20, 1 << 20

_U = np.uint64
_PLACE = _U((1 << 24) - 1)


# --- suffix sorting -----------------------------------------------------------------------------------------------------


def _names(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order and dense names (from 1) of tuples."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return order, names, int(new.sum())


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (numbers above 0) in order, by the difference cover {1, 2} modulo 3."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    t = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    cover = np.arange(n + (n % 3 == 1))  # with a suffix of zeros where the last place of residue 1 would be missing
    ones, twos = cover[1::3], cover[2::3]
    sample = np.concatenate([ones, twos])
    sample = sample[sample <= n]
    top = int(t.max()) + 1
    if top < 1 << 20:
        key = (t[np.minimum(sample, n)] * top + t[np.minimum(sample + 1, n)]) * top + t[np.minimum(sample + 2, n)]
        order, names, kinds = _names(key)
    else:
        order, names, kinds = _names(t[np.minimum(sample, n)], t[np.minimum(sample + 1, n)], t[np.minimum(sample + 2, n)])
    if kinds < len(sample):
        order = suffix_array(names)  # residues 1, then 2: a string of names
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    s12 = sample[order]
    s12 = s12[s12 < n]
    zeros = np.arange(0, n, 3)
    wide = len(sample) + 2
    k0 = t[zeros] * wide + rank[zeros + 1]
    by = np.argsort(k0, kind="stable")
    s0, k0 = zeros[by], k0[by]
    s1, s2 = s12[s12 % 3 == 1], s12[s12 % 3 == 2]
    less1 = np.searchsorted(t[s1] * wide + rank[s1 + 1], k0)
    # residue 2 is compared by two characters and a rank: pairs of characters are named first
    _, pair, _ = _names(t[np.concatenate([s0, s2])], t[np.concatenate([s0, s2]) + 1])
    a, b = pair[: len(s0)] * wide + rank[s0 + 2], pair[len(s0) :] * wide + rank[s2 + 2]
    less2 = np.searchsorted(b, a)
    out = np.empty(n, np.int64)
    place = np.arange(len(s0)) + less1 + less2
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = s0
    out[~taken] = s12
    return out


# --- representatives ----------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)


def representatives(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each representative of the windows of one text, at most PIECE windows long."""
    windows = len(data) - LENGTH + 1
    if windows <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = data.astype(_U) + _U(1)
    factor, size = 0x9E3779B97F4A7C15, 1
    while size < GRAM:
        h = h[: len(h) - size] * _U(factor) + h[size:]
        factor, size = factor * factor % (1 << 64) | 1, 2 * size
    h = _mix(h) & ~_PLACE
    key = h | np.arange(len(h), dtype=_U)  # the leftmost of equals is the smallest
    size = 1
    while 2 * size <= WINDOW:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    key = np.minimum(key[:windows], key[WINDOW - size : WINDOW - size + windows])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    last = np.append(first[1:] - 1, windows - 1)
    return key[first] >> _U(24), first, last


def _texts(column) -> Iterator[np.ndarray]:
    for x in column:
        yield np.frombuffer((x.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)


def _pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A text in runs of PIECE windows."""
    for at in range(0, max(1, len(data) - LENGTH + 1), PIECE):
        yield at, data[at : at + PIECE + LENGTH - 1]


#: kind 0: values of the texts of a bucket; kind 1: a text, compressed. Those of kind 0 are read first.
_MIXED = "kind int, bucket int, row long, doc_id long, size int, text binary, rows binary, sizes binary, first binary, second binary"


def _record(length: int, columns: dict) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in _MIXED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[k]) if c in columns else pa.nulls(length, kinds[k]) for c, k in fields], names=[c for c, _ in fields])


def _packed(buckets: int):
    """Texts as compressed bytes with their buckets: they are shuffled twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column("text")]
                row = b.column("row")
                yield _record(b.num_rows, {"kind": [1] * b.num_rows, "bucket": (row.to_numpy() % buckets).astype(np.int32), "row": row, "doc_id": b.column("doc_id"), "size": list(map(len, raw)), "text": [pa.compress(r, "zstd", asbytes=True) for r in raw]})

    return run


def _by_bucket(buckets: int, row: np.ndarray, first: np.ndarray, second: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Values of rows, packed by bucket; ``row`` in order."""
    edge = np.flatnonzero(np.diff(row, prepend=-1))
    size, owner = np.diff(np.append(edge, len(row))), row[edge]
    bucket = owner % buckets
    order = np.argsort(bucket, kind="stable")
    values = np.argsort(np.repeat(bucket, size), kind="stable")
    first, second = first[values], second[values] if second is not None else None
    owner, size, bucket = owner[order], size[order], bucket[order]
    cuts, ends = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)), np.concatenate([[0], np.cumsum(size)])
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        part = slice(ends[a], ends[z])
        columns = {"kind": [0], "bucket": [int(bucket[a])], "rows": [owner[a:z].tobytes()], "sizes": [size[a:z].astype(np.int32).tobytes()], "first": [first[part].tobytes()]}
        yield _record(1, columns | ({"second": [second[part].tobytes()]} if second is not None else {}))


def _unpack(rows: bytes, sizes: bytes, *values: bytes) -> Iterator[tuple]:
    cuts = np.cumsum(np.frombuffer(sizes, np.int32))[:-1]
    yield from zip(np.frombuffer(rows, np.int64).tolist(), *(np.split(np.frombuffer(v, np.int64), cuts) for v in values), strict=True)


_SENT = "part int, rows binary, sizes binary, hashes binary"


def _send(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                hashes, rows = [], []
                for row, data in zip(b.column("row").to_pylist(), _texts(b.column("text")), strict=True):
                    for _, piece in _pieces(data):
                        h, _, _ = representatives(piece)
                        hashes.append(h)
                        rows.append(np.full(len(h), row, np.int64))
                h, r = np.concatenate(hashes), np.concatenate(rows)
                if not len(h):
                    continue
                p = (h % _U(parts)).astype(np.int64)
                order = np.argsort(p, kind="stable")
                h, r, p = h[order], r[order], p[order]
                cuts = np.flatnonzero(np.diff(p, prepend=-1, append=-1))
                out: list[list] = [[], [], [], []]
                for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                    edge = np.flatnonzero(np.diff(r[a:z], prepend=-1))
                    values = int(p[a]), r[a:z][edge].tobytes(), np.diff(np.append(edge, z - a)).astype(np.int32).tobytes(), (h[a:z] // _U(parts)).astype(_U).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                    for c, v in zip(out, values, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["part", "rows", "sizes", "hashes"])

    return run


def _repeated(parts: int, buckets: int):
    """Rows with the representatives that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, sizes = [], [], []
        for b in batches:
            for p, r, s, h in zip(*(b.column(c).to_pylist() for c in ("part", "rows", "sizes", "hashes")), strict=True):
                five = np.frombuffer(h, np.uint8).reshape(-1, 5)
                wide = np.zeros((len(five), 8), np.uint8)
                wide[:, :5] = five
                keys.append(wide.view(_U)[:, 0] * _U(parts) + _U(p))
                rows.append(np.frombuffer(r, np.int64))
                sizes.append(np.frombuffer(s, np.int32))
        if not keys:
            return
        key = np.concatenate(keys).astype(np.int64)
        row = np.repeat(np.concatenate(rows), np.concatenate(sizes))
        del keys, rows, sizes
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        keep = np.zeros(len(key), bool)
        keep[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        row, key = row[keep], key[keep]
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        only = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])]) if len(row) else np.zeros(0, bool)
        row, key = row[only], key[only]
        if len(row):
            yield from _by_bucket(buckets, row, key)

    return run


# --- contexts -----------------------------------------------------------------------------------------------------------

_CONTEXT = "hash long, context binary, ids binary, rows binary, starts binary"
_LATE = np.iinfo(np.int64).max


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts of repeated representatives; equal ones of a stretch of documents once, with all places. Lists of a row come before its text."""
    found: dict[int, list[np.ndarray]] = {}
    held: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
    size = 0

    def flush():
        places = [np.array(v, np.int64) for v in held.values()]
        columns = [pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.binary()), *(pa.array([v[:, c].tobytes() for v in places], pa.binary()) for c in range(3))]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=["hash", "context", "ids", "rows", "starts"])

    for b in batches:
        for kind, row, doc_id, length, text, *lists in zip(*(b.column(c).to_pylist() for c in ("kind", "row", "doc_id", "size", "text", "rows", "sizes", "first")), strict=True):
            if kind == 0:
                for k, values in _unpack(*lists):
                    found.setdefault(k, []).append(values)
                continue
            if row not in found:
                continue
            wanted = np.concatenate(found.pop(row))
            raw = pa.decompress(text, length, "zstd", asbytes=True)
            for at, piece in _pieces(np.frombuffer(raw, np.uint8)):
                h, first, last = representatives(piece)
                hit = np.isin(h.astype(np.int64), wanted)
                for k, a, z in zip(h[hit].tolist(), (first[hit] + at).tolist(), (last[hit] + at + LENGTH).tolist(), strict=True):
                    held.setdefault((k, raw[a:z]), []).append((_LATE if doc_id is None else doc_id, row, a))
                    size += 200
            if size > 24_000_000:
                yield flush()
                size = 0
    if held:
        yield flush()


def repeats_of(contexts: list[bytes], first: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """For each of different contexts, the offsets of the windows that start earlier in another one; ``first``: the earliest place of each."""
    sizes = np.array(list(map(len, contexts)))
    begin = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(contexts), np.uint8)
    order = suffix_array(text.astype(np.int64) + 1)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    offset = np.arange(len(text)) - begin[owner]
    order = order[offset[order] <= sizes[owner[order]] - LENGTH]  # suffixes that are windows
    views = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    same = np.zeros(len(order), bool)
    for a in range(1, len(order), 100_000):
        z = min(a + 100_000, len(order))
        same[a:z] = (views[order[a:z]] == views[order[a - 1 : z - 1]]).all(axis=1)
    group = np.cumsum(~same)
    place = np.array(first, np.int64)[owner[order]]
    by = np.lexsort((place[:, 2] + offset[order], place[:, 1], place[:, 0], group))
    later = np.concatenate([[False], group[by][1:] == group[by][:-1]])
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(contexts)
    hit = order[by][later]
    hit = hit[np.argsort(hit)]
    for k, offsets in zip(*_grouped(owner[hit], offset[hit]), strict=True):
        out[k] = offsets
    return out


def _grouped(keys: np.ndarray, values: np.ndarray):
    edge = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[edge].tolist(), np.split(values, edge[1:]) if len(edge) else []


def _compare(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Removed stretches (start, end) of rows from the contexts of a task's representatives."""
    groups: dict[int, dict[bytes, list]] = {}
    for b in batches:
        for h, c, i, r, s in zip(*(b.column(n).to_pylist() for n in ("hash", "context", "ids", "rows", "starts")), strict=True):
            groups.setdefault(h, {}).setdefault(c, []).append((i, r, s))
    rows, starts, ends = [], [], []
    mixed: list[tuple[bytes, tuple[int, int, int]]] = []

    def solve():
        for (context, (_, row, start)), offsets in zip(mixed, repeats_of([m[0] for m in mixed], [m[1] for m in mixed]), strict=True):
            if len(offsets):
                edge = np.flatnonzero(np.diff(offsets, prepend=-9) != 1)
                last = np.append(edge[1:] - 1, len(offsets) - 1)
                rows.append(np.full(len(edge), row))
                starts.append(start + offsets[edge])
                ends.append(start + offsets[last] + LENGTH)
        mixed.clear()

    size = 0
    for contexts in groups.values():
        for context, places in contexts.items():
            ids, row, start = (np.concatenate([np.frombuffer(p[k], np.int64) for p in places]) for k in range(3))
            least = np.lexsort((start, row, ids))[0]
            rest = np.arange(len(ids)) != least  # every window of a later place is a repeat
            rows.append(row[rest])
            starts.append(start[rest])
            ends.append(start[rest] + len(context))
            if len(contexts) > 1:
                mixed.append((context, (int(ids[least]), int(row[least]), int(start[least]))))
                size += len(context)
        if size > SORT:  # equal windows have one representative: between groups the sort can be cut
            solve()
            size = 0
    if mixed:
        solve()
    if rows:
        row, start, end = (np.concatenate(x) for x in (rows, starts, ends))
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        if len(row):
            yield from _by_bucket(buckets, row, start, end)


# --- the operator -------------------------------------------------------------------------------------------------------


def numbered(docs: DataFrame, scan: bool) -> DataFrame:
    """row, doc_id, text. Rows of a plain scan of files are numbered alike each time; others are written first."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows if scan else written(rows, "repeat-rows")


def repeats(rows: DataFrame, buckets: int) -> DataFrame:
    """Stretches of bytes that are repeats, which may overlap, packed by bucket of rows; texts without any are absent."""
    n = partitions(rows.sparkSession)
    parts = 2 * n
    lists = rows.select("row", "text").mapInArrow(_send(parts), _SENT).repartition(n, "part").mapInArrow(_repeated(parts, buckets), _MIXED)
    both = lists.unionByName(rows.mapInArrow(_packed(buckets), _MIXED))
    contexts = both.repartition(n, "bucket").sortWithinPartitions("kind").mapInArrow(_contexts, _CONTEXT)
    return contexts.repartition(n, "hash").mapInArrow(lambda batches: _compare(batches, buckets), _MIXED)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    names = ["row", "doc_id", "n_bytes", "n_removed", "span_starts", "span_ends", "kept"]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            b = whole.slice(at, 1024)
            out: list[list] = [[] for _ in names]
            for kind, row, doc_id, length, text, *lists in zip(*(b.column(c).to_pylist() for c in ("kind", "row", "doc_id", "size", "text", "rows", "sizes", "first", "second")), strict=True):
                if kind == 0:
                    for k, s, e in _unpack(*lists):
                        found.setdefault(k, []).append((s, e))
                    continue
                raw = pa.decompress(text, length, "zstd", asbytes=True)
                starts, ends, kept = [], [], raw
                if row in found:
                    pieces = found.pop(row)
                    a, z = (np.concatenate([p[k] for p in pieces]) for k in (0, 1))
                    order = np.argsort(a, kind="stable")
                    a, z = a[order], np.maximum.accumulate(z[order])
                    new = np.concatenate([[True], a[1:] > z[:-1]])
                    starts, ends = a[new].tolist(), z[np.append(np.flatnonzero(new)[1:] - 1, len(z) - 1)].tolist()
                    kept = b"".join(raw[x:y] for x, y in zip([0, *ends], [*starts, len(raw)], strict=True))
                for c, v in zip(out, (row, doc_id, len(raw), len(raw) - len(kept), starts, ends, kept), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def cut_repeats(docs: DataFrame, scan: bool = False) -> DataFrame:
    """One row for each row of ``docs``: row, doc_id, n_bytes, n_removed, the removed spans (starts, ends) and the bytes kept.

    Null texts count as empty; texts below LENGTH bytes keep all. Earlier means the smaller doc_id (null last), then
    the row read first, then the earlier start. ``scan``: ``docs`` is a plain scan of files. Other columns of ``docs`` don't matter.
    """
    rows = numbered(docs, scan)
    n = partitions(docs.sparkSession)
    buckets = 8 * n
    both = repeats(rows, buckets).unionByName(rows.mapInArrow(_packed(buckets), _MIXED))
    return both.repartition(n, "bucket").sortWithinPartitions("kind").mapInArrow(_cut, "row long, doc_id long, n_bytes long, n_removed long, span_starts array<long>, span_ends array<long>, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(documents(spark, sf_dir), scan=True)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
