"""Media columns: content-addressed payloads in tar shards.

Each task appends its payloads to a tar shard in the shared folder, each distinct
one once, named by the SHA-256 of its stored form. Rows carry digest, shard, offset
and length. Metadata columns come from header-only range reads; features from
range reads of the payloads. A shard is named after the attempt of the task that
wrote it, so what a lost or repeated attempt leaves behind is never referred to.

The stored form is a PNG: 8-bit grey samples, 64 in a row, lossless.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._util import Step, append_columns, documents, partitions, scratch, written

WIDTH = 64
#: Fixed values of the format.
PNG_SIGNATURE, HEADER_BYTES = b"\x89PNG\r\n\x1a\n", 33


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of WIDTH."""
    return data + b"\0" * (-len(data) % WIDTH if data else WIDTH)


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a line begins with its filter, 0: none
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER_BYTES."""
    if data[:8] != PNG_SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", data[16:25])


def from_png(data: bytes) -> bytes:
    width, height, _ = png_header(data)
    at, packed = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected line filter")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Height, sum, sum of squares and a 16-bin histogram of the samples."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    wide = x.astype(np.int64)
    return f"rows={len(x) // WIDTH};sum={wide.sum()};sq={(wide * wide).sum()};hist={','.join(map(str, bins))}"


_ADDRESS = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("digest", T.StringType()),
    T.StructField("shard", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("owner", T.BooleanType()),
]


def store(df: DataFrame, root: str, text_col: str = "text", shard_bytes: int = 1 << 28) -> DataFrame:
    """Writes the payload of each row to tar shards under ``root`` (any URI that pyarrow opens) and returns the index.

    The index has the other columns of ``df`` and n_bytes, digest, shard, offset, length and
    owner (the row whose payload was written; equal rows of a task share its address). Null text
    counts as empty; an empty text is one row of zero bytes. Columns with those names are replaced.
    """

    def start():
        files, base = pafs.FileSystem.from_uri(root)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        state: dict = {"n": 0, "out": None, "at": 0, "seen": {}}

        def shard() -> str:
            return f"shard-{task.partitionId():06d}-{task.taskAttemptId()}-{state['n']}.tar"

        def step(texts):
            cols: list[list] = [[] for _ in _ADDRESS]
            for t in texts.to_pylist():
                raw = (t or "").encode("utf-8", "surrogatepass")
                key = hashlib.sha256(raw).digest()
                own = key not in state["seen"]
                if own:
                    media = to_png(pad(raw))
                    digest = hashlib.sha256(media).hexdigest()
                    if state["out"] is None or state["at"] > shard_bytes:
                        if state["out"] is not None:
                            state["out"].write(b"\0" * 1024)
                            state["out"].close()
                            state["n"] += 1
                        state["out"], state["at"] = files.open_output_stream(f"{base}/{shard()}"), 0
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(media)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    state["out"].write(head + media + b"\0" * (-len(media) % 512))
                    state["seen"][key] = (digest, shard(), state["at"] + len(head), len(media))
                    state["at"] += len(head) + len(media) + -len(media) % 512
                for c, v in zip(cols, (len(raw), *state["seen"][key], own), strict=True):
                    c.append(v)
            return [pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]

        def close(*_):
            if state["out"] is not None:
                state["out"].write(b"\0" * 1024)
                state["out"].close()

        return step, close

    keep = [c for c in df.columns if c not in {f.name for f in _ADDRESS} and c != text_col]
    schema = T.StructType([*[df.schema[c] for c in keep], *_ADDRESS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, close = start()
        held = None
        for b in batches:
            made = step(b.column(text_col))
            if held is not None:
                yield held
            held = pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], names=[*keep, *(f.name for f in _ADDRESS)])
        close()  # the shard is whole before the last rows that refer to it leave the task
        if held is not None:
            yield held

    return written(df.mapInArrow(run, schema), "media-index")


def _ranges(root: str, span):
    """A function that reads ``span(offset, length)`` of each address; a shard stays open while the next address lies in it."""
    files, base = pafs.FileSystem.from_uri(root)
    opened: dict = {}

    def read(shard: str, offset: int, length: int) -> bytes:
        if shard not in opened:
            for f in opened.values():
                f.close()
            opened.clear()
            opened[shard] = files.open_input_file(f"{base}/{shard}")
        opened[shard].seek(offset)
        return opened[shard].read(span(length))

    return read


def read_headers(index: DataFrame, root: str) -> DataFrame:
    """``index`` with width, height and bits, from header-only range reads."""

    def start():
        read = _ranges(root, lambda n: min(n, HEADER_BYTES))

        def step(shard, offset, length):
            got = [png_header(read(*x)) for x in zip(shard.to_pylist(), offset.to_pylist(), length.to_pylist(), strict=True)]
            return [pa.array([g[k] for g in got], pa.int32()) for k in range(3)]

        return step

    fields = [T.StructField(n, T.IntegerType()) for n in ("width", "height", "bits")]
    return append_columns(index, Step(["shard", "offset", "length"], fields, start))


def read_features(index: DataFrame, root: str) -> DataFrame:
    """``index`` with what the stored payloads say: sizes, digests, the checksum of the last row and the feature."""

    def start():
        read = _ranges(root, lambda n: n)

        def step(shard, offset, length):
            out: list[list] = [[] for _ in range(6)]
            for x in zip(shard.to_pylist(), offset.to_pylist(), length.to_pylist(), strict=True):
                media = read(*x)
                payload = from_png(media)
                for c, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return [pa.array(v, t) for v, t in zip(out, kinds, strict=True)]

        return step

    kinds = {"payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType()}
    return append_columns(index, Step(["shard", "offset", "length"], [T.StructField(n, t) for n, t in kinds.items()], start))


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text, reads the stored bytes back and returns one row per row of ``docs`` with its media columns.

    Equal texts give equal values. Each address is read once; its rows (as many as one
    task has read, at most) get the values by a join on the address.
    """
    root = scratch(docs.sparkSession, "media")
    index = store(docs.select("doc_id", "text"), root)
    address = ["shard", "offset"]
    blobs = index.where("owner").select(*address, "length").repartitionByRange(partitions(docs.sparkSession), *address).sortWithinPartitions(*address)
    values = read_features(read_headers(blobs, root), root).drop("length", "bits")
    return index.join(values, address).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))
