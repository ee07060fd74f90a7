"""Token-ID output: a wavelet matrix for each shard.

A shard file holds the ids of whole documents in order. Plane ``l`` of the matrix has one bit for each token: the ``l``-th highest bit of its id, after the tokens
were dealt stably by the bits before. The planes are cut into blocks, compressed one by one, and a directory has each block's place and the
ones before it. So from one compressed file, reading only the blocks that are needed,

- ``access`` gives tokens by place (a rank for each plane),
- ``rank`` and ``count`` say how often a token occurs before a place, or in all,
- ``occurrences`` finds the places of a token (a select for each plane, from the last to the first),
- ``ids`` reads all tokens, by undoing the deals from the last plane to the first.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import documents, partitions, scratch, text_bytes, written
from .bpe import _WS

MAGIC = b"SLWMTX1\n"
#: Bits of a plane in a block; tokens after which a shard is closed; the id behind each document; bytes of text encoded at a time.
BLOCK, SHARD_TOKENS, END, _BATCH_BYTES = 1 << 17, 1 << 24, 0, 4 << 20


def pack(ids: np.ndarray, doc_ids: list, lengths: list[int]) -> bytes:
    """A shard file: blocks of the planes, then the directory, then its place."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    zip_, out, at = zstandard.ZstdCompressor(level=1), [MAGIC], len(MAGIC)
    ends, ones, zeros = [], [], []
    for shift in range(bits - 1, -1, -1):
        bit = (x & x.dtype.type(1 << shift)) != 0
        packed = np.packbits(bit)
        for k in range(0, len(packed), BLOCK // 8):
            block = zip_.compress(packed[k : k + BLOCK // 8].tobytes())
            out.append(block)
            at += len(block)
            ends.append(at)
        ones.append(np.array([np.bitwise_count(packed[k : k + BLOCK // 8]).sum(dtype=np.int64) for k in range(0, len(packed), BLOCK // 8)], np.int64))
        low = np.compress(~bit, x)
        zeros.append(len(low))
        x = np.concatenate([low, np.compress(bit, x)])
    known = np.array([i is not None for i in doc_ids], bool)
    tables = (np.array(ends, np.int64), np.concatenate(ones), np.array([i or 0 for i in doc_ids], np.int64), known, np.array(lengths, np.int64))
    head = json.dumps({"tokens": len(ids), "bits": bits, "documents": len(doc_ids), "zeros": zeros}).encode()
    directory = zip_.compress(struct.pack("<I", len(head)) + head + b"".join(t.tobytes() for t in tables))
    return b"".join([*out, directory, struct.pack("<QQ", at, len(directory)), MAGIC])


class WaveletFile:
    """A shard file that is read in ranges: ``read(offset, length)``; ``size`` bytes in all. ``held`` blocks are kept."""

    def __init__(self, read: Callable[[int, int], bytes], size: int, held: int = 64):
        self.read, self.blocks, self.held = read, OrderedDict(), held
        tail = read(size - 16 - len(MAGIC), 16 + len(MAGIC))
        if tail[16:] != MAGIC:
            raise ValueError("not a wavelet file")
        at, length = struct.unpack("<QQ", tail[:16])
        raw = zstandard.ZstdDecompressor().decompress(read(at, length))
        (n,) = struct.unpack_from("<I", raw)
        head, at = json.loads(raw[4 : 4 + n]), 4 + n
        self.tokens, self.bits, self.zeros = head["tokens"], head["bits"], head["zeros"]
        self.per_plane = -(-self.tokens // BLOCK)

        def table(kind, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(raw, kind, count, at)
            at += found.nbytes
            return found

        self.ends = np.concatenate([[len(MAGIC)], table(np.int64, self.bits * self.per_plane)])
        self.ones = table(np.int64, self.bits * self.per_plane).reshape(self.bits, self.per_plane)
        self.before = np.concatenate([np.zeros((self.bits, 1), np.int64), np.cumsum(self.ones, axis=1)], axis=1)
        ids, known = table(np.int64, head["documents"]), table(bool, head["documents"])
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(table(np.int64, head["documents"]))])

    def _bits(self, plane: int, block: int) -> np.ndarray:
        k = plane * self.per_plane + block
        data = zstandard.ZstdDecompressor().decompress(self.read(int(self.ends[k]), int(self.ends[k + 1] - self.ends[k])), max_output_size=BLOCK // 8)
        return np.unpackbits(np.frombuffer(data, np.uint8), count=min(BLOCK, self.tokens - block * BLOCK))

    def _block(self, plane: int, block: int) -> np.ndarray:
        """How many ones a block has before each of its bits, and at last in all."""
        key = plane, block
        if key in self.blocks:
            self.blocks.move_to_end(key)
            return self.blocks[key]
        self.blocks[key] = np.concatenate([[0], np.cumsum(self._bits(plane, block), dtype=np.int32)])
        if len(self.blocks) > self.held:
            self.blocks.popitem(last=False)
        return self.blocks[key]

    def _ones(self, plane: int, at: np.ndarray) -> np.ndarray:
        """rank: the ones of a plane before each place."""
        out, block = np.empty(len(at), np.int64), np.minimum(at // BLOCK, max(0, self.per_plane - 1))
        for b in np.unique(block):
            here = block == b
            out[here] = self.before[plane, b] + self._block(plane, b)[at[here] - b * BLOCK]
        return out

    def _select(self, plane: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """select: the places of the ``nth`` (from 0) ones or zeros of a plane."""
        before = self.before[plane] if bit else np.arange(self.per_plane + 1) * BLOCK - self.before[plane]
        block, out = np.searchsorted(before[1 : self.per_plane], nth, "right"), np.empty(len(nth), np.int64)
        for b in np.unique(block):
            here, ones = block == b, self._block(plane, b)
            upto = ones if bit else np.arange(len(ones)) - ones
            out[here] = b * BLOCK + np.searchsorted(upto, nth[here] - before[b] + 1) - 1
        return out

    def access(self, places) -> np.ndarray:
        """The tokens at some places."""
        at = np.asarray(places, np.int64)
        out = np.zeros(len(at), np.int64)
        if len(at) and not (at.min() >= 0 and at.max() < self.tokens):
            raise IndexError("no such token")
        for plane in range(self.bits):
            ones = self._ones(plane, at)
            bit = self._ones(plane, at + 1) > ones
            out = out << 1 | bit
            at = np.where(bit, self.zeros[plane] + ones, at - ones)
        return out

    def document(self, k: int) -> np.ndarray:
        """The tokens of the ``k``-th document."""
        return self.access(np.arange(self.starts[k], self.starts[k + 1]))

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where, after all deals, those of the first ``end`` tokens lie that are ``token``."""
        if token < 0 or token >> self.bits:
            return 0, 0
        span = np.array([0, end], np.int64)
        for plane in range(self.bits):
            ones = self._ones(plane, span)
            span = self.zeros[plane] + ones if token >> (self.bits - 1 - plane) & 1 else span - ones
        return int(span[0]), int(span[1])

    def rank(self, token: int, end: int) -> int:
        """How often ``token`` occurs before the place ``end``."""
        low, high = self._range(token, end)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.tokens)

    def occurrences(self, token: int, first: int = 0, most: int | None = None) -> np.ndarray:
        """The places of ``token`` in rising order, from its ``first`` occurrence, at most ``most``."""
        low, high = self._range(token, self.tokens)
        at = np.arange(low + first, high if most is None else min(high, low + first + most))
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            at = self._select(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """All tokens."""
        x = np.zeros(self.tokens, np.uint16 if self.bits <= 16 else np.uint32)
        for plane in range(self.bits - 1, -1, -1):
            bit = np.concatenate([self._bits(plane, b) for b in range(self.per_plane)]).view(bool) if self.tokens else np.zeros(0, bool)
            back = np.empty_like(x)
            back[np.flatnonzero(~bit)], back[np.flatnonzero(bit)] = x[: self.zeros[plane]], x[self.zeros[plane] :]
            x = back | (bit.astype(x.dtype) << x.dtype.type(self.bits - 1 - plane))
        return x


#: White space of Python and of the tokenizers, apart from the space.
_OTHER_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BESIDE = rf"(?:^|[ {_OTHER_SPACE}]) | (?:$|[{_OTHER_SPACE}])"
#: The byte-level alphabet: bytes that print stand for themselves, the others follow from U+0100 on.
_PRINTS = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_ALPHABET = "".join(chr(b) if b in _PRINTS else chr(0x100 + sum(c not in _PRINTS for c in range(b))) for b in range(256))
_POINT = re.compile(r"[!-/:-@\[-`{-~]")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The function that cuts a text into pre-tokens; white space is Unicode's, which the regex module sees differently."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{_WS}").replace(r"(?!\S)", f"(?![^{_WS}])").replace(r"\s+", f"[{_WS}]+")).findall


class _Pieces(dict):
    """Number of each piece that a space precedes, and, behind a line feed, of each that begins a text; the ids of a new one go to the end of ``flat``."""

    def __init__(self, split: Callable[[str], list[str]], model):
        super().__init__()
        self.split, self.model, self.points, self.flat, self.ends = split, model, {}, array("I"), array("q", [0])

    def _encode(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(_ALPHABET))]

    def __missing__(self, piece: str) -> int:
        if piece.isalpha():  # one pre-token
            self.flat.extend(self._encode(f" {piece}"))
        elif piece[:-1].isalpha() and _POINT.match(piece[-1]):  # two
            k, point = self[piece[:-1]], piece[-1]
            if point not in self.points:
                self.points[point] = self._encode(point)
            self.flat.extend(self.flat[self.ends[k] : self.ends[k + 1]])
            self.flat.extend(self.points[point])
        elif piece:
            for word in self.split(piece[1:] if piece[0] == "\n" else f" {piece}"):
                self.flat.extend(self._encode(word))
        self.ends.append(len(self.flat))
        k = self[piece] = len(self)
        return k


class Encoder:
    """Ids by a byte-level BPE file of the tokenizers library.

    A space between two characters that aren't white space begins a pre-token whatever is around, so a text may be cut there. The distinct pieces of a batch of
    texts are looked up in a bounded table; a new one is cut by ``pattern`` and its pre-tokens are encoded by the library's model. Files with other parts
    than a plain byte-level BPE's would encode differently and are refused.
    """

    def __init__(self, path: str, pattern: str, cache: int = 400_000, window: int = 1 << 20):
        from tokenizers import Tokenizer

        spec = Tokenizer.from_file(path)
        kind = json.loads(spec.to_str())
        split = kind.get("pre_tokenizer") or {}
        if kind.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE file")
        self.model, self.split, self.cache, self.window = spec.model, splitter(pattern), cache, window
        self.pieces, self.hits = _Pieces(self.split, self.model), np.zeros(2 * cache, np.int32)

    def _trim(self) -> None:
        """Keeps the pieces that several batches had, at most half of the table."""
        old, hits, words = self.pieces, self.hits, list(self.pieces)
        keep = np.flatnonzero(hits[: len(old)] > 1)
        keep = np.sort(keep[np.argsort(-hits[keep], kind="stable")[: self.cache // 2]])
        self.pieces, self.hits = _Pieces(self.split, self.model), np.zeros(2 * self.cache, np.int32)
        self.hits[: len(keep)] = 1
        for k in keep.tolist():
            self.pieces.flat.extend(old.flat[old.ends[k] : old.ends[k + 1]])
            self.pieces.ends.append(len(self.pieces.flat))
            self.pieces[words[k]] = len(self.pieces)

    def _windows(self, text: str) -> Iterator[str]:
        """A long text in parts, cut where it may be; without such a place it stays whole."""
        at = 0
        while len(text) - at > self.window:
            cut = _CUT.search(text, at + self.window)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _pieces_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of texts without other white space beside a space, and how many each text has."""
        lists = pc.split_pattern(texts, " ")
        flat, sizes = lists.flatten().dictionary_encode(), lists.value_lengths().to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.pieces.__getitem__, flat.dictionary.to_pylist()), np.int64, len(flat.dictionary))
        if len(self.pieces) > len(self.hits):
            self.hits = np.concatenate([self.hits, np.zeros(len(self.pieces), np.int32)])
        self.hits[number] += 1
        k, first = number[flat.indices.to_numpy()], np.cumsum(sizes) - sizes
        k[first] = [self.pieces[f"\n{p}"] for p in flat.take(pa.array(first)).to_pylist()]
        return k, sizes

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one behind the other, without special tokens (their strings are ordinary text), and how many each text has. Null counts as empty."""
        if len(self.pieces) > self.cache or len(self.pieces.flat) > 16 * self.cache:
            self._trim()
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, _BESIDE), pc.greater(pc.binary_length(texts), self.window)).to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(texts), np.int64)
        plain, sizes[~odd] = self._pieces_of(texts.filter(pa.array(~odd))) if not odd.all() else (np.zeros(0, np.int64), 0)
        others: list[int] = []
        for i in np.flatnonzero(odd):
            before = len(others)
            for part in self._windows(texts[i].as_py()):
                found = _CUT.split(part)
                found[0] = f"\n{found[0]}"
                others += map(self.pieces.__getitem__, found)
            sizes[i] = len(others) - before
        k = np.empty(sizes.sum(), np.int64)
        mine = np.repeat(odd, sizes)
        k[~mine], k[mine] = plain, others
        ends = np.frombuffer(self.pieces.ends, np.int64)
        start, n = ends[k], ends[k + 1] - ends[k]
        upto = np.cumsum(n)
        out = np.frombuffer(self.pieces.flat, np.uint32)[np.arange(n.sum()) + np.repeat(start - upto + n, n)]
        return out, np.diff(np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(sizes)])])


def write_shards(docs: DataFrame, root: str, tokenizer: str, pattern: str, shard_tokens: int = SHARD_TOKENS, end: int = END) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes shard files under ``root``: shard, part, k, documents, tokens.

    Files and what they hold are in ascending order of doc_id (null last; equal ids by the text's hash, then as they are read), by (part, k). Null text counts as empty; each document ends with
    ``end``. A document lies in one file. A file is named after the attempt of the task that wrote it, so what a lost attempt leaves behind is never referred to.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text").asc(), F.col("row").asc()]
    sorted_ = rows.repartitionByRange(partitions(docs.sparkSession, text_bytes(docs)), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(root)
        files.create_dir(base, recursive=True)
        task, encoder = TaskContext.get(), _encoder(tokenizer, pattern)
        ids, lengths, parts, held, k = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}-{k}.wmx"
            with files.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(pack(np.concatenate(parts), ids, lengths))
            return pa.RecordBatch.from_pydict({"shard": [name], "part": [task.partitionId()], "k": [k], "documents": [len(ids)], "tokens": [held]}, schema=_SHARDS)

        for b in batches:
            upto = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                rows = max(1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _BATCH_BYTES)) - at)
                found, n = encoder.ids(b.column("text").slice(at, rows))
                last = np.cumsum(n + 1) - 1
                parts.append(np.insert(found, last - np.arange(len(n)), end))
                ids += b.column("doc_id").slice(at, rows).to_pylist()
                lengths += (n + 1).tolist()
                held, at = held + len(parts[-1]), at + rows
                if held >= shard_tokens:
                    yield close()
                    ids, lengths, parts, held, k = [], [], [], 0, k + 1
        if ids:
            yield close()

    return written(sorted_.mapInArrow(run, "shard string, part int, k int, documents long, tokens long"), "wavelet-shards")


_SHARDS = pa.schema([("shard", pa.string()), ("part", pa.int32()), ("k", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())])
_LOADED: dict = {}


def _encoder(path: str, pattern: str) -> Encoder:
    """One encoder in a Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder(path, pattern)
    return _LOADED[path, pattern]


def open_shard(root: str, name: str) -> WaveletFile:
    """A shard file under ``root``, read in ranges."""
    files, base = pafs.FileSystem.from_uri(root)
    source = files.open_input_file(f"{base}/{name}")
    return WaveletFile(lambda at, n: source.read_at(n, at), source.size())


def read_documents(spark: SparkSession, shards: DataFrame, root: str) -> DataFrame:
    """What the shard files hold: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The driver adds up the tokens of the files: a row for each file, that is for some 16 million tokens.
    """
    listed = sorted((r["part"], r["k"], r["shard"], r["tokens"]) for r in shards.collect())
    starts = np.concatenate([[0], np.cumsum([r[3] for r in listed], dtype=np.int64)]).tolist()
    files = spark.createDataFrame([(r[2], s) for r, s in zip(listed, starts, strict=False)], "shard string, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                file = open_shard(root, name)
                ids = file.ids().astype("<u4")
                ends = file.starts.tolist()
                crc = [zlib.crc32(ids[a:e]) for a, e in zip(ends, ends[1:])]
                columns = [pa.array(file.doc_ids, pa.int64()), pa.array(start + file.starts[:-1]), pa.array(np.diff(file.starts)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(max(1, min(len(listed), 10_000)), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, **options: int) -> DataFrame:
    """Writes the ids of ``docs`` to shard files in the shared folder and returns what they hold (see ``read_documents``), one row for each row of ``docs``.

    Null and empty texts have the end id alone; repeated rows are written one by one; an empty table gives an empty one; other columns don't matter.
    """
    import public_tokenizers

    spark = docs.sparkSession
    root = scratch(spark, "wavelet")
    shards = write_shards(docs, root, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, **options)
    return read_documents(spark, shards, root)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir))
