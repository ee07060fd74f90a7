"""Ranked lexical search over a length-stratified index.

A document's score depends on its length only through the normaliser ``m``, a small whole number. Documents are cut into shards of bounded bytes; in a
shard they are grouped by equal ``m`` (a stratum), and a term's postings lie by stratum and, in it, by falling ``tf``. So

- an impact is computed once for each ``tf`` of a stratum, not for each document;
- the first ``tf`` of a stratum bounds what a term can give there, and the sum over an item's terms bounds the stratum;
- strata are visited by falling bound, and the visit ends where the bound is below the last score that an item keeps.

The index is a table with a row for each term of a shard, so a search reads the postings of its terms only. Shards are bounded, so neither a
frequent word nor a common length makes a task larger. A task searches its shards one after the other and keeps an item's best
documents over all of them; those few rows are all that is shuffled at the end. Items are handled in blocks of bounded bytes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import documents, partitions, text_bytes, written

#: What a term is made of (as a pattern, and as the bytes that separate terms), and the constants of the score.
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATORS = (*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))
WEIGHT, IMPACT, SATURATION, LENGTH, SHARE = 1000, 1_000_000_000, 1000, 12, 25
TOP = 20
#: Bytes of text in a shard, and of items in a block.
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 1 << 20
#: Strata visited at first, and how much more each further time.
_FIRST, _MORE = 16, 4

_LOWER = bytes(0x20 if b in SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_INDEX = T.StructType(
    [T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("df", T.LongType())]
    + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("m", "tf", "size", "docs")]
    + [T.StructField("doc_ids", T.ArrayType(T.LongType()))]
)


def terms(text: str) -> list[bytes]:
    """The terms of a text in UTF-8; only A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def normaliser(n: int, docs: int, length: int) -> int:
    return 100 - SHARE + (SHARE * n * docs) // length


def weight(df: int, docs: int) -> int:
    return math.floor(WEIGHT * math.log((2 * docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (IMPACT * tf) // (SATURATION * tf + LENGTH * m)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first does."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _list_of(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def shard_rows(shard: int, ids: list, words: list[list[bytes]], docs: int, length: int) -> pa.RecordBatch:
    """The index of a shard: first its documents by stratum (the row of the empty term), then a row for each term.

    ``size`` counts the documents of each stratum, or of each (stratum, tf), in the order of ``docs`` (places in ``doc_ids``).
    """
    m = [normaliser(len(w), docs, length) for w in words]
    order = sorted(range(len(ids)), key=lambda i: (m[i], ids[i] is None, ids[i] or 0))
    flat = pa.array([t for i in order for t in words[i]], pa.binary()).dictionary_encode()
    n, at = len(ids), np.repeat(np.arange(len(ids)), [len(words[i]) for i in order])
    key, tf = np.unique(flat.indices.to_numpy().astype(np.int64) * n + at, return_counts=True)
    code, doc = key // n, key % n
    level = np.array([m[i] for i in order], np.int64)
    place = np.lexsort((doc, -tf, level[doc], code))
    code, doc, tf = code[place], doc[place], tf[place]
    group = _runs(code, level[doc], tf)
    term = _runs(code)
    of_term = np.append(np.searchsorted(group, term), len(group))
    strata = _runs(level)
    first = {"shard": [shard], "term": [""], "df": [n], "m": [level[strata].tolist()], "tf": [[]], "size": [np.diff(np.append(strata, n)).tolist()], "docs": [[]], "doc_ids": [[ids[i] for i in order]]}
    head = pa.RecordBatch.from_pydict(first, schema=_ARROW)
    rows = [
        pa.array(np.full(len(term), shard)), flat.dictionary.cast(pa.string()).take(pa.array(code[term])), pa.array(np.diff(np.append(term, len(code)))),
        _list_of(level[doc[group]], of_term), _list_of(tf[group], of_term), _list_of(np.diff(np.append(group, len(code))), of_term), _list_of(doc, np.append(term, len(code))), pa.nulls(len(term), pa.list_(pa.int64())),
    ]
    return pa.Table.from_batches([head, pa.RecordBatch.from_arrays(rows, schema=_ARROW)]).combine_chunks().to_batches()[0]


_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), *[(n, pa.list_(pa.int32())) for n in ("m", "tf", "size", "docs")], ("doc_ids", pa.list_(pa.int64()))])


class Index:
    """A written index and the two numbers that all scores need: documents with terms, and their terms."""

    def __init__(self, table: DataFrame, docs: int, length: int):
        self.table, self.docs, self.length = table, docs, length


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Index:
    """Indexes every whole text of ``docs`` (doc_id, text). Null and empty texts, and those without terms, aren't found by anything; repeated rows are documents of their own."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(2, np.int64)
        for b in batches:
            for t in b.column("text"):
                k = len(terms(t.as_py() or ""))
                found += k > 0, k
        yield pa.RecordBatch.from_pydict({"n": found[:1], "length": found[1:]})

    n, length = docs.select("text").mapInArrow(count, "n long, length long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, held, k = [], [], 0, TaskContext.get().partitionId() << 24
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                found = terms(t.as_py() or "")
                if not found:
                    continue
                ids.append(i)
                words.append(found)
                held += sum(map(len, found)) + len(found)
                if held >= shard_bytes:
                    yield from _sliced(shard_rows(k, ids, words, n, length))
                    ids, words, held, k = [], [], 0, k + 1
        if ids:
            yield from _sliced(shard_rows(k, ids, words, n, length))

    return Index(written(docs.select("doc_id", "text").mapInArrow(run, _INDEX), "lexical-index"), n, length)


def _sliced(batch: pa.RecordBatch, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


class Best:
    """The highest scores of an item, equal ones by doc_id (null last)."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids, self.least = top, np.zeros(0, np.int64), np.zeros(0, object), 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        if len(scores) > self.top:
            cut = np.partition(scores, len(scores) - self.top)[len(scores) - self.top]
            likely = np.flatnonzero(scores >= cut)
            keep = sorted(likely.tolist(), key=lambda i: (-scores[i], ids[i] is None, ids[i] or 0))[: self.top]
            scores, ids = scores[keep], ids[keep]
            self.least = int(scores[-1])
        self.scores, self.ids = scores, ids


class Shard:
    """The postings of a shard for the terms of a block of items."""

    def __init__(self, doc_ids: list, m: np.ndarray, sizes: np.ndarray):
        self.ids = np.empty(len(doc_ids), object)
        self.ids[:] = doc_ids
        self.m = m
        self.stratum_of = np.repeat(np.arange(len(m)), sizes)
        self.postings: dict[str, tuple] = {}

    def add(self, term: str, m: np.ndarray, tf: np.ndarray, size: np.ndarray, docs: np.ndarray) -> None:
        gain = impacts(tf.astype(np.int64), m.astype(np.int64))
        stratum = np.searchsorted(self.m, m)
        top = _runs(stratum)  # the first group of a stratum has its greatest tf
        self.postings[term] = docs, np.repeat(gain, size), stratum[top], gain[top]

    def search(self, wanted: list[tuple[str, int]], best: Best) -> int:
        """Visits strata by falling bound while they may hold a better document; returns how many. ``wanted``: terms and their weights."""
        found = [(*self.postings[t], w) for t, w in wanted if t in self.postings and w]
        if not found:
            return 0
        bounds = _summed(np.concatenate([f[2] for f in found]), np.concatenate([f[3] * f[4] for f in found]), len(self.m))
        order = np.argsort(-bounds, kind="stable")
        order = order[: np.count_nonzero(bounds)]
        docs, gains = np.concatenate([f[0] for f in found]), np.concatenate([f[1] * f[4] for f in found])
        at, wave = 0, _FIRST
        while at < len(order) and bounds[order[at]] >= best.least:
            chosen = order[at : at + wave]
            chosen = chosen[bounds[chosen] >= best.least]
            visited = np.zeros(len(self.m), bool)
            visited[chosen] = True
            here = visited[self.stratum_of[docs]]
            scores = _summed(docs[here], gains[here], len(self.ids))
            some = np.flatnonzero(scores >= best.least)
            best.add(scores[some], self.ids[some])
            at, wave = at + len(chosen), wave * _MORE
        return at


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by place; in doubles where these hold them exactly."""
    if len(values) and float(values.max()) * len(values) < 1 << 53:
        return np.bincount(at, values, n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """(item_id, text) of ``items`` in blocks of about ``block_bytes``, one after the other."""
    items = items.select("item_id", "text", F.monotonically_increasing_id().alias("_row"))
    n = -(-text_bytes(items) // block_bytes)
    for k in range(n):
        yield [tuple(r) for r in items.where(F.col("_row") % n == k).select("item_id", "text").collect()]


def search(index: Index, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` documents of each row of ``items`` (item_id, text) with a score above 0: item_id, rank, doc_id, score.

    Equal scores go by doc_id, null last. An item's repeated terms count each time. A null or empty text finds nothing, and nor does an index without documents; repeated items, also of one id, are
    answered one by one. Other columns don't matter.
    """
    spark = items.sparkSession
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    ids = items.schema["item_id"]
    out = [spark.createDataFrame([], T.StructType([ids, T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))]
    for block in _blocks(items, block_bytes) if index.docs else ():
        counted = [Counter(t.decode("utf-8", "surrogatepass") for t in terms(text or "")) for _, text in block]
        known = sorted(set().union(*counted))
        if not known:
            continue
        # bounded by the block: its terms, and its items
        asked = F.broadcast(spark.createDataFrame([(t,) for t in ["", *known]], "term string"))
        df = dict(index.table.select("term", "df").where("term <> ''").join(asked, "term").groupBy("term").agg(F.sum("df")).collect())
        w = {t: weight(n, index.docs) for t, n in df.items()}
        wanted = spark.sparkContext.broadcast([[(t, q * w[t]) for t, q in c.items() if t in w] for c in counted])

        def run(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            best, shard, now = [Best(top) for _ in wanted.value], None, None
            for b in batches:
                lists = {n: (b.column(n).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(b.column(n).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])) for n in ("m", "tf", "size", "docs")}
                for k, (s, t) in enumerate(zip(b.column("shard").to_pylist(), b.column("term").to_pylist(), strict=True)):
                    m, tf, size, docs = (v[ends[k] : ends[k + 1]] for v, ends in lists.values())
                    if s != now:
                        if shard:
                            for each, place in zip(wanted.value, best, strict=True):
                                shard.search(each, place)
                        shard, now = Shard(b.column("doc_ids")[k].as_py(), m, size), s
                    else:
                        shard.add(t, m, tf, size, docs)
            if shard:
                for each, place in zip(wanted.value, best, strict=True):
                    shard.search(each, place)
            item = np.repeat(np.arange(len(best)), [len(x.scores) for x in best])
            columns = [pa.array(item, pa.int32()), pa.array([i for x in best for i in x.ids], pa.int64()), pa.array(np.concatenate([x.scores for x in best]), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

        hits = index.table.join(asked, "term").select(*[f.name for f in _INDEX])
        some = hits.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "term").mapInArrow(run, schema)
        place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = some.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
        named = F.broadcast(spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], T.StructType([T.StructField("item", T.IntegerType()), ids])))
        out.append(ranked.join(named, "item").select("item_id", "rank", "doc_id", "score"))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(documents(spark, sf_dir))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, ts, len(ts) AS n FROM d WHERE len(ts) > 0),
  g AS MATERIALIZED (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM l),
  t AS MATERIALIZED (SELECT doc_id, 75 + (25 * n * docs) // total AS m, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM l), g GROUP BY ALL),
  w AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, g GROUP BY term),
  q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
  s AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN t USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
