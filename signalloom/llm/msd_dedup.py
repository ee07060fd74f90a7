"""Exact dedup by distributed most-significant-digit radix partitioning.

Texts are equal when they are identical after white space is deleted. Groups are
split by successive bytes until they are singleton or their texts have ended; no
digest decides equality.

1. Map side: each batch of up to ``BATCH`` rows is split by radix and keeps one representative of
   each distinct text with the count and the best row.
2. Digits: ``DIGITS`` prefixes of the representatives are counted. A prefix with
   more than its share of the bytes is split by the next digit, and so on until no
   heavy group is left or its texts have ended. At most ``total / share`` prefixes
   are heavy, and they are joined as hashes of eight bytes, so what is broadcast is small whatever the data.
3. A group that is still heavy (a text that many batches hold) is dealt to SPREAD tasks first, each of which
   merges the representatives it gets: then at most SPREAD of a text are left.
4. Each group goes to a task by its shortest light prefix; there it's split on by
   successive bytes. Hashes only deal groups to tasks; equality is decided by bytes. A task holds the texts of its groups,
   about ``share`` bytes, which grows no further as partitions are added with the text. Members get the result of their representative by a join on
   the representative's id, of which a batch has at most as many as it read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import Step, append_columns, documents, numbered_columns, partitions, written

#: The white space that doesn't count, [\x20\x09-\x0D].
WHITE = b" \t\n\v\f\r"
#: Lengths of the prefixes that deal groups to tasks. Beyond the last, a group goes by its whole text.
DIGITS = (16, 64, 256, 1024, 4096, 16384)
#: Heavy prefixes that are broadcast at most (16 MB); with more, Spark plans the join.
BROADCAST_ROWS = 1 << 20


def radix_groups(texts: list[bytes]) -> Iterator[list[int]]:
    """Indices of equal texts, group by group: split by successive digits, wider ones deeper down."""
    stack = [(list(range(len(texts))), 0, 8)]
    while stack:
        rows, at, width = stack.pop()
        if len(rows) == 1:
            yield rows
            continue
        bins: dict[bytes, list[int]] = {}
        for i in rows:
            bins.setdefault(texts[i][at : at + width], []).append(i)
        for digit, group in bins.items():
            if len(group) == 1 or len(digit) < width:  # alone, or ended
                yield group
            else:
                stack.append((group, at + width, min(4 * width, 1 << 20)))


_HEAD, BATCH, SPREAD = 256, 10_000, 64
_LOCAL = [
    T.StructField("rep", T.LongType()),
    T.StructField("head", T.BinaryType()),
    T.StructField("count", T.LongType()),
    T.StructField("chars", T.LongType()),
    T.StructField("best", T.LongType()),
    T.StructField("best_id", T.LongType()),
]
_MERGED = "rep long, head binary, count long, chars long, best long, best_id long, text string, members array<long>"
_GROUP = "of long, keep_row long, keep_id long, group_size long, text_sha256 string"


def _bytes(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]


def _local():
    """For each row of a batch its representative; for representatives also the head of the text, the count and the best row."""

    def step(row, doc_id, text):
        raw, rows, ids = _bytes(text), row.to_pylist(), doc_id.to_pylist()
        chars = [len(t) if t.isascii() else sum(b & 0xC0 != 0x80 for b in t) if len(t) < 64 else len(t.decode("utf-8", "replace")) for t in raw]
        norm = [t.translate(None, WHITE) for t in raw]
        out: list[list] = [[None] * len(norm) for _ in _LOCAL]
        for group in radix_groups(norm):
            first = group[0]
            best = min(group, key=lambda i: (-chars[i], ids[i] is None, ids[i] or 0, rows[i]))
            for i in group:
                out[0][i] = rows[first]
            for k, v in enumerate((norm[first][:_HEAD], len(group), chars[best], rows[best], ids[best]), 1):
                out[k][first] = v
        return [pa.array(v, pa.binary() if f.dataType == T.BinaryType() else pa.int64()) for v, f in zip(out, _LOCAL, strict=True)]

    return step


def _deal(reps: DataFrame, share: float) -> DataFrame:
    """``reps`` with ``bin``, the hash of the shortest prefix of each text whose group has at most ``share`` bytes, and ``hot``: no such prefix, a text or its longest prefix is heavy."""
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", "").cast("binary")
    dealt = reps.withColumns({"bin": F.lit(None).cast("long"), "hot": F.lit(False)})
    for k, digit in enumerate(DIGITS):
        prefix = F.substring("head" if digit <= _HEAD else norm, 1, digit)
        key = F.xxhash64(F.lit(digit), prefix)
        weight = F.sum(F.octet_length("text") + 64)
        left = dealt.where("bin is null")
        heavy = written(left.groupBy(key.alias("key")).agg(weight.alias("w"), (F.max(F.length(prefix)) < digit).alias("ended")).where(F.col("w") > share).select("key", "ended"), "exact-heavy")
        n_heavy = heavy.count()
        last = F.lit(k + 1 == len(DIGITS)) | F.col("ended")
        marked = dealt.withColumn("key", key).join(F.broadcast(heavy) if n_heavy <= BROADCAST_ROWS else heavy, "key", "left")
        light = F.col("bin").isNull() & (F.col("ended").isNull() | last)
        dealt = marked.withColumns({"hot": F.col("hot") | (F.col("bin").isNull() & F.coalesce(last & F.col("ended").isNotNull(), F.lit(False))), "bin": F.when(light, F.col("key")).otherwise(F.col("bin"))}).drop("key", "ended")
        if not n_heavy:
            break
    return dealt


def _read(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> tuple[list[bytes], list[list]]:
    """The normalised texts of a task's rows, and columns of theirs."""
    norm: list[bytes] = []
    cols: list[list] = [[] for _ in names]
    for b in batches:
        norm += [t.translate(None, WHITE) for t in _bytes(b.column("text"))]
        for values, n in zip(cols, names, strict=True):
            values += b.column(n).to_pylist()
    return norm, cols


def _best(group: list[int], chars: list, ids: list, best: list) -> int:
    return min(group, key=lambda i: (-chars[i], ids[i] is None, ids[i] or 0, best[i]))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One representative for the equal texts of a task, with those that it stands for."""
    norm, (rep, count, chars, best, ids) = _read(batches, ("rep", "count", "chars", "best", "best_id"))
    out: list[list] = [[] for _ in range(8)]
    for group in radix_groups(norm):
        top = _best(group, chars, ids, best)
        row = (rep[group[0]], norm[top][:_HEAD], sum(count[i] for i in group), chars[top], best[top], ids[top], norm[top].decode("utf-8", "surrogatepass"), [rep[i] for i in group])
        for column, v in zip(out, row, strict=True):
            column.append(v)
    kinds = (pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=[x.split()[0] for x in _MERGED.split(", ")])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups of a task's bins: one row for each representative."""
    norm, (rep, count, chars, best, ids) = _read(batches, ("rep", "count", "chars", "best", "best_id"))
    out: list[list] = [[] for _ in range(5)]
    for group in radix_groups(norm):
        top = _best(group, chars, ids, best)
        same = (best[top], ids[top], sum(count[i] for i in group), hashlib.sha256(norm[top]).hexdigest())
        for i in group:
            for column, v in zip(out, (rep[i], *same), strict=True):
                column.append(v)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=[x.split()[0] for x in _GROUP.split(", ")])


def exact_groups(docs: DataFrame) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256.

    Null texts count as empty, and equal each other and texts of white space. Of equal
    texts the row with the most code points stays, then the smallest doc_id (null
    last), then the first row read; rows that are repeated whole count one by one.
    Columns of ``docs`` with the names of the result are replaced, all others kept. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    new = ("keep_id", "group_size", "kept", "text_sha256")
    work, names, now = numbered_columns(docs, new)
    doc_id, text = now["doc_id"], now["text"]
    work = work.withColumn("row", F.monotonically_increasing_id())
    local = written(append_columns(work, Step(["row", doc_id, text], _LOCAL, _local), rows=BATCH), "exact-local")
    reps = local.where("count is not null").select(F.coalesce(text, F.lit("")).alias("text"), *[f.name for f in _LOCAL])
    total = reps.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = partitions(spark, total)
    dealt = _deal(reps, max(1, total / n))
    # texts that many batches hold: merged in SPREAD tasks first
    hot = dealt.where("hot").repartition(n, "bin", F.pmod(F.xxhash64("rep"), F.lit(SPREAD))).select("text", *[f.name for f in _LOCAL if f.name != "head"])
    merged = written(hot.mapInArrow(_merge, _MERGED), "exact-merged")
    one = merged.select("text", "rep", "count", "chars", "best", "best_id", F.xxhash64("head").alias("bin"))
    rest = dealt.where("not hot").select("text", "rep", "count", "chars", "best", "best_id", "bin")
    groups = rest.unionByName(one).repartition(n, "bin").drop("bin").mapInArrow(_groups, _GROUP)
    members = merged.select(F.col("rep").alias("of"), F.explode("members").alias("member"))
    result = [x.split()[0] for x in _GROUP.split(", ")][1:]
    if merged.isEmpty():
        told = groups
    else:
        groups = written(groups, "exact-groups")
        told = groups.join(members, "of", "left").select(F.coalesce("member", "of").alias("of"), *result)
    kept = F.col("row") == F.col("keep_row")
    return local.join(told, F.col("rep") == F.col("of")).select(*[F.col(n_).alias(c) for n_, c in zip(now.values(), names, strict=True)], "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay (see ``exact_groups``), with the columns of ``docs`` and their values: one row of each distinct text.

    Columns named like a result of ``exact_groups`` are handed through as they are.
    """
    work, names, now = numbered_columns(docs)
    kept = exact_groups(work.withColumnsRenamed({now["doc_id"]: "doc_id", now["text"]: "text"})).where("kept")
    back = {now["doc_id"]: "doc_id", now["text"]: "text"}
    return kept.select(*[F.col(back.get(n, n)).alias(c) for n, c in zip(now.values(), names, strict=True)])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS chars FROM documents
), r AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
