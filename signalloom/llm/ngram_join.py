"""Jaccard join on word 5-grams by vertical partitioning.

The global order of n-grams (by hash) is cut into fragments; a document's set is cut with it.

1. Each fragment is one task's work: it sees the segments of all documents, finds
   the n-grams that two documents or more share, and counts them for each document
   apart from the other fragments. Summed per document, a document that shares
   fewer than 3/4 of its n-grams has no partner and leaves.
2. Among the rest, n-grams are ordered by document frequency; two linked sets share one of
   their rarest ones (prefix filter). Every document is first compared with one hub of each
   bucket it is in; partial overlaps are counted by fragment and summed per pair.
3. What isn't connected yet but shares a bucket is compared too: pair by pair in small buckets, and
   block by block, again fragment by fragment of the order, in large ones. Comparisons stay inside a bucket,
   or inside several that hold nearly the same documents. No candidate is left out.

Copies within a batch are collapsed before anything is shuffled. Segments carry 48 bits of an n-gram's hash beside
its fragment: 55 bits with 100 fragments, all 64 from 65,536 on; the number of fragments grows with the text.
A bucket that holds far more documents than others is spread over tasks before it is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import documents, fresh, partitions, text_bytes, written
from .components import components

N = 5
#: Bucket size beyond which documents are compared in blocks of BLOCK; columns of one partial product.
LARGE, BLOCK, SLICE = 64, 512, 4096
#: Fragments (ranges of the order) of the partial overlaps of single pairs.
PARTS = 4
#: Into how many parts a large bucket is dealt for a join; how many of the largest buckets, by partition.
SPREAD, LARGEST = 64, 4
#: Most of these buckets that are broadcast, whatever the partitions (24 MB); those beyond aren't spread.
MOST_HOT = 1 << 20
#: Bytes of text that are cut into n-grams at a time, and how many times as many partitions as for plain text there are: a task holds the n-grams of its fragments.
CUT_BYTES, FINER = 8 << 20, 4

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_PLACE = _mix(np.arange(1, 65, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_GRAM = _mix(np.arange(101, 101 + N, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The set of each text: sorted distinct 64-bit hashes of its 5-word n-grams; with fewer words, of all of them."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    ends_at = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))  # of each text, in data
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return [np.zeros(0, _U) for _ in texts]
    # hash of each word: a sum over its bytes by place; from the 65th on by place and by how often the places were used
    size = ends - starts
    letters = data[~space]
    at = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
    terms = (_LOWER[letters].astype(_U) + _U(1)) * _PLACE[at & 63]
    if size.max() > 64:
        terms = np.where(at >= 64, _mix(terms + (at >> 6).astype(_U)), terms)
    word = _mix(np.add.reduceat(terms, np.cumsum(size) - size) + size.astype(_U))
    first = np.searchsorted(starts, np.concatenate([[0], ends_at[:-1]]))
    last = np.append(first[1:], len(starts))
    grams = np.zeros(max(0, len(word) - N + 1), _U)
    for k in range(N):
        grams += word[k : k + len(grams)] * _GRAM[k]
    grams = _mix(grams)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= N:
            g = np.sort(grams[a : b - N + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            h = np.array([b - a], _U)
            for k in range(a, b):
                h = _mix(h + word[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, _U))
    return out


# --- 1: fragments -----------------------------------------------------------------------------------------------------

#: kind 0: a row of the table; kind 1: the segments of a batch in one fragment.
_SENT = "kind int, fragment int, row long, doc_id long, rep long, n int, rows binary, sizes binary, ns binary, hashes binary"
#: kind 0: a row of the table; kind 1: what the documents of a bucket share with others in a task's fragments.
_SHARED = "kind int, row long, doc_id long, rep long, n int, bucket int, rows binary, sizes binary, ns binary, tokens binary"


def _by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about CUT_BYTES of text, a longer text alone."""
    for b in batches:
        upto, at = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)), 0
        while at < b.num_rows:
            rows = max(1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CUT_BYTES)) - at)
            yield b.slice(at, rows)
            at += rows


def _cut(fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _by_bytes(batches):
            rows, ids = b.column("row").to_numpy(zero_copy_only=False), b.column("doc_id").to_pylist()
            sets: list[np.ndarray] = []
            part, size = [], 0
            for t in b.column("text"):
                part.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(part[-1])
                if size > 1 << 21:
                    sets += shingles(part)
                    part, size = [], 0
            sets += shingles(part)
            seen: dict[bytes, int] = {}
            rep = [int(rows[seen.setdefault(s.tobytes(), k)]) if len(s) else int(rows[k]) for k, s in enumerate(sets)]
            own = [k for k, s in enumerate(sets) if len(s) and rep[k] == rows[k]]
            n = len(rows)
            spread = rows % fragments  # rows of the table travel with the fragments
            yield _record([0] * n, spread.tolist(), rows.tolist(), ids, rep, [len(s) for s in sets], *[[None] * n] * 4)
            if not own:
                continue
            sizes = np.array([len(sets[k]) for k in own])
            hashes = np.concatenate([sets[k] for k in own])
            doc = np.repeat(np.arange(len(own)), sizes)
            frag = ((hashes >> _U(32)) * _U(fragments) >> _U(32)).astype(np.int64)
            order = np.argsort(frag, kind="stable")
            low = hashes[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            doc, frag = doc[order], frag[order]
            cuts = np.flatnonzero(np.diff(frag, prepend=-1, append=-1))
            out: list[list] = [[] for _ in range(5)]
            own_rows = rows[own].astype(np.int64)
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                d, c = np.unique(doc[a:z], return_counts=True)
                for column, v in zip(out, (int(frag[a]), own_rows[d].tobytes(), c.astype(np.int32).tobytes(), sizes[d].astype(np.int32).tobytes(), low[a:z].tobytes()), strict=True):
                    column.append(v)
            m = len(out[0])
            yield _record([1] * m, out[0], *[[None] * m] * 4, *out[1:])

    return run


def _record(*columns) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
    names = [x.split()[0] for x in _SENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _share(buckets: int, fragments: int):
    """The shared n-grams of each document in a task's fragments, packed by the bucket that puts them together."""
    names = [x.split()[0] for x in _SHARED.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]

    def record(length: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(length, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sizes, ns, keys = [], [], [], []
        for b in batches:
            is_row = b.column("kind").to_numpy() == 0
            if is_row.any():
                t = b.filter(pa.array(is_row))
                yield record(t.num_rows, {c: t.column(c) for c in ("kind", "row", "doc_id", "rep", "n")})
            t = b.filter(pa.array(~is_row))
            for f, r, s, n, h in zip(*(t.column(c).to_pylist() for c in ("fragment", "rows", "sizes", "ns", "hashes")), strict=True):
                rows.append(np.frombuffer(r, np.int64))
                sizes.append(np.frombuffer(s, np.int32))
                ns.append(np.frombuffer(n, np.int32))
                six = np.frombuffer(h, np.uint8).reshape(-1, 6)
                wide = np.zeros((len(six), 8), np.uint8)
                wide[:, :6] = six
                wide.view("<u2")[:, 3] = f if fragments <= 1 << 16 else f * (1 << 16) // fragments
                keys.append(wide.view("<i8")[:, 0])
        if not keys:
            return
        row, size, n, key = (np.concatenate(x) for x in (rows, sizes, ns, keys))
        del rows, sizes, ns, keys
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        shared = np.zeros(len(key), bool)
        shared[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        count = np.add.reduceat(shared.astype(np.int32), np.cumsum(size) - size)
        bucket = (_mix(row.astype(_U)) % _U(buckets)).astype(np.int64)
        segment = np.repeat(np.arange(len(row)), size)[shared]
        values = key[shared][np.argsort(bucket[segment], kind="stable")]
        keep = np.flatnonzero(count)
        keep = keep[np.argsort(bucket[keep], kind="stable")]
        cuts = np.flatnonzero(np.diff(bucket[keep], prepend=-1, append=-1))
        ends = np.concatenate([[0], np.cumsum(count[keep])])
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            at = keep[a:z]
            blobs = {"rows": row[at].tobytes(), "sizes": count[at].astype(np.int32).tobytes(), "ns": n[at].astype(np.int32).tobytes(), "tokens": values[ends[a] : ends[z]].tobytes()}
            yield record(1, {"kind": pa.array([1], pa.int32()), "bucket": pa.array([int(bucket[keep[a]])], pa.int32())} | {c: pa.array([v], pa.binary()) for c, v in blobs.items()})

    return run


def _able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shared n-grams of each document of a task, put together; documents that share fewer than 3/4 of theirs leave."""
    parts = [[np.frombuffer(x, t) for x, t in zip(blobs, (np.int64, np.int32, np.int32, np.int64), strict=True)] for b in batches for blobs in zip(*(b.column(c).to_pylist() for c in ("rows", "ns", "sizes", "tokens")), strict=True)]
    if not parts:
        return
    row, n, size, values = (np.concatenate([p[k] for p in parts]) for k in range(4))
    begin = np.cumsum(size) - size
    order = np.argsort(row, kind="stable")
    first = np.flatnonzero(np.diff(row[order], prepend=-1))
    shared = np.add.reduceat(size[order], first)
    keep = 4 * shared >= 3 * n[order][first]
    ends = np.append(first[1:], len(order))
    lists = [np.concatenate([values[begin[k] : begin[k] + size[k]] for k in order[a:z]]) for a, z in zip(first[keep].tolist(), ends[keep].tolist(), strict=True)]
    if lists:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(lists)))
        yield pa.RecordBatch.from_arrays([pa.array(row[order][first][keep]), pa.array(n[order][first][keep]), made], names=["row", "n", "tokens"])


# --- 2: candidates ----------------------------------------------------------------------------------------------------


def _enough(a: str, b: str) -> str:
    """The sizes allow a similarity of 3/4."""
    return f"4 * least({a}, {b}) >= 3 * greatest({a}, {b})"


def _linked(pairs: DataFrame, sets: DataFrame, fragments: int) -> DataFrame:
    """Those of ``pairs (a, b)`` with 100 * intersection >= 75 * union: partial overlaps by range of the order, summed per pair."""
    most = min(fragments, 1 << 16)

    def segment(k: int):
        return F.filter("tokens", lambda t: F.floor(F.shiftrightunsigned(t, 48) * PARTS / most) == k)

    part = sets.select("row", "n", F.posexplode(F.array(*map(segment, range(PARTS)))).alias("part", "segment"))
    left = part.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("part").alias("pa"), F.col("segment").alias("sa"))
    right = part.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("part").alias("pb"), F.col("segment").alias("sb"))
    cut = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    one = cut.join(left, (cut["a"] == left["a"]) & (cut["part"] == left["pa"])).select(cut["a"], "b", "part", "na", "sa")
    two = one.join(right, (one["b"] == right["b"]) & (one["part"] == right["pb"]))
    overlap = two.groupBy("a", one["b"], "na", "nb").agg(F.sum(F.size(F.array_intersect("sa", "sb"))).alias("o"))
    return overlap.where("7 * o >= 3 * (na + nb)").select("a", "b")


def _with_bucket(rows: DataFrame, buckets: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows (keys, row, ...)`` joined with the row of ``buckets (keys, size, ...)``; the largest buckets are spread over SPREAD keys.

    At most LARGEST * n of them, and never more than MOST_HOT, are broadcast, whatever the data.
    """
    hot = F.broadcast(buckets.orderBy(F.desc("size"), *keys).limit(min(LARGEST * n, MOST_HOT)).select(*keys, F.lit(True).alias("hot")))
    salted = rows.join(hot, list(keys), "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(SPREAD))).otherwise(F.lit(0).cast("long"))).drop("hot")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    spread = buckets.join(hot, list(keys), "left").withColumn("salt", F.explode(salts)).drop("hot")
    return salted.join(spread, [*keys, "salt"]).drop("salt")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between documents of different labels in each block pair: overlaps summed over slices of the order; of the links, a spanning forest."""
    groups: dict[tuple, list] = {}
    for b in batches:
        for g, i, j, side, row, n, label, tokens in zip(*(b.column(c).to_pylist() for c in ("group", "i", "j", "side", "row", "n", "label")), b.column("tokens"), strict=True):
            groups.setdefault((g, i, j), []).append((side, row, n, label, tokens.values.to_numpy()))
    for docs in groups.values():
        docs.sort(key=lambda d: d[1])
        left = [d for d in docs if d[0] != 1]
        right = [d for d in docs if d[0] != 0]
        if not left or not right:
            continue
        flat = np.concatenate([d[4] for d in docs])
        vocabulary, column = np.unique(flat, return_inverse=True)
        at = np.repeat(np.arange(len(docs)), [len(d[4]) for d in docs])
        li, ri = [k for k, d in enumerate(docs) if d[0] != 1], [k for k, d in enumerate(docs) if d[0] != 0]
        overlap = np.zeros((len(li), len(ri)), np.float32)
        order = np.argsort(column, kind="stable")
        at, column = at[order], column[order]
        for start in range(0, len(vocabulary), SLICE):
            a, z = np.searchsorted(column, [start, start + SLICE])
            seen = np.zeros((len(docs), min(SLICE, len(vocabulary) - start)), np.float32)
            seen[at[a:z], column[a:z] - start] = 1
            overlap += seen[li] @ seen[ri].T
        nl, nr = np.array([d[2] for d in left]), np.array([d[2] for d in right])
        ll, lr = np.array([d[3] for d in left]), np.array([d[3] for d in right])
        hit = (7 * overlap >= 3 * (nl[:, None] + nr[None, :])) & (ll[:, None] != lr[None, :])
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for x, y in zip(*np.nonzero(hit), strict=True):
            p, q = find(int(ll[x])), find(int(lr[y]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((left[x][1], right[y][1]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _groups_of_buckets(mixed: DataFrame, n: int) -> DataFrame:
    """(group, row, n, label): the documents of large buckets ``mixed (token, size, h1, h2, row, n, label)``, each bucket whole in one group.

    Buckets with the same two smallest member hashes are one group if all of them together have at most twice the documents of the
    largest (so the passage's many n-grams are compared once, at no more than four times the cost of one); else each is a group of its own.
    """
    union = mixed.select("h1", "h2", "row").distinct().groupBy("h1", "h2").count()
    most = mixed.groupBy("h1", "h2").agg(F.max("size").alias("most"), F.count(F.lit(1)).alias("size"))
    alike = written(union.join(most, ["h1", "h2"]).select("h1", "h2", "size", (F.col("count") <= 2 * F.col("most")).alias("alike")), "near-alike")
    group = F.when(F.col("alike"), F.xxhash64("h1", "h2")).otherwise(F.xxhash64("token"))
    return _with_bucket(mixed.drop("size"), alike, n, "h1", "h2").select(group.alias("group"), "row", "n", "label").distinct()


def _in_blocks(mixed: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """Links between labels inside large buckets."""
    docs = written(_groups_of_buckets(mixed, n), "near-groups")
    sizes = docs.groupBy("group", "label").count()
    main = sizes.groupBy("group").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.max("count").alias("most"), F.sum("count").alias("all"))
    cut = docs.join(main, "group").withColumn("is_main", F.col("label") == F.col("main"))
    n_main, n_rest = F.ceil(F.col("most") / BLOCK), F.ceil((F.col("all") - F.col("most")) / BLOCK)
    h = F.xxhash64("row")
    # Blocks of the other labels come first; those of the main label are never compared with each other.
    block = F.when(F.col("is_main"), n_rest + F.pmod(h, n_main)).otherwise(F.pmod(h, F.greatest(n_rest, F.lit(1))))
    cut = cut.where("all > most").withColumn("block", block.cast("int")).withColumn("n_rest", n_rest.cast("int")).withColumn("n_all", (n_rest + n_main).cast("int"))
    others = F.when(F.col("is_main"), F.sequence(F.lit(0), F.col("n_rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("n_all") - 1))
    sent = cut.join(sets.select("row", "tokens"), "row").withColumn("other", F.explode(others)).select(
        "group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"), "row", "n", "label", "tokens",
    )
    return sent.repartition(n, "group", "i", "j").mapInArrow(_blocks, "a long, b long")


def _merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels (id, label)`` after further links: only labels are connected anew."""
    ends = more.select(F.col("a").alias("id")).union(more.select("b")).distinct()
    known = written(labels.join(ends, "id", "full").select("id", F.coalesce("label", "id").alias("label")), "near-known")
    one, two = (known.select(F.col("id").alias(x), F.col("label").alias(f"l{x}")) for x in ("a", "b"))
    joined = components(more.join(one, "a").join(two, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    to = joined.select(F.col("id").alias("label"), F.col("label").alias("lower"))
    return known.join(to, "label", "left").select("id", F.coalesce("lower", "label").alias("label"))


def link_classes(docs: DataFrame, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): rows (row, doc_id, rep, n) of the table, and the label of each representative that is linked with another.

    ``row``: a column of distinct longs that tells rows apart; without it they are numbered.
    """
    spark = docs.sparkSession
    n = partitions(spark, FINER * text_bytes(docs))
    fragments = 2 * n
    rows = docs.select((F.col(f"`{row}`") if row else F.monotonically_increasing_id()).alias("row"), F.col("doc_id"), F.col("text"))
    cut = rows.mapInArrow(_cut(fragments), _SENT)
    shared = written(cut.repartition(n, "fragment").mapInArrow(_share(n, fragments), _SHARED), "near-shared")
    table = shared.where("kind = 0").select("row", "doc_id", "rep", "n")
    packed = shared.where("kind = 1").select("bucket", "rows", "ns", "sizes", "tokens")
    sets = written(packed.repartition(n, "bucket").mapInArrow(_able, "row long, n int, tokens array<long>"), "near-sets")

    # n-grams by document frequency among those left; the rarest first, those of one document before all
    tokens = sets.select("row", "n", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = tokens.join(often, "token")
    per = known.groupBy("row", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("order")).withColumn("m", F.size("order"))
    prefix = per.withColumn("length", F.col("m") - F.ceil(F.col("n") * 0.75).cast("int") + 1).where("length > 0")
    postings = written(
        prefix.select("row", "n", "m", F.posexplode(F.slice("order", 1, F.col("length"))).alias("k", "o")).select("row", "n", F.col("o.token").alias("token"), (F.col("n") - F.col("m") + F.col("k") + 1).alias("place")),
        "near-postings",
    )

    hubs = written(postings.groupBy("token").agg(F.min(F.struct("row", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1"), "near-hubs")
    first = _with_bucket(postings, hubs, n, "token").where("row <> hub.row and " + _enough("n", "hub.n")).select(F.col("hub.row").alias("a"), F.col("row").alias("b")).distinct()
    links = written(_linked(first, sets, fragments), "near-links")
    labels = written(components(links), "near-labels")

    # buckets in which not all are connected yet
    marked = postings.join(labels.withColumnRenamed("id", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
    per_bucket = marked.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.xxhash64("row", F.lit(1))).alias("h1"), F.min(F.xxhash64("row", F.lit(2))).alias("h2"))
    buckets = written(per_bucket.where("low < high").drop("low", "high"), "near-buckets")
    mixed = written(_with_bucket(marked, buckets, n, "token"), "near-mixed")
    small = mixed.where(f"size <= {LARGE}")
    a, b = small.alias("a"), small.alias("b")
    fits = "1 + least(a.n - a.place, b.n - b.place) >= ceil(3 * (a.n + b.n) / 7)"
    pairs = a.join(b, F.expr(f"a.token = b.token and a.row < b.row and a.label <> b.label and {_enough('a.n', 'b.n')} and {fits}")).select(F.col("a.row").alias("a"), F.col("b.row").alias("b")).distinct()
    more = written(_linked(pairs, sets, fragments).union(_in_blocks(mixed.where(f"size > {LARGE}"), sets, n)), "near-links")
    if not more.isEmpty():
        labels = written(_merged(labels, more), "near-labels")
    return table, labels


def classes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach), ``row`` and ``label`` (the class, by one of its rows), one row for each row of ``docs``.

    Null and empty texts and texts of white space have no set and are linked with nothing. Rows with
    equal sets are linked. A null doc_id is never the smallest, unless there is no other. Classes can share a component_id,
    where ids are null or repeated, but not a label. An empty table gives an empty one. Other columns of ``docs`` don't matter.
    """
    table, labels = link_classes(docs, row)
    labels = labels.withColumnRenamed("id", "rep")
    # by representative first: of the rows of one, a batch has read all
    reps = table.groupBy("rep").agg(F.min("doc_id").alias("low")).join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    # a table of its own: Spark can then split the join where one label has most of the rows
    lowest = written(reps.groupBy("label").agg(F.min("low").alias("component_id")), "near-lowest")
    named = reps.join(lowest, "label").select("rep", "label", "component_id")
    return table.join(named, "rep").select("row", "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "label")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class of near duplicates, the one with the smallest doc_id (the first read of equal ids), with the columns of ``docs``.

    Rows without a set (null, empty and white texts) all stay. An empty table gives an empty one.
    """
    row = fresh(docs.columns, "_row")
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "near-input")
    found = classes(keyed, row)
    first = found.where("n_shingles > 0 and doc_id <=> component_id").groupBy("label").agg(F.min("row").alias(row)).select(row)
    empty = found.where("n_shingles = 0").select(F.col("row").alias(row))
    return keyed.join(first.union(empty), row, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).drop("row", "label")
