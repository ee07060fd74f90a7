"""Vector codes: product quantisation whose nearest entries are found with LAESA pivots.

Each vector is cut into parts, and each part is coded as the nearest entry of its codebook. The distances from a part to a few pivots, which
stay as they are, are computed once and stored beside it. A round needs only the distances from the pivots to the entries: by the triangle inequality
``|d(part, pivot) - d(entry, pivot)|`` is a lower bound of ``d(part, entry)``. Entries are visited by rising bound and evaluated in exact integers
until the bound is above the best distance found.

What a round takes from the table are sums and counts: at most ``parts * entries`` rows, whatever the number of vectors. Each task adds up its own before it
shuffles them, so a value that many rows hold costs nothing extra.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import numbered_columns, written

PARTS, ENTRIES, ROUNDS, SCALE, PIVOTS = 4, 256, 4, 1024, 8
#: Largest component after scaling: squared distances and their sums stay within 64 bits.
LARGEST = 1 << 26
#: Entries evaluated at a time, and rows handled at a time.
_STEP, _ROWS = 8, 2048


def choose_pivots(entries: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` of the entries, each with the greatest sum of distances to those before it; the first is the one farthest from the mean."""
    if not len(entries):
        return entries
    away = np.sqrt(((entries - entries.mean(axis=0)) ** 2).sum(axis=1))
    found = [int(away.argmax())]
    total = np.zeros(len(entries))
    while len(found) < min(n, len(entries)):
        total += np.sqrt(((entries - entries[found[-1]]) ** 2).sum(axis=1))
        total[found] = -1
        if total.max() <= 0:  # only copies of pivots are left
            break
        found.append(int(total.argmax()))
    return entries[found]


def distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances of whole-numbered rows, as doubles."""
    out = np.empty((len(x), len(to)))
    for k, t in enumerate(to):
        d = x - t
        out[:, k] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def nearest(x: np.ndarray, x_pivot: np.ndarray, entries: np.ndarray, entry_pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row the index of its nearest entry (of equal ones the lowest), the squared distance, and how many distances were evaluated.

    ``x_pivot`` and ``entry_pivot`` are distances to the same pivots. Bounds are lowered by more than their rounding error, so none cuts off an entry wrongly.
    """
    n, k = len(x), len(entries)
    bound = np.zeros((n, k))
    for p in range(x_pivot.shape[1]):
        np.maximum(bound, np.abs(x_pivot[:, p, None] - entry_pivot[None, :, p]), out=bound)
    slack = 1e-9 * (x_pivot.max(initial=0) + entry_pivot.max(initial=0))
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.maximum(np.take_along_axis(bound, order, axis=1) - slack, 0) ** 2
    best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    active, evaluated = np.arange(n), 0
    for at in range(0, k, _STEP):
        active = active[bound[active, at] <= best[active]]
        if not len(active):
            break
        tried = order[active, at : at + _STEP]
        d = x[active, None, :] - entries[tried]
        d = np.einsum("ijk,ijk->ij", d, d)
        evaluated += d.size
        low = d.min(axis=1)
        which = np.where(d == low[:, None], tried, k).min(axis=1)
        better = (low < best[active]) | ((low == best[active]) & (which < index[active]))
        moved = active[better]
        best[moved], index[moved] = low[better], which[better]
    return index, best, evaluated


def _integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * component) of a batch's vectors."""
    if pc.any(pc.not_equal(pc.list_value_length(column), width)).as_py():
        raise ValueError(f"vectors must all have {width} components")
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"components above {LARGEST // SCALE} don't fit the integer arithmetic")
    return x.astype(np.int64).reshape(len(column), width)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            yield b.slice(at, _ROWS)


def _matrix(column: pa.Array, *shape: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), *shape)


def _book_pivots(books: np.ndarray, pivots: list[np.ndarray]) -> list[np.ndarray]:
    return [distances(b, p) for b, p in zip(books, pivots, strict=True)]


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def _usable(vector: str) -> Column:
    """Neither null nor with a component that is null, NaN or infinite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def vector_codes(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """``df`` without ``embedding``, with code, error, label_error and codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are dropped. Components become ``floor(1024 * x)``; vectors are cut into ``parts`` equal
    parts, and must have equal lengths that ``parts`` divides (else an error), and no component above 65,536. A part's codebook starts as that part of the ``entries`` smallest vec_ids (nulls
    last, repeated ids by their vectors), or of all rows where there are fewer; then ``rounds`` times each entry becomes the floored mean of the parts nearest to it. An entry that no
    part is nearest to stays; of equal distances the lower index counts. label_error adds up the errors of equal labels (nulls are equal). Repeated rows count one by one. An empty table
    gives an empty one. Other columns are kept, those named like a result replaced.
    """
    spark = df.sparkSession
    new = ("code", "error", "label_error", "codebooks_sha256")
    work, names, now = numbered_columns(df, new)
    vec_id, label, vector = now["vec_id"], now["label"], now["embedding"]
    carried = [n for n in now.values() if n != vector]
    work = work.where(_usable(vector))
    first = [r[0] for r in work.orderBy(F.col(vec_id).asc_nulls_last(), F.col(vector)).limit(entries).select(vector).collect()]
    fields = [f for f in work.schema.fields if f.name != vector]
    named = [F.col(n).alias(c) for n, c in zip(now.values(), names, strict=True) if n != vector]
    if not first:
        empty = spark.createDataFrame([], T.StructType(fields))
        return empty.select(*named, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    size = len(first[0])
    if size % parts:
        raise ValueError(f"{parts} parts don't divide {size} components")
    width = size // parts
    books = _integers(pa.array(first, pa.list_(pa.float64())), size).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    fixed = [choose_pivots(b, pivots) for b in books]
    far = sum(len(p) for p in fixed)

    def split(d: np.ndarray) -> list[np.ndarray]:
        return np.split(d, np.cumsum([len(p) for p in fixed])[:-1], axis=1)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            x = _integers(b.column(vector), size)
            cut = x.reshape(-1, parts, width)
            near = np.concatenate([distances(cut[:, k], p) for k, p in enumerate(fixed)], axis=1)
            columns = [b.column(n) for n in carried] + [_lists(x.astype(np.int32), pa.int32()), _lists(near, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, "x", "near"])

    stored = T.StructType([*fields, T.StructField("x", T.ArrayType(T.IntegerType())), T.StructField("near", T.ArrayType(T.DoubleType()))])
    table = written(work.mapInArrow(prepare, stored), "vector-parts")

    def assign(b: pa.RecordBatch, books: np.ndarray, book_pivots: list[np.ndarray]):
        x = _matrix(b.column("x"), parts, width).astype(np.int64)
        return x, [nearest(x[:, k], d, books[k], book_pivots[k]) for k, d in enumerate(split(_matrix(b.column("near"), far)))]

    count = len(first)
    sums = [f"s{k}" for k in range(width)]
    for _ in range(rounds):

        def total(batches: Iterator[pa.RecordBatch], books=books, near=_book_pivots(books, fixed)) -> Iterator[pa.RecordBatch]:
            n, s = np.zeros((parts, count), np.int64), np.zeros((parts, count, width), np.int64)
            for b in _slices(batches):
                x, found = assign(b, books, near)
                for k, (index, _, _) in enumerate(found):
                    n[k] += np.bincount(index, minlength=count)
                    np.add.at(s[k], index, x[:, k])
            part, entry = np.nonzero(n)
            columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry])]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(s[part, entry, i]) for i in range(width)], names=["part", "entry", "n", *sums])

        partial = table.select("x", "near").mapInArrow(total, f"part int, entry int, n long{''.join(f', {c} long' for c in sums)}")
        books = books.copy()
        for r in partial.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *sums)]).collect():
            books[r["part"], r["entry"]] = [r[c] // r["n"] for c in sums]

    def code(batches: Iterator[pa.RecordBatch], books=books, near=_book_pivots(books, fixed)) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{k:02x}" for k in range(count)])
        for b in _slices(batches):
            _, found = assign(b, books, near)
            text = ["".join(row) for row in zip(*(digits[index] for index, _, _ in found), strict=True)]
            error = sum(d for _, d, _ in found)
            yield pa.RecordBatch.from_arrays([b.column(n) for n in carried] + [pa.array(text, pa.string()), pa.array(error, pa.int64())], names=[*carried, "code", "error"])

    coded = written(table.mapInArrow(code, T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])), "vector-codes")
    by_label = written(coded.groupBy(F.col(label).alias("of")).agg(F.sum("error").alias("label_error")), "vector-labels")
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(by_label, coded[label].eqNullSafe(by_label["of"])).select(*named, "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


def _oracle() -> str:
    """The same in SQL: plain comparisons with all entries."""
    width = "len(v) // 4"
    steps = [
        f"k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, part, v[part * ({width}) + 1 : (part + 1) * ({width})] AS x FROM k, range(4) r(part))",
        "b0 AS MATERIALIZED (SELECT part, entry, x AS e FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < 256) USING (vec_id))",
    ]
    square = "CAST(list_dot_product(CAST(x AS DOUBLE[]), CAST(x AS DOUBLE[])) + list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[])) - 2 * list_dot_product(CAST(x AS DOUBLE[]), CAST(e AS DOUBLE[])) AS BIGINT)"
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := {square}, entry := entry)) AS best, any_value(x) AS x FROM p JOIN b{r} USING (part) GROUP BY vec_id, part)")
        if r < ROUNDS:
            mean = "(s - ((s % n) + n) % n) // n"
            steps.append(f"m{r} AS (SELECT part, entry, list({mean} ORDER BY i) AS e FROM (SELECT part, best.entry AS entry, i, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, best, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY ALL) GROUP BY part, entry)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.e, b{r}.e) AS e FROM b{r} LEFT JOIN m{r} USING (part, entry))")
    last = f"SELECT vec_id, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id"
    sha = f"(SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, i)) FROM (SELECT part, entry, unnest(e) AS c, generate_subscripts(e, 1) AS i FROM b{ROUNDS}))"
    return f"WITH {', '.join(steps)}, f AS ({last}) SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {sha} AS codebooks_sha256 FROM f JOIN k USING (vec_id)"


ORACLE = _oracle()
