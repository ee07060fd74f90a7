"""Language ID with interpolated Kneser-Ney character language models.

Each language has a character model of order ``ORDER`` over words with borders. N-grams
lie in sorted arrays of 64-bit hashes, one for each order, with a column for each
language. A text belongs to the language of the lowest cross-entropy per
character. Whether an answer is to be trusted is calibrated on rows that the models
haven't seen: a text is ``rejected`` if it costs more than halfway from what nearly all of its language's own texts cost
to what texts of other languages usually do (a text with passages in two languages lies below). Languages with few such rows take the pooled distance.

The classifier is fitted on a bounded sample: at most ``TRAIN_DOCS`` and ``CALIBRATION_DOCS`` labelled rows of each language, of at most ``SAMPLE_BYTES``. Each
row is dealt once, so the calibration sees no text that the models were fitted on, in small languages either. Word counts (words of any length) are
summed by Spark; what reaches the driver is bounded by the sample and the number of languages, not the table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import Step, append_columns, documents, numbered_columns, written

ORDER, TRAIN_DOCS, CALIBRATION_DOCS, SAMPLE_BYTES = 5, 500, 200, 16 << 20
#: Share of a language's own texts that the calibration takes for outliers; rows it needs; robust deviations where no other language tells how far is far.
OUTLIERS, ENOUGH, FAR = 0.005, 20, 12.0
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_START, _END = 2, 3
_CACHE, _CHUNK = 80_000, 200_000


def words_of(text: str) -> list[str]:
    """Lower-case words of a text; none if it has no letter."""
    words = _WORD.findall(text.lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# --- models ---------------------------------------------------------------------------------------------------------


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Positions that are predicted (characters and the end of each word): the word of each, and by order the hash of the n-gram that ends there (0 where the word is too short)."""
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes = []
    h = np.zeros(len(flat), np.uint64)
    power, base = 1, 0x9E3779B97F4A7C15
    for n in range(1, ORDER + 1):  # hash of the n characters that end here
        shifted = np.concatenate([np.zeros(min(n - 1, len(flat)), np.uint64), flat[: max(0, len(flat) - n + 1)]])
        h = h + (shifted + np.uint64(1)) * np.uint64(power)
        power = power * base % (1 << 64)
        mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
        hashes.append(np.where(place >= n - 1, mixed | np.uint64(1), np.uint64(0)))
    seen = place > 0
    context = [np.concatenate([np.zeros(1, np.uint64), x[:-1]])[seen] for x in hashes]  # of the n characters before
    return word[seen], flat[seen], [x[seen] for x in hashes], context


class Models:
    """Kneser-Ney models of all languages over shared sorted hash arrays."""

    def __init__(self, counts: dict[str, Counter]):
        self.langs = sorted(counts)
        n_langs = len(self.langs)
        per: list[list] = [[] for _ in range(ORDER)]
        contexts: list[list] = [[] for _ in range(ORDER)]
        alphabet: set[int] = set()
        for k, lang in enumerate(self.langs):
            words = list(counts[lang])
            weight = np.fromiter(counts[lang].values(), np.float64, len(words))
            word, char, grams, before = _grams(words)
            alphabet |= set(np.unique(char).tolist())
            kept = None
            for n in range(ORDER, 0, -1):
                ok = grams[n - 1] != 0
                g, first, inverse = np.unique(grams[n - 1][ok], return_index=True, return_inverse=True)
                h = before[n - 2][ok][first] if n > 1 else np.zeros(len(g), np.uint64)
                if n == ORDER:
                    c = np.bincount(inverse, weight[word[ok]], len(g))
                else:  # how many characters stand before it; at a word's start nothing can, and its occurrences count
                    longer, at = kept
                    c = np.bincount(np.searchsorted(g, at), minlength=len(g)).astype(np.float64)
                    plain = np.bincount(inverse, weight[word[ok]], len(g))
                    c = np.where(c > 0, c, plain)
                n1, n2 = (c == 1).sum(), (c == 2).sum()
                d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                hs, hi = np.unique(h, return_inverse=True)
                total, kinds = np.bincount(hi, c), np.bincount(hi)
                per[n - 1].append((g, np.maximum(c - d, 0) / total[hi]))
                contexts[n - 1].append((hs, d * kinds / total))
                if n > 1:
                    # the shorter n-gram that each distinct n-gram ends with
                    kept = (g, grams[n - 2][ok][first])
        self.uniform = 1.0 / (len(alphabet) + 1)
        self.keys, self.alpha, self.ctx, self.gamma = [], [], [], []
        for n in range(ORDER):
            for out_keys, out_values, parts, missing in ((self.keys, self.alpha, per[n], 0.0), (self.ctx, self.gamma, contexts[n], 1.0)):
                keys = np.unique(np.concatenate([p[0] for p in parts])) if parts else np.zeros(0, np.uint64)
                table = np.full((len(keys) + 1, n_langs), missing, np.float32)  # the last row: not found
                for k, (g, v) in enumerate(parts):
                    table[np.searchsorted(keys, g), k] = v
                out_keys.append(keys)
                out_values.append(table)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return np.where(keys[at] == wanted, at, len(keys)) if len(keys) else np.zeros(len(wanted), np.int64)

    def costs(self, words: list[str]) -> np.ndarray:
        """For each word: nats by language, and last the number of characters predicted."""
        word, _, grams, before = _grams(words)
        p = np.full((len(word), len(self.langs)), self.uniform, np.float64)
        for n in range(1, ORDER + 1):
            h = before[n - 2] if n > 1 else np.zeros(len(word), np.uint64)
            p = self.alpha[n - 1][self._find(self.keys[n - 1], grams[n - 1])] + self.gamma[n - 1][self._find(self.ctx[n - 1], h)] * p
        out = np.empty((len(words), len(self.langs) + 1))
        nats = -np.log(p)
        ends = np.flatnonzero(np.diff(word, append=-1)) + 1
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        out[:, :-1] = np.add.reduceat(nats, starts, axis=0)
        out[:, -1] = ends - starts
        return out


class Scorer:
    """Cross-entropy of texts by language; costs of words are kept in a bounded cache."""

    def __init__(self, models: Models):
        self.models, self.place = models, {}
        self.table = np.zeros((0, len(models.langs) + 1))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(entropy per character by language, characters), a row for each text."""
        out = np.zeros((len(texts), len(self.models.langs) + 1))
        rows: list[int] = []
        flat: list[str] = []
        ends: list[int] = []
        for k, t in enumerate(texts):
            if words := words_of(t or ""):
                rows.append(k)
                flat += words
                ends.append(len(flat))
            if flat and (len(flat) >= _CHUNK or k == len(texts) - 1):
                self._sum(rows, flat, ends, out)
                rows, flat, ends = [], [], []
        if flat:
            self._sum(rows, flat, ends, out)
        return out[:, :-1] / np.maximum(out[:, -1:], 1), out[:, -1]

    def _sum(self, rows, flat, ends, out) -> None:
        if len(self.place) > _CACHE:
            self.place, self.table = {}, self.table[:0]
        new = list(set(flat).difference(self.place))
        if new:
            self.place.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.models.costs(new)])
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        out[rows] = np.add.reduceat(self.table[at], starts, axis=0)


# --- fitting --------------------------------------------------------------------------------------------------------


def dealt(labelled: DataFrame, docs_each: int = TRAIN_DOCS + CALIBRATION_DOCS, bytes_each: int = SAMPLE_BYTES) -> DataFrame:
    """lang, text and ``unseen`` of a sample: of each language the ``docs_each`` rows with the smallest hashes (fewer where rows are repeated), while their texts have at most ``bytes_each`` bytes (the first one always).

    Each row is dealt once, equal texts alike: to the models, or ``unseen`` to the calibration (two of seven texts, from the fourth on). Repeated ids or rows don't make the sample larger.
    """
    spark = labelled.sparkSession
    hashed = labelled.withColumn("h", F.xxhash64("doc_id", "text"))
    by_hash = Window.partitionBy("lang").orderBy("h", "doc_id")
    # hashes are spread evenly, so a language's count tells up to which one there are enough, and more than its smallest at least
    limits = {}
    for r in hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).collect():
        share = min(1.0, (1.3 * docs_each + 50) / r["n"])
        limits[r["lang"]] = max(r["least"], min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64))))
    if not limits:
        return spark.createDataFrame([], "lang string, text string, unseen boolean")
    most = F.create_map(*[F.lit(x) for item in limits.items() for x in item])
    ranked = hashed.where(F.col("h") <= most[F.col("lang")]).withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= docs_each)
    held = F.sum(F.octet_length("text")).over(by_hash.rowsBetween(Window.unboundedPreceding, 0))
    small = ranked.withColumn("held", held).where((F.col("n") == 1) | (F.col("held") <= bytes_each))
    place = F.dense_rank().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    return written(small.select("lang", "text", (place % 7).isin(4, 0).alias("unseen")), "language-sample")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: Counter = Counter()
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            counts.update((lang, w) for w in words_of(text or ""))
        yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())}, schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))


def limits_of(cost: np.ndarray, chars: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """For each language: the usual cost of its texts, how far above it a text is rejected, and the usual number of characters.

    ``cost``: entropy of unseen texts by language; ``truth``: their languages.
    """
    n = cost.shape[1]
    own = cost[np.arange(len(truth)), truth]
    usual, reach = np.full(n, np.nan), np.full(n, np.nan)
    for k in range(n):
        mine = own[truth == k]
        if len(mine):
            usual[k] = np.median(mine)
        if len(mine) >= ENOUGH:
            high, others = np.quantile(mine, 1 - OUTLIERS), cost[truth != k, k]
            far = high + FAR * 1.4826 * np.median(np.abs(mine - usual[k]))
            low = np.median(others) if len(others) else -np.inf
            reach[k] = ((high + low) / 2 if low > high else far) - usual[k]
    pooled = np.nanmedian(reach) if np.isfinite(reach).any() else np.inf
    usual = np.where(np.isnan(usual), np.nanmedian(usual) if np.isfinite(usual).any() else 0.0, usual)
    return np.column_stack([usual, np.where(np.isnan(reach), pooled, reach), np.full(n, np.median(chars) if len(chars) else 1.0)])


class Classifier:
    def __init__(self, models: Models, limits: np.ndarray, slope: float):
        self.models, self.limits, self.slope = models, limits, slope


def fit(docs: DataFrame) -> Classifier | None:
    """The classifier from text and non-null lang of the rows that aren't held out; None if there are none."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts: dict[str, Counter] = {}
    sample = dealt(labelled)
    pairs = sample.where("not unseen").select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long")
    for lang, word, n in pairs.groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").collect():
        counts.setdefault(lang, Counter())[word] = n
    if not counts:
        return None
    models = Models(counts)
    scorer = Scorer(models)
    unseen = sample.where("unseen").select("lang", "text").orderBy("lang", "text").collect()
    rows = [r for r in unseen if words_of(r["text"] or "") and r["lang"] in counts]
    n, slope = len(models.langs), 1.0
    limits = limits_of(np.zeros((0, n)), np.zeros(0), np.zeros(0, int))
    if rows:
        cost, chars = scorer([r["text"] for r in rows])
        truth = np.array([models.langs.index(r["lang"]) for r in rows])
        limits = limits_of(cost, chars, truth)
        # confidence: softmax of -slope * cost, the slope by maximum likelihood
        grid = np.geomspace(1, 200, 60)
        shifted = cost - cost.min(axis=1, keepdims=True)
        nll = [(s * shifted[np.arange(len(rows)), truth] + np.log(np.exp(-s * shifted).sum(axis=1))).mean() for s in grid]
        slope = float(grid[int(np.argmin(nll))])
    return Classifier(models, limits, slope)


def identify(docs: DataFrame, classifier: Classifier | None) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), entropy (nats per character) and rejected.

    A null text, one without letters, or a table without labelled rows gives ``und``, score 0, rejected. Without a language with
    ENOUGH unseen rows nothing else is rejected. Each row is judged alone, repeated or not; an empty table gives an empty one. Ties go to the first language in order. Columns of ``docs`` with those names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def start():
        fitted = shared.value
        scorer = Scorer(fitted.models) if fitted else None

        def step(texts):
            texts = texts.to_pylist()
            if not fitted:
                n = len(texts)
                return [pa.array([UNKNOWN] * n), pa.array([0.0] * n), pa.array([None] * n, pa.float64()), pa.array([True] * n)]
            cost, chars = scorer(texts)
            best = cost.argmin(axis=1)
            low = cost.min(axis=1)
            score = 1 / np.exp(-fitted.slope * (cost - low[:, None])).sum(axis=1)
            none = chars == 0
            usual, reach, length = fitted.limits[best].T
            beyond = low > usual + reach * np.maximum(1, np.sqrt(length / np.maximum(chars, 1)))  # short texts vary more
            names = [UNKNOWN if x else fitted.models.langs[k] for k, x in zip(best, none, strict=True)]
            return [pa.array(names), pa.array(np.where(none, 0.0, np.clip(score, 0, 1))), pa.array(low, mask=none), pa.array(none | beyond)]

        return step

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return append_columns(docs, Step(["text"], fields, start))


def trusted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``identify`` doesn't reject, with the columns of ``docs``, whatever these are called.

    Null and empty texts and those without letters go; without labelled rows, all go. Rows that are repeated all stay or all go.
    """
    work, names, now = numbered_columns(docs)
    marked = identify(work.withColumnRenamed(now["text"], "text"), fit(docs)).where("not rejected")
    return marked.select(*[F.col("text" if n == now["text"] else n).alias(c) for n, c in zip(now.values(), names, strict=True)])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), fit(docs)).drop("text")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
