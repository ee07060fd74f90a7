"""Kneser-Ney models against a plain version; what the calibration rejects."""

import random
from collections import Counter, defaultdict

import numpy as np

from signalloom.llm import language_id

ORDER = language_id.ORDER


def plain(counts: Counter, alphabet: int):
    """p(context, char) of an interpolated Kneser-Ney model, with dictionaries."""
    grams: list[Counter] = [Counter() for _ in range(ORDER + 1)]
    before: list[dict] = [defaultdict(set) for _ in range(ORDER + 1)]
    for word, times in counts.items():
        t = f"\x02{word}\x03"
        for end in range(1, len(t)):
            for n in range(1, min(ORDER, end + 1) + 1):
                g = t[end - n + 1 : end + 1]
                grams[n][g] += times
                if end - n >= 0:
                    before[n][g].add(t[end - n : end + 1])
    tables = []
    for n in range(1, ORDER + 1):
        c = {g: v if n == ORDER else len(before[n][g]) or v for g, v in grams[n].items()}
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total, kinds = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        tables.append((c, d, total, kinds))

    def p(context: str, char: str) -> float:
        out = 1 / (alphabet + 1)
        for n in range(1, min(ORDER, len(context) + 1) + 1):
            c, d, total, kinds = tables[n - 1]
            h = context[len(context) - n + 1 :]
            if total[h]:
                out = max(c.get(h + char, 0) - d, 0) / total[h] + d * kinds[h] / total[h] * out
        return out

    return p


def test_costs_equal_a_plain_model_that_sums_to_one():
    rng = random.Random(2)
    langs = {k: Counter("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(150)) for k, letters in (("x", "abcde"), ("y", "cdefg"))}
    models = language_id.Models(langs)
    alphabet = "abcdefg\x03"
    for at, lang in enumerate(models.langs):
        p = plain(langs[lang], len(alphabet))
        for context in ("\x02", "\x02a", "\x02abc", "\x02abcde", "\x02zz"):
            assert abs(sum(p(context, c) for c in alphabet + "?") - 1) < 1e-12
        words = [*list(langs[lang])[:20], "zz", "a", "abcdeabcde"]
        want = [-sum(np.log(p(f"\x02{w}\x03"[max(0, k - 4) : k] if k >= 4 else f"\x02{w}\x03"[:k], f"\x02{w}\x03"[k])) for k in range(1, len(w) + 2)) for w in words]
        assert np.allclose(models.costs(words)[:, at], want, rtol=1e-5)


def test_long_words_count():
    got = list(language_id._word_counts(iter([__import__("pyarrow").RecordBatch.from_pydict({"lang": ["a"], "text": ["x" * 500 + " y"]})])))
    assert sorted(len(w) for w in got[0].column("word").to_pylist()) == [1, 500]


def test_foreign_and_random_texts_are_rejected(spark):
    rng = random.Random(8)

    def text(parts, n=60):
        return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))

    a, b, c = ["ta", "re", "mo", "lin"], ["sch", "eng", "ur", "of"], ["zqx", "wyk", "jvv", "hgb"]
    rows = [(i, text(a if i % 2 else b, rng.randint(20, 90)), "a" if i % 2 else "b") for i in range(600)]
    strange = [(1000 + i, text(c), None) for i in range(20)] + [(2000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)), None) for i in range(20)]
    few = [(3000 + i, text(["pol", "ska", "czy"]), "few") for i in range(8)]
    docs = spark.createDataFrame(rows + strange + few, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert sum(got[i].rejected for i, *_ in rows) <= 3
    assert all(got[i].rejected for i, *_ in strange)
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert sum(got[i].rejected for i, *_ in few) == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = language_id.trusted(docs)
    assert kept.columns == docs.columns
    with_letters = docs.where(r"text rlike '\\p{L}'").count()
    assert kept.count() >= 0.99 * with_letters
