"""Hot groups, chained buckets and column names that clash, for the operators on copies and near copies."""

import random

from test_llm import brute_classes, sha

from signalloom.llm import msd_dedup, ngram_join


def test_chained_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LARGE", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    seen, real = [], ngram_join._blocks

    def counted(mixed, n):
        out = _groups(mixed, n)
        seen.append(out)
        return out

    _groups = ngram_join._groups_of_buckets
    monkeypatch.setattr(ngram_join, "_groups_of_buckets", counted)
    rng, rows = random.Random(3), []
    passage = [[f"p{k}x{j}" for j in range(14)] for k in range(31)]
    for k in range(30):  # a class shares a passage with the next one, but no class is near another
        own = [f"c{k}w{j}" for j in range(30)]
        for _ in range(6):
            words = passage[k] + own + passage[k + 1]
            words[14 + rng.randrange(30)] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute_classes(rows)
    largest = seen[0].groupBy("group").count().agg({"count": "max"}).first()[0] or 0
    assert largest <= 48 and real is ngram_join._blocks


def test_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SPREAD", 3)
    rng, base = random.Random(5), [f"w{k}" for k in range(50)]
    rows = [(i, " ".join(base[: 50 - i % 3] + [f"x{rng.randrange(9)}"])) for i in range(200)] + [(1000 + i, " ".join(f"y{i}{k}" for k in range(30))) for i in range(20)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute_classes(rows)


def test_many_fragments_keep_all_bits():
    import numpy as np
    import pyarrow as pa

    text = " ".join(f"w{k}" for k in range(400))
    batch = pa.RecordBatch.from_pydict({"row": pa.array([0, 1], pa.int64()), "doc_id": pa.array([0, 1], pa.int64()), "text": [text, text + " end"]})
    want = {h for h in ngram_join.shingles([text.encode()])[0].tolist()}
    for fragments, bits in ((100, 54), (1 << 16, 64)):
        sent = list(ngram_join._cut(fragments)(iter([batch])))
        shared = [b for b in ngram_join._share(1, fragments)(iter(sent)) if 1 in b.column("kind").to_pylist()]
        keys = [np.frombuffer(x, np.uint64) for b in shared for x in b.column("tokens").to_pylist() if x]
        got = set(np.concatenate(keys).tolist())
        assert len(got) == len(want)
        assert got == want if bits == 64 else {g & (1 << 48) - 1 for g in got} == {w & (1 << 48) - 1 for w in want}


def test_hot_texts_are_merged(spark, monkeypatch):
    monkeypatch.setattr(msd_dedup, "BATCH", 10)
    monkeypatch.setattr(msd_dedup, "SPREAD", 3)
    rng = random.Random(1)
    long = "an opening that all of them share " * 600
    texts = ["hot text  here", "hot texthere", long + "a", long + "b", long, "", None]
    rows = [(i, texts[min(rng.randrange(12), 6)] if rng.random() < 0.8 else f"lone {i}") for i in range(700)]
    got = msd_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    groups: dict = {}
    for i, t in rows:
        groups.setdefault((t or "").encode().translate(None, msd_dedup.WHITE), []).append((i, t or ""))
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    for r in got:
        norm = (r.text or "").encode().translate(None, msd_dedup.WHITE)
        assert (r.group_size, r.keep_id, r.text_sha256) == (len(groups[norm]), min(groups[norm], key=lambda x: (-len(x[1]), x[0]))[0], sha(norm))


def test_clashing_columns_keep_their_values(spark):
    names = ["__row", "row", "rep", "head", "count", "chars", "best", "bin", "hot", "of", "keep_row", "label", "n", "_row", "c0", "c1", "kept", "component_id", "token", "size"]
    texts = ["one two three four five six", "one two three four five six", "another text of quite other words", None, "", "x"]
    rows = [(k, t, *[f"{c}{k}" for c in names]) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"`{c}` string" for c in names]]))
    want = dict(zip(range(len(rows)), rows, strict=True))
    for kept, ids in ((msd_dedup.drop_copies(docs), {0, 2, 3, 5}), (ngram_join.one_of_each(docs), {0, 2, 3, 4, 5})):
        assert kept.columns == docs.columns
        got = {r.doc_id: tuple(r) for r in kept.collect()}
        assert got == {k: want[k] for k in ids}
    marked = msd_dedup.exact_groups(docs)
    assert marked.columns == [c for c in docs.columns if c != "kept"] + ["keep_id", "group_size", "kept", "text_sha256"]
    assert {r.doc_id: (r["row"], r["rep"], r["bin"], r["__row"]) for r in marked.collect()} == {k: (f"row{k}", f"rep{k}", f"bin{k}", f"__row{k}") for k in want}
