"""The mix keeps the user's columns, whatever they are called, and values on odd rows."""

from signalloom.llm import mixing

NAMES = ["lam", "shift", "full", "mean_size", "_key", "key", "_u", "u", "src", "rate", "low", "high", "miss", "c0", "copy", "target"]


def frame(spark):
    texts = ["one two three", "one two three four", "five six", None, "", "one two three", "a b c d e f g h", "lone"]
    rows = [(k % 7, t, None if k == 7 else "st"[k % 2], *[f"{n}{k}" for n in NAMES]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"`{n}` string" for n in NAMES]])), rows


def test_columns_keep_their_values(spark):
    docs, rows = frame(spark)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    kept = [n for n in NAMES if n not in mixing.NEW]
    want = {(r[3], *[r[3 + NAMES.index(n)] for n in kept]) for r in rows}
    assert {(r["lam"], *[r[n] for n in kept]) for r in out} == want
    by_row = {r["lam"]: r for r in out}
    for k, r in enumerate(rows):
        got = by_row[f"lam{k}"]
        assert got["size"] == len((r[1] or "").split()) and got["taken"] == got["size"] * got["copies"]
        assert got["copies"] == 1 if got["size"] == 0 else got["copies"] in (0, 1, 2)
    often = mixing.mixed(docs)
    assert often.columns == docs.columns
    count: dict = {}
    for r in often.collect():
        assert tuple(r) in set(rows)
        count[r["lam"]] = count.get(r["lam"], 0) + 1
    assert all(count.get(k, 0) == r["copies"] for k, r in by_row.items())


def test_tables_without_words(spark):
    docs, rows = frame(spark)
    for part in (docs.where("coalesce(text, '') = ''"), docs.limit(0)):
        assert mixing.mix(part).where("copies <> 1 or taken <> 0 or target <> 0").count() == 0
        assert mixing.mixed(part).count() == part.count()
