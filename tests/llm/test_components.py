"""Components of long chains, whose labels travel far."""

import random

from signalloom.llm.components import components


def test_long_chains(spark):
    n, rng = 200, random.Random(11)
    shuffled = list(range(1001, 1001 + n))
    rng.shuffle(shuffled)
    chains = [[1, *range(n, 1, -1)], shuffled, [5000 + (k // 2 if k % 2 else n - k // 2) for k in range(n)]]
    edges = [e for chain in chains for e in zip(chain, chain[1:], strict=False)]
    want = {i: min(chain) for chain in chains for i in chain}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.label for r in got} == want and len(got) == len(want)
