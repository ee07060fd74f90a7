"""The non-negative risk against a plain computation, and features of whole texts."""

import math

import numpy as np

from signalloom.llm import quality


def plain_risk(p, u, prior):
    loss = lambda m, y: math.log1p(math.exp(-y * m))
    plus = prior * sum(loss(m, 1) for m in p) / len(p)
    minus = sum(loss(m, -1) for m in u) / len(u) - prior * sum(loss(m, -1) for m in p) / len(p)
    return plus, minus


def test_risk_and_its_gradient():
    rng = np.random.default_rng(3)
    for shift, prior in ((0.0, 0.4), (4.0, 0.9)):  # the second: the risk of negatives is below zero
        p, u = rng.normal(shift, 1, 7), rng.normal(-shift / 8, 1, 11)
        assert np.allclose(quality.risks(p, u, prior), plain_risk(p, u, prior))
        assert (plain_risk(p, u, prior)[1] < 0) == (shift > 0)
        got, both = quality.risk_gradient(p, u, prior), np.concatenate([p, u])
        for k in range(len(both)):
            sides = []
            for e in (1e-5, -1e-5):
                moved = both.copy()
                moved[k] += e
                plus, minus = plain_risk(moved[:7], moved[7:], prior)
                sides.append(plus + minus if shift == 0 else -minus)
            assert abs((sides[0] - sides[1]) / 2e-5 - got[k]) < 1e-6


def test_trigrams_are_of_the_whole_text(monkeypatch):
    text = "a clean beginning. " * 50
    shares = quality.trigrams(text) ** 2
    assert abs(shares.sum() - 1) < 1e-9 and (quality.trigrams("") == 0).all() and (quality.trigrams("ab") == 0).all()
    assert np.abs(quality.trigrams(text + "$$%% " * 2000) - quality.trigrams(text)).max() > 0.3
    monkeypatch.setattr(quality, "_PIECE", 10)
    assert np.allclose(quality.trigrams(text) ** 2, shares)
