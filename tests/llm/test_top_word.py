"""The share of the most common word covers the whole text."""

from signalloom.llm import quality


def top_word(words):
    return quality.features(" ".join(words))[quality.FEATURES.index("top_word")]


def test_top_word_of_whole_text():
    clean = [f"w{k}" for k in range(200)]
    assert top_word(clean) == 1 / 200
    assert top_word(clean + ["buy"] * 800) == (1 + 4 * 200) / 1000
    assert top_word(clean[:50] + ["buy"] * 150) == 150 / 200
    assert abs(top_word(clean + ["end"]) - 2 / 201) < 1e-12
