"""Trees of pre-tokens under many edits, and pieces longer than the transducer holds back."""

import random
import time

import public_tokenizers
import tiktoken

from signalloom.llm import bpe, token_counts

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = ["  ", " ", "\n", "'s", "'ll", "the", "a", "É", "12345", "!!", "漢", "'", "   "]


def test_dense_edits(monkeypatch):
    own, rng = bpe.Encoder(RANKS, public_tokenizers.PATTERN), random.Random(4)
    for leaf in (2, 64):
        monkeypatch.setattr(token_counts, "LEAF", leaf)
        for _ in range(300):
            text, edits, at, gap = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 300))), [], 0, rng.choice([0, 3, 40])
            while (s := at + rng.randint(0, gap)) + 12 < len(text):
                at = s + rng.randint(0, 12)
                edits.append((s, at, "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 2, 3, 3, 3, 90])))))
            tree = token_counts.TokenTree(text, own)
            for todo in (edits, None):  # and a second round on the same tree
                todo = [(k, k + 1, "x y") for k in range(0, len(text), 7)] if todo is None else todo
                want = token_counts.apply_edits(text, todo)
                text = token_counts.recount(tree, text, todo)
                assert text == want and tree.total == len(TIKTOKEN.encode_ordinary(text)) and tree.runs()[0] == list(map(len, own.split(text)))


def test_cost_of_edits_is_linear():
    own, took = bpe.Encoder(RANKS, public_tokenizers.PATTERN), []
    for n in (4000, 8000):
        text = " ".join(f"word{k % 97}" for k in range(5 * n))
        edits, best = [(k * len(text) // n, k * len(text) // n + 2, "zz q") for k in range(n)], 1e9
        for _ in range(3):
            tree, began = token_counts.TokenTree(text, own), time.process_time()
            token_counts.recount(tree, text, edits)
            best = min(best, time.process_time() - began)
        took.append(best)
        assert tree.encoded < 6 * n
    assert took[1] < 3 * took[0]


def test_a_long_insertion_splits_its_leaf():
    tree = token_counts.TokenTree("a b", bpe.Encoder(RANKS, public_tokenizers.PATTERN))
    text = token_counts.recount(tree, "a b", [(1, 2, " x" * 100_003)])
    assert tree.leaves > 1000 and tree.height <= 12 and tree.total == len(TIKTOKEN.encode_ordinary(text))


def test_long_pieces_are_settled_as_they_come(monkeypatch):
    monkeypatch.setattr(bpe, "_HELD", 20)
    fst, rng = bpe.Transducer(RANKS), random.Random(9)
    for n in (1, 40, 400, 4000):
        for piece in ("".join(rng.choice("abcdeeeinorst") for _ in range(n)).encode(), b"a" * n + b"b"):
            assert fst.encode(piece) == TIKTOKEN._encode_single_piece(piece)
