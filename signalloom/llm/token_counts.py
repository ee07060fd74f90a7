"""Edit-aware token counts.

A document keeps a segment tree over its pre-tokens: leaves hold runs of (length, tokens),
inner nodes their sums. An edit changes pre-tokens only from shortly before it (the
pattern looks two characters ahead of a match) to the first border after it that the old and the new
text share; that region alone is encoded again, and the sums above it are updated.
A leaf that grows beyond twice ``LEAF`` becomes a balanced subtree; a tree that gets too deep is balanced anew.
All edits of a text are one pass from left to right over its final form, so n edits cost n regions and n paths.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._util import Step, append_columns, documents
from .bpe import Encoder, _once

#: Pre-tokens in a leaf; characters that a match depends on beyond its end.
LEAF, AHEAD = 64, 2


class _Node:
    """A leaf with its runs, or an inner node with two children."""

    __slots__ = ("chars", "left", "lengths", "right", "sums", "tokens")

    def __init__(self, lengths: list[int], tokens: list[int]):
        self.fill(lengths, tokens)

    def fill(self, lengths: list[int], tokens: list[int]) -> None:
        self.chars, self.sums = sum(lengths), sum(tokens)
        if len(lengths) <= LEAF:
            self.left = self.right = None
            self.lengths, self.tokens = lengths, tokens
        else:
            half = (len(lengths) + LEAF - 1) // LEAF // 2 * LEAF
            self.lengths = self.tokens = None
            self.left, self.right = _Node(lengths[:half], tokens[:half]), _Node(lengths[half:], tokens[half:])

    def add(self) -> None:
        self.chars, self.sums = self.left.chars + self.right.chars, self.left.sums + self.right.sums


class TokenTree:
    def __init__(self, text: str, encoder: Encoder):
        self.encoder, self.encoded = encoder, 0
        words = encoder.split(text)
        self._build(list(map(len, words)), encoder.counts(words).tolist() if words else [])

    def _build(self, lengths: list[int], tokens: list[int]) -> None:
        self.root, self.leaves = _Node(lengths, tokens), max(1, -(-len(lengths) // LEAF))
        self.height = (self.leaves - 1).bit_length()

    @property
    def total(self) -> int:
        return self.root.sums

    def _leaf(self, offset: int) -> tuple[list[_Node], int]:
        """The path to the leaf with the character at ``offset`` (the last leaf beyond the end), and where it begins."""
        node, before, path = self.root, 0, [self.root]
        while node.left is not None:
            if offset >= before + node.left.chars and node.right.chars:
                before += node.left.chars
                node = node.right
            else:
                node = node.left
            path.append(node)
        return path, before

    def _set(self, path: list[_Node], lengths: list[int], tokens: list[int]) -> None:
        leaf = path[-1]
        if len(lengths) <= 2 * LEAF:
            leaf.lengths, leaf.tokens, leaf.chars, leaf.sums = lengths, tokens, sum(lengths), sum(tokens)
        else:
            leaf.fill(lengths, tokens)
            more = -(-len(lengths) // LEAF) - 1
            self.leaves += more
            self.height = max(self.height, len(path) - 1 + more.bit_length())
        for node in path[-2::-1]:
            node.add()

    def runs(self) -> tuple[list[int], list[int]]:
        """Length and tokens of each pre-token."""
        lengths, tokens, stack = [], [], [self.root]
        while stack:
            node = stack.pop()
            if node.left is None:
                lengths += node.lengths
                tokens += node.tokens
            else:
                stack += (node.right, node.left)
        return lengths, tokens

    def edit_all(self, new: str, edits: list[tuple[int, int, int]]) -> None:
        """``new`` is the text after all ``edits`` (start, end in the old text, length put there), in order and apart."""
        match, moved, k = self.encoder.matcher(new), 0, 0
        while k < len(edits):
            # the text up to here is final; offsets of the rest are old ones, moved
            start, end, put = edits[k]
            k += 1
            start, old_end, shift = start + moved, end + moved, put - (end - start)
            path, at = self._leaf(max(0, start - AHEAD))
            first, lengths, i = path, path[-1].lengths, 0
            while i < len(lengths) and at + lengths[i] <= start - AHEAD:
                at += lengths[i]
                i += 1
            keep_l, keep_t = lengths[:i], path[-1].tokens[:i]
            # new pre-tokens from here on, until one ends where an old one ended, beyond the edit
            old, pos, emptied, put_words = at, at, [], []
            while True:
                while k < len(edits) and edits[k][0] + moved + shift - AHEAD < pos:  # the next edit is within reach
                    start, end, put = edits[k]
                    old_end, shift, k = end + moved, shift + put - (end - start), k + 1
                while old < pos - shift or old < old_end:
                    while i >= len(path[-1].lengths) and old < self.root.chars:
                        if path is not first:
                            emptied.append(path)
                        path, i = self._leaf(old)[0], 0
                    if i >= len(path[-1].lengths):
                        break
                    old += path[-1].lengths[i]
                    i += 1
                if pos - shift == old and old >= old_end:
                    break
                m = match(new, pos)
                if not m or m.end() == pos:
                    break
                put_words.append(m[0])
                pos = m.end()
            if put_words:
                self.encoded += len(put_words)
                keep_l += map(len, put_words)
                keep_t += self.encoder.counts(put_words).tolist()
            rest_l, rest_t = path[-1].lengths[i:], path[-1].tokens[i:]
            if path[-1] is not first[-1]:
                self._set(path, rest_l, rest_t)
                for p in emptied:
                    self._set(p, [], [])
                rest_l, rest_t = [], []
            self._set(first, keep_l + rest_l, keep_t + rest_t)
            moved += shift
            if self.height > 2 * self.leaves.bit_length() + 8:
                self._build(*self.runs())


_NUMBER = re.compile(r"[0-9]{5,}")


def scrub(text: str) -> list[tuple[int, int, str]]:
    """Edits of a cleaning pass, in order and apart: repeated lines go, numbers of five digits or more become one 0."""
    edits, seen, at = [], set(), 0
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip() and line in seen:
            edits.append((at, min(end + 1, len(text)), ""))
        else:
            seen.add(line)
            edits += [(at + m.start(), at + m.end(), "0") for m in _NUMBER.finditer(line)]
        at = end + 1
    return edits


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, put in edits:
        parts += (text[at:start], put)
        at = end
    return "".join(parts) + text[at:]


def recount(tree: TokenTree, text: str, edits: list[tuple[int, int, str]]) -> str:
    """Applies the edits to text and tree; returns the text."""
    new = apply_edits(text, edits)
    tree.edit_all(new, [(start, end, len(put)) for start, end, put in edits])
    return new


def count_edited(docs: DataFrame, ranks_path: str, pattern: str, edits=scrub) -> DataFrame:
    """``docs`` with n_tokens, n_pretokens, n_edits, n_tokens_edited, n_reencoded and tree_height.

    ``edits`` gives a text's edits as (start, end, replacement), in order and apart. Null text counts as empty:
    no tokens, no edits. Each row is counted alone, repeated or not; an empty table gives an empty one. Columns of ``docs`` with those names are replaced.
    """
    names = ("n_tokens", "n_pretokens", "n_edits", "n_tokens_edited", "n_reencoded", "tree_height")

    def start():
        encoder = _once("encoder", ranks_path, pattern)

        def step(texts):
            out: list[list[int]] = [[] for _ in names]
            for x in texts:
                text = x.as_py() or ""
                tree, todo = TokenTree(text, encoder), edits(text)
                before, n, height = tree.total, len(tree.runs()[0]), tree.height
                recount(tree, text, todo)
                for c, v in zip(out, (before, n, len(todo), tree.total, tree.encoded, height), strict=True):
                    c.append(v)
            return [pa.array(c, pa.int64()) for c in out]

        return step

    return append_columns(docs, Step(["text"], [T.StructField(n, T.LongType()) for n in names], start))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return count_edited(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")
