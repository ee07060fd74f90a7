"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The merges of a rank file define which token may follow which: a sequence of
tokens is the encoding of its bytes exactly if each adjacent pair is the encoding
of the pair's bytes. That makes encoding a nondeterministic finite-state
transducer over bytes: a hypothesis is a place in the vocabulary's trie plus the
token before it. ``Transducer`` determinises it on demand. The live places are the suffixes of
the longest one that lead on in the trie, so a state is that place with the token before each suffix.
A transition emits the one token that ends there in a valid encoding. Going back
from the live places, their paths meet after a bounded lookahead (about the longest token): what
lies before is settled. States and transitions are kept in a bounded cache.
"""

from __future__ import annotations

import base64
import bisect
import gc
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._util import Step, append_columns, documents

#: White_Space of Unicode; spelt out, as regex engines differ on U+001C..U+001F.
_WS = r"\t-\r \x85\xa0  -     　"


def load_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: merge the leftmost pair of lowest rank until none is left. Quadratic; for tests and short pieces."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        at = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
        if parts[at] + parts[at + 1] not in ranks:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = 60_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.bits = max(ranks.values()).bit_length()
        self.length = [0] * (max(ranks.values()) + 1)
        self.children: dict[int, int] = {}
        self.token_at, self.inner, self.depth = [-1], [False], [0]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                self.inner[node] = True
                key = node << 8 | b
                nxt = self.children.get(key)
                if nxt is None:
                    nxt = self.children[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token_at[node] = rank
            self.length[rank] = len(token)
        self.fits: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.edges: dict[tuple[int, int], tuple[int, ...]] = {}
        #: longest live place -> all live places, longest first; the root last
        self.chains: dict[int, tuple[int, ...]] = {0: (0,)}
        self.steps: dict[int, tuple[int, tuple[int, ...], tuple[tuple[int, int], ...]]] = {}
        self._reset()

    def _reset(self) -> None:
        self.number = {(0, (-1,)): 0}
        self.states = [(0, (-1,))]
        self.moves: dict[int, int] = {}  # state, byte -> next state, token

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; itself twice for a byte, None if merging its bytes doesn't make it."""
        if token not in self.halves:
            piece = self.bytes_of[token]
            lower = {k: v for i in range(len(piece)) for j in range(i + 1, len(piece) + 1) if (v := self.ranks.get(k := piece[i:j], token)) < token}
            parts = merge(piece, lower) if len(piece) > 1 else [token, token]
            ok = len(parts) == 2 and (len(piece) == 1 or merge(piece, self.ranks) == [token])
            self.halves[token] = (parts[0], parts[1]) if ok else None
        return self.halves[token]

    def _edge(self, token: int, side: int) -> tuple[int, ...]:
        """The tokens that stand at the right (1) or left (0) end of ``token`` while it is being merged, first to last."""
        key = (token, side)
        if key not in self.edges:
            halves = self._split(token)
            part = halves[side] if halves else token
            self.edges[key] = (token,) if part == token else (*self._edge(part, side), token)
        return self.edges[key]

    def _fits(self, before: int, token: int) -> bool:
        """Whether the bytes of the two tokens encode to these two: no merge across the border comes before those that build them."""
        key = (before + 1) << self.bits | token
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 250_000:
                self.fits.clear()
            found = self._split(token) is not None
            if found and before >= 0:
                xs, ys, i, j, never = self._edge(before, 1), self._edge(token, 0), 0, 0, 1 << 60
                while True:
                    x_ends = xs[i + 1] if i + 1 < len(xs) else never
                    y_ends = ys[j + 1] if j + 1 < len(ys) else never
                    across = self.ranks.get(self.bytes_of[xs[i]] + self.bytes_of[ys[j]], never)
                    if across < x_ends and across <= y_ends:  # of equal ranks the leftmost merges first
                        found = False
                        break
                    if x_ends == y_ends == never:
                        break
                    if x_ends <= y_ends:
                        i += 1
                    else:
                        j += 1
            self.fits[key] = found
        return found

    def _number(self, state: tuple) -> int:
        found = self.number.get(state)
        if found is None:
            found = self.number[state] = len(self.states)
            self.states.append(state)
        return found

    def _step(self, top: int, b: int) -> tuple[int, tuple[int, ...], tuple[tuple[int, int], ...]]:
        """From the longest live place by a byte: the new longest one, which of the old places live on, and (old place, token) where a token ends."""
        key = top << 8 | b
        found = self.steps.get(key)
        if found is None:
            if len(self.steps) > 4 * self.max_states:
                self.steps.clear()
            chain, keep, ends = [], [], []
            for k, node in enumerate(self.chains[top]):
                child = self.children.get(node << 8 | b)
                if child is not None:
                    if self.token_at[child] >= 0:
                        ends.append((k, self.token_at[child]))
                    if self.inner[child]:
                        chain.append(child)
                        keep.append(k)
            chain.append(0)
            self.chains.setdefault(chain[0], tuple(chain))
            found = self.steps[key] = chain[0], tuple(keep), tuple(ends)
        return found

    def _move(self, state: int, b: int) -> int:
        """Builds one transition: the next state and the token that ends there."""
        top, before = self.states[state]
        to, keep, ends = self._step(top, b)
        fits, bits = self.fits, self.bits
        for k, token in ends:  # a prefix has one encoding: one of them fits
            ok = fits.get((before[k] + 1) << bits | token)
            if self._fits(before[k], token) if ok is None else ok:
                break
        else:
            raise ValueError(f"no token for byte {b}")
        out = self.moves[state << 8 | b] = self._number((to, (*[before[k] for k in keep], token))) << bits | token
        return out

    def _settled(self, state: int, ends: list[int]) -> int:
        """How many bytes are settled: where the paths back from all live places meet."""
        live = sorted({len(ends) - self.depth[node] for node in self.chains[self.states[state][0]]})
        while len(live) > 1:
            at = live.pop()
            at -= self.length[ends[at - 1]]
            if at not in live:
                bisect.insort(live, at)
        return live[0]

    def _back(self, ends: list[int], at: int) -> list[int]:
        """The tokens of the first ``at`` bytes."""
        out, length = [], self.length
        while at:
            token = ends[at - 1]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > self.max_states:
            self._reset()
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out, ends, moves, bits, mask = 0, [], [], self.moves, self.bits, (1 << self.bits) - 1
        for b in piece:
            move = moves.get(state << 8 | b)
            if move is None:
                if len(self.states) > 2 * self.max_states:  # a very long piece with ever new states
                    here = self.states[state]
                    self._reset()
                    moves, state = self.moves, self._number(here)
                move = self._move(state, b)
            state = move >> bits
            ends.append(move & mask)
            if len(ends) > _HELD and (at := self._settled(state, ends)):
                out += self._back(ends, at)
                del ends[:at]
        return out + self._back(ends, len(ends))


#: Bytes of a piece after which settled tokens are emitted.
_HELD = 4096

#: The letters and numbers of Unicode below U+0250, for texts without other characters.
_LATIN_L, _LATIN_N = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"


class _Words(dict):
    """Pre-token -> number; a new one is encoded and its ids go to the end of ``flat``."""

    def __init__(self, fst: Transducer):
        super().__init__()
        self.fst, self.flat, self.ends = fst, array("i"), array("q", [0])

    def __missing__(self, word: str) -> int:
        self.flat.extend(self.fst.encode(word.encode("utf-8", "surrogatepass")))
        self.ends.append(len(self.flat))
        k = self[word] = len(self)
        return k


class Encoder:
    """Ids of pre-tokens; a bounded table of pre-tokens stands in front of the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 400_000, states: int = 250_000):
        self.fst, self.cache = Transducer(ranks, states), cache
        self.words = _Words(self.fst)
        exact = pattern.replace(r"[^\s", f"[^{_WS}").replace(r"(?!\S)", f"(?![^{_WS}])").replace(r"\s+", f"[{_WS}]+")
        self.pattern = regex.compile(exact)
        latin = exact.replace(r"[^" + _WS + r"\p{L}\p{N}]", f"[^{_WS}{_LATIN_L}{_LATIN_N}]").replace(r"\p{L}", f"[{_LATIN_L}]").replace(r"\p{N}", f"[{_LATIN_N}]")
        self.latin = None if r"\p" in latin else re.compile(latin)
        self.beyond = re.compile("[^\x00-\u024f]")

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if self.latin and not self.beyond.search(text):
            return self.latin.findall(text)
        return self.pattern.findall(text)

    def matcher(self, text: str):
        """The function (text, start) -> match that splits this text."""
        return (self.latin if self.latin and not self.beyond.search(text) else self.pattern).match

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self.words) > self.cache or len(self.words.flat) > 16 * self.cache:
            self.words = _Words(self.fst)
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def counts(self, words: list[str]) -> np.ndarray:
        """How many ids each pre-token has."""
        k = self._numbers(words)
        ends = np.frombuffer(self.words.ends, np.int64)
        return ends[k + 1] - ends[k]

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens in a row, and how many each has."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        k = self._numbers(words)
        ends, flat = np.frombuffer(self.words.ends, np.int64), np.frombuffer(self.words.flat, np.int32)
        start = ends[k]
        n = ends[k + 1] - start
        upto = np.cumsum(n)
        return flat[np.arange(upto[-1]) + np.repeat(start - upto + n, n)], n

    def ids(self, text: str) -> list[int]:
        return self.encoded(self.split(text))[0].tolist()


class Utf8Stream:
    """Incremental UTF-8 decoding: ``feed`` returns the text that is complete, and holds at most three bytes back."""

    def __init__(self, errors: str = "replace"):
        self.errors, self.held = errors, b""

    @staticmethod
    def pending(data: bytes) -> int:
        """How many bytes at the end begin a character that more bytes may complete."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:  # the second byte is restricted after E0, ED, F0 and F4
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
                if not low <= data[1 - back] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.held + data
        cut = len(data) - (0 if last else self.pending(data))
        self.held = data[cut:]
        return data[:cut].decode("utf-8", self.errors)


def decode_stream(ids, vocabulary: list[bytes], chunk: int = 1 << 14):
    """Text pieces of a stream of ids; a character may be spread over tokens and chunks."""
    stream, at = Utf8Stream(), 0
    while at < len(ids):
        yield stream.feed(b"".join(map(vocabulary.__getitem__, ids[at : at + chunk])))
        at += chunk
    if rest := stream.feed(b"", last=True):
        yield rest


_LOADED: dict = {}


def _once(kind, path: str, pattern: str | None = None, **sizes: int):
    """One encoder or vocabulary in a Python worker."""
    key = (kind, path, pattern, *sorted(sizes.items()))
    if key not in _LOADED:
        gc.set_threshold(1_000_000, 50, 50)  # the tables have no cycles; walking them again and again costs a third of the time
        ranks = load_ranks(path)
        if kind == "encoder":
            _LOADED[key] = Encoder(ranks, pattern, **sizes)
        else:
            table = [b""] * (max(ranks.values()) + 1)
            for b, r in ranks.items():
                table[r] = b
            _LOADED[key] = table
    return _LOADED[key]


def encode_step(ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids", **sizes: int) -> Step:
    """``out_col array<int>``: the ids of the whole text, no special tokens.

    Null text counts as empty and gives an empty array. A column of the same name
    as ``out_col`` is replaced. Each row is encoded alone, so repeated rows, ties and
    the order of rows don't matter. ``ranks_path`` must exist on every executor. ``sizes``: ``cache`` and ``states``,
    the pre-tokens and states that a Python worker keeps.
    """

    def start():
        enc = _once("encoder", ranks_path, pattern, **sizes)

        def step(texts):
            words, ends = [], [0]
            for x in texts:
                if t := x.as_py():
                    words += enc.split(t)
                ends.append(len(words))
            values, n = enc.encoded(words)
            upto = np.concatenate([[0], np.cumsum(n)])[ends]
            return [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(values))]

        return step

    return Step([text_col], [T.StructField(out_col, T.ArrayType(T.IntegerType(), False))], start)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """``df`` with the column of ``encode_step``."""
    return append_columns(df, encode_step(ranks_path, pattern, text_col, out_col))


def decode_step(ranks_path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> Step:
    """``out_col string``: the text of the ids, decoded as a stream.

    Null or no ids give an empty text. Bytes that aren't UTF-8 become U+FFFD. An id outside the vocabulary is an error.
    """

    def start():
        vocabulary = _once("vocabulary", ranks_path)

        def step(lists):
            values, out = lists.flatten().to_numpy(zero_copy_only=False), []
            at = 0
            for n in lists.value_lengths().fill_null(0).to_pylist():
                out.append("".join(decode_stream(values[at : at + n].tolist(), vocabulary)))
                at += n
            return [pa.array(out, pa.string())]

        return step

    return Step([ids_col], [T.StructField(out_col, T.StringType())], start)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the column of ``decode_step``."""
    return append_columns(df, decode_step(ranks_path, ids_col, out_col))


def _digest_step() -> Step:
    """n_tokens, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256 (of the decoded bytes)."""

    def start():
        decimal: list[str] = []

        def step(lists, texts):
            values, at, ids_sha, text_sha = lists.flatten().to_numpy(zero_copy_only=False), 0, [], []
            if len(values) and (top := int(values.max())) >= len(decimal):
                decimal.extend(map(str, range(len(decimal), top + 1)))
            sizes = lists.value_lengths()
            for n in sizes.to_pylist():
                ids_sha.append(hashlib.sha256(" ".join(map(decimal.__getitem__, values[at : at + n].tolist())).encode()).hexdigest())
                at += n
            for t in texts:
                text_sha.append(hashlib.sha256(t.as_py().encode()).hexdigest())
            return [sizes.cast(pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

        return step

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return Step(["token_ids", "decoded"], fields, start)


def digests(docs: DataFrame, **sizes: int) -> DataFrame:
    """Round trip of every text: doc_id, n_tokens, ids_sha256, decoded_sha256, one row for each row of ``docs``.

    Null and empty texts have no tokens and the digests of no bytes. Repeated rows count one by one; an empty table
    gives an empty one; other columns of ``docs`` don't matter. ``sizes`` as in ``encode_step``.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    steps = encode_step(path, public_tokenizers.PATTERN, **sizes), decode_step(path), _digest_step()
    return append_columns(docs.select("doc_id", "text"), *steps, drop=("text", "token_ids", "decoded"), rows=256)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
