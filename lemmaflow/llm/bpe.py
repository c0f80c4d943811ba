"""Whole-corpus encoding with a public byte-level BPE vocabulary, by prefix-sharing trie traversal.

A byte string's BPE encoding is known from the last token of each of its prefixes: the last token of a
prefix is the one vocabulary entry that ends it and may stand behind the last token of what precedes
it. The distinct words of a batch are visited in sorted order, which is a depth-first walk of their
trie, so the states of a shared prefix are computed once. Candidate entries come from an Aho-Corasick
automaton over the vocabulary; whether two tokens may stand side by side follows from the merge ranks.

Rules: a null and an empty text both have the empty list; special tokens are never made, their strings
are ordinary text; equal texts have equal ids; extra columns are ignored; texts are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.runtime import arrow_schema

#: Fixed value: how byte_bpe_50k parts a text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a worker remembers; beyond it the memory is emptied, which costs time only.
REMEMBER = 400_000
#: Characters of text whose distinct words are walked together.
BLOCK_CHARS = 4_000_000


class TrieEncoder:
    """Encodes words; keeps the encodings and the compatible pairs seen so far."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes_of = {i: t for t, i in self.rank.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}
        self.words: dict[bytes, bytes] = {}
        self._automaton()

    def _automaton(self) -> None:
        """Byte trie of the vocabulary with failure links; ends[state]: (token, length), longest first."""
        step: list[dict[int, int]] = [{}]
        token = [-1]
        for text, i in self.rank.items():
            s = 0
            for b in text:
                n = step[s].get(b)
                if n is None:
                    n = step[s][b] = len(step)
                    step.append({})
                    token.append(-1)
                s = n
            token[s] = i
        fail, ends = [0] * len(step), [()] * len(step)
        level = [0]
        while level:
            below = []
            for s in level:
                for b, n in step[s].items():
                    if s:
                        f = fail[s]
                        while f and b not in step[f]:
                            f = fail[f]
                        fail[n] = step[f].get(b, 0)
                    own = ((token[n], len(self.bytes_of[token[n]])),) if token[n] >= 0 else ()
                    ends[n] = own + ends[fail[n]]
                    below.append(n)
            level = below
        self.step, self.fail, self.ends = step, fail, ends

    def split(self, t: int) -> tuple[int, int]:
        """The two tokens whose merge makes token ``t``; a single byte is made of itself."""
        found = self.halves.get(t)
        if found is None:
            text = self.bytes_of[t]
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                r, k = min((self.rank.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
                if r >= t:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            found = (t, t) if len(parts) == 1 else (self.rank[parts[0]], self.rank[b"".join(parts[1:])])
            self.halves[t] = found
        return found

    def adjacent(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of ``a`` and ``b`` together gives these two tokens.

        Undoes the merges that made them, latest first: if at any time the tokens at the seam have a
        merge that comes before the undone ones, it would have been made instead.
        """
        rank, text = self.rank, self.bytes_of
        bound = 1 << 30
        left, right = a, b
        while True:
            r = rank.get(text[left] + text[right])
            if r is not None and r < bound:
                return False
            undo_left = left > right
            for _ in (0, 1):
                if undo_left:
                    inner = self.split(left)[1]
                    if inner != left:
                        bound, left = left, inner
                        break
                    # nothing to undo on this side: the other side's merge is next
                    bound = right + 1
                else:
                    inner = self.split(right)[0]
                    if inner != right:
                        bound, right = right + 1, inner
                        break
                    bound = left
                undo_left = not undo_left
            else:
                return True

    def learn(self, words: set[bytes]) -> None:
        """Adds the encodings of ``words``: one walk over their trie."""
        step, fail, ends, fits, memory = self.step, self.fail, self.ends, self.fits, self.words
        last: list[int] = [-1]  # last[n]: the last token of the walk's first n bytes
        size: list[int] = [0]
        state: list[int] = [0]
        before = b""
        for word in sorted(words):
            shared = 0
            top = min(len(before), len(word))
            if before[:top] == word[:top]:
                shared = top
            else:
                while before[shared] == word[shared]:
                    shared += 1
            del last[shared + 1 :], size[shared + 1 :], state[shared + 1 :]
            s = state[shared]
            for n in range(shared, len(word)):
                c = word[n]
                nxt = step[s].get(c)
                while nxt is None:
                    if not s:
                        nxt = 0
                        break
                    s = fail[s]
                    nxt = step[s].get(c)
                s = nxt
                for t, k in ends[s]:
                    prev = last[n + 1 - k]
                    if prev < 0:
                        break
                    pair = prev << 20 | t
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits[pair] = self.adjacent(prev, t)
                    if ok:
                        break
                last.append(t)
                size.append(k)
                state.append(s)
            before = word
            out, n = [], len(word)
            while n:
                out.append(last[n])
                n -= size[n]
            out.reverse()
            memory[word] = pa.array(out, pa.int32()).buffers()[1].to_pybytes()[: 4 * len(out)] if len(out) > 8 else b"".join(t.to_bytes(4, "little") for t in out)


_ENCODERS: dict[str, TrieEncoder] = {}


def _encoder(path: str) -> TrieEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def encode_texts(texts: list[str | None], encoder: TrieEncoder, pattern) -> list[bytes]:
    """The ids of each text as little-endian 32-bit integers."""
    cut = [pattern.findall(t) if t else [] for t in texts]
    memory = encoder.words
    if len(memory) > REMEMBER:
        memory.clear()
        encoder.fits.clear()
    new = {w for words in map(set, cut) for w in words if w not in memory}
    if new:
        # keyed by text, so that known words needn't be turned into bytes again
        by_bytes = {w.encode(): w for w in new}
        encoder.learn(set(by_bytes))
        for b, w in by_bytes.items():
            memory[w] = memory.pop(b)
    return [b"".join([memory[w] for w in words]) for words in cut]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>), one row per input row. ``vocabulary``: path of a ranks file on every worker."""
    path = vocabulary or default_vocabulary()
    kind = dict(df.dtypes)[key]
    ddl = f"`{key}` {kind}, ids array<int>"
    arrow = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import regex

        encoder, pattern = _encoder(path), regex.compile(PATTERN)

        def emit(keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
            ids = encode_texts(texts, encoder, pattern)
            ends = np.cumsum([0] + [len(x) // 4 for x in ids], dtype=np.int64)
            data = b"".join(ids)
            flat = pa.Array.from_buffers(pa.int32(), len(data) // 4, [None, pa.py_buffer(data)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            return pa.RecordBatch.from_arrays([keys.cast(arrow[0].type), lists.cast(arrow[1].type)], schema=arrow)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            first = size = 0
            for n, t in enumerate(texts):
                size += len(t or "")
                if size >= BLOCK_CHARS:
                    yield emit(batch.column(0).slice(first, n + 1 - first), texts[first : n + 1])
                    first, size = n + 1, 0
            if first < len(texts):
                yield emit(batch.column(0).slice(first), texts[first:])

    return df.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, ddl)
