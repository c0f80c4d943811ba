"""Held-out test items that leak into a corpus, by a generalised suffix automaton over words.

The automaton holds every run of words of every item. Each document streams through it once: the state
tells the longest run of words that ends here and stands in some item. A run of ``least`` words, or a
whole item that has fewer, is a leak of every item that holds it.

Words are maximal runs of letters and digits; case, punctuation, white space, invisible characters,
widths and look-alike letters make no difference.

Rules: null, empty and wordless documents and items never match; an item of fewer than ``least`` words
matches as a whole only; equal items are all reported; a pair is reported once for each row of a
document; extra columns are ignored; documents are read whole, and once, however many items there are.

Items go to blocks by the hash of their key. Tasks build the automaton of each block and write it to
the shared folder; the tasks of the documents hold a few million characters of texts at a time and lead
them through the automata one after another, so that one automaton is in memory at once.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.functions.lookalikes import invisible, skeleton_table
from lemmaflow.runtime import arrow_batch, arrow_schema, scratch

WORD = re.compile(r"[^\W_]+")
#: Words of test items in one automaton, about, and characters of documents that are led through all automata together.
BLOCK_WORDS, BATCH_CHARS = 500_000, 4_000_000


def normalised(text: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold().translate(skeleton_table()))


def words(text: str | None) -> list[str]:
    return WORD.findall(normalised(text)) if text else []


class Automaton:
    """Suffix automaton of several word sequences; ``last`` never matches across two of them."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int):
        self.ids: dict[str, int] = {}
        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        ends: list[tuple[int, int]] = []
        self.least = least
        for number, (_, sequence) in enumerate(items):
            last = 0
            for word in sequence:
                w = self.ids.setdefault(word, len(self.ids))
                last = self._extend(nxt, link, length, last, w)
                ends.append((last, number))
        self.next, self.link, self.length = nxt, link, length
        # items of each state: those of every state whose suffix chain passes through it
        holds: dict[int, set[int]] = {}
        for s, number in ends:
            while length[s] >= least and number not in holds.setdefault(s, set()):
                holds[s].add(number)
                s = link[s]
        key = [k for k, _ in items]
        #: For a match of at least ``least`` words: items that hold its last ``least`` words.
        self.long: list[tuple[int, ...]] = [()] * len(nxt)
        #: Whole short items that end a state's runs: (words, item).
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(nxt)
        same: dict[tuple[int, ...], tuple[int, ...]] = {}  # states of one passage share one tuple
        whole: dict[int, list[tuple[int, int]]] = {}
        for number, (k, sequence) in enumerate(items):
            if 0 < len(sequence) < least:
                s = 0
                for word in sequence:
                    s = nxt[s][self.ids[word]]
                whole.setdefault(s, []).append((len(sequence), k))
        for s in sorted(range(1, len(nxt)), key=length.__getitem__):
            up = link[s]
            if length[s] >= least:
                found = self.long[up] if length[up] >= least else tuple(key[n] for n in sorted(holds[s]))
                self.long[s] = same.setdefault(found, found)
            self.short[s] = self.short[up] + tuple(whole[s]) if s in whole else self.short[up]

    @staticmethod
    def _extend(nxt, link, length, last: int, w: int) -> int:
        """Appends word ``w`` behind state ``last``; gives the state of the longer run."""
        known = nxt[last].get(w)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is None:
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p < 0:
                return new
            known = nxt[p][w]
            if length[known] == length[p] + 1:
                link[new] = known
                return new
        else:
            new, p = None, last
        copy = len(nxt)
        nxt.append(dict(nxt[known]))
        length.append(length[p] + 1)
        link.append(link[known])
        link[known] = copy
        while p >= 0 and nxt[p].get(w) == known:
            nxt[p][w] = copy
            p = link[p]
        if new is None:
            return copy
        link[new] = copy
        return new

    def stream(self, sequence: list[int]) -> Iterator[tuple[int, int, int]]:
        """(index of the last word, words matched, state) wherever the run is a leak or longer."""
        nxt, link, length, least, short = self.next, self.link, self.length, self.least, self.short
        s = n = 0
        for at, w in enumerate(sequence):
            if w < 0:
                s = n = 0
                continue
            to = nxt[s].get(w)
            while to is None and s:
                s = link[s]
                n = length[s]
                to = nxt[s].get(w)
            if to is None:
                n = 0
                continue
            s = to
            n += 1
            if n >= least or short[s]:
                yield at, n, s

    def spans(self, text_words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """item -> (first word, end) of its leaked runs in a document, merged and in order."""
        get = self.ids.get
        out: dict[int, list[tuple[int, int]]] = {}
        for at, n, s in self.stream([get(w, -1) for w in text_words]):
            hits = [(i, self.least) for i in self.long[s]] if n >= self.least else []
            hits += [(i, k) for k, i in self.short[s] if k <= n]
            for i, k in hits:
                runs = out.setdefault(i, [])
                if runs and runs[-1][1] >= at + 1 - k:
                    runs[-1] = (runs[-1][0], at + 1)
                else:
                    runs.append((at + 1 - k, at + 1))
        return out


def write_automata(items: DataFrame, key: str, text: str, least: int) -> list[str]:
    """URIs of the automata of all items, about BLOCK_WORDS words each, built and written by tasks."""
    place = scratch(items.sparkSession, "automata")
    listed = items.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t is not null")
    # letters and digits with what parts them are at least two characters a word
    size = listed.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * BLOCK_WORDS)))
    ddl = "uri string"
    arrow = arrow_schema(ddl)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        held: dict[int, list[tuple[int, list[str]]]] = {}
        for batch in batches:
            for b, k, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = words(t)
                if found:
                    held.setdefault(b, []).append((k, found))
        out = []
        for b, found in held.items():
            # a repeated attempt writes another file, and only the rows of the one that counts are seen
            uri = f"{place}/{b}-{uuid.uuid4().hex}"
            system, path = fs.FileSystem.from_uri(uri)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            with system.open_output_stream(path) as f:
                f.write(pickle.dumps(Automaton(sorted(found), least)))
            out.append((uri,))
        yield arrow_batch(arrow, zip(*out) if out else [[]])

    blocked = listed.distinct().select(F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int").alias("b"), "k", "t").repartition(blocks, "b")
    return sorted(r["uri"] for r in blocked.mapInArrow(build, ddl).collect())


_HELD: dict[str, Automaton] = {}


def _automaton(uri: str) -> Automaton:
    """The automaton of a file; a task keeps the last one."""
    if uri not in _HELD:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_stream(path) as f:
            read = pickle.loads(f.read())
        _HELD.clear()
        _HELD[uri] = read
    return _HELD[uri]


def _through_all(docs: DataFrame, uris: list[str], ddl: str, rows) -> DataFrame:
    """``rows(key, text, words, spans by item)`` of every document (k, t) with leaks, in one narrow pass."""
    arrow = arrow_schema(ddl)

    def judged(held: list[tuple[int, str, list[str]]]) -> pa.RecordBatch:
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for uri in uris:
            automaton = _automaton(uri)
            for n, (_, _, w) in enumerate(held):
                spans = automaton.spans(w)
                if spans:
                    found.setdefault(n, {}).update(spans)
        out = [r for n, spans in sorted(found.items()) for r in rows(*held[n], spans)]
        return arrow_batch(arrow, zip(*out) if out else [[] for _ in arrow])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((k, t, words(t)))
                size += len(t)
                if size >= BATCH_CHARS:
                    yield judged(held)
                    held, size = [], 0
        if held:
            yield judged(held)

    return docs.mapInArrow(run, ddl)


def _documents(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t <> ''")


def find_leaks(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text", least: int = 12) -> DataFrame:
    """(key, item, n_words, coverage): leaked words of the item's runs, and their share of the document's words."""

    def rows(k: int, t: str, found: list[str], spans: dict):
        for item, runs in sorted(spans.items()):
            n = sum(b - a for a, b in runs)
            yield k, item, n, n / len(found)

    out = _through_all(_documents(df, key, text), write_automata(items, item_key, item_text, least), "k bigint, item bigint, n_words bigint, coverage double", rows)
    return out.select(F.col("k").alias(key), F.col("item").alias(item_key), "n_words", "coverage")


def remove_leaks(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text", least: int = 12, drop_above: float = 0.5) -> DataFrame:
    """(key, clean_text, removed_words): leaked runs cut out of the documents that have any.

    A document more than ``drop_above`` of whose words leaked, to whichever items, has a null clean_text.
    """

    def rows(k: int, t: str, found: list[str], spans: dict):
        gone = sorted({n for runs in spans.values() for a, b in runs for n in range(a, b)})
        yield k, None if len(gone) > drop_above * len(found) else _without(t, word_spans(t), gone), len(gone)

    return _through_all(_documents(df, key, text), write_automata(items, item_key, item_text, least), "k bigint, clean_text string, removed_words bigint", rows).withColumnRenamed("k", key)


def _without(t: str, at: list[tuple[int, int]], gone: list[int]) -> str:
    """``t`` less the words of the numbers ``gone``, in order, and what lies between words that adjoin."""
    kept, pos, n = [], 0, 0
    while n < len(gone):
        m = n
        while m + 1 < len(gone) and gone[m + 1] == gone[m] + 1:
            m += 1
        kept.append(t[pos : at[gone[n]][0]])
        pos = at[gone[m]][1]
        n = m + 1
    return "".join(kept) + t[pos:]


@cache
def _pieces() -> re.Pattern:
    """A character with the marks that join it, invisible characters between them or not."""
    hidden = "".join(f"\\U{cp:08x}" for cp in sorted(invisible()) if not 0xD800 <= cp < 0xE000)
    return re.compile(f"(?s).(?:[{hidden}]*[\u0300-\u036f\u0483-\u0487])*")


def word_spans(text: str) -> list[tuple[int, int]]:
    """Code-point spans in ``text`` of the words that words() gives, in the same order."""
    out, hidden, open_at = [], invisible(), None
    pieces: list[tuple[int, int, str]] = []
    for m in _pieces().finditer(text):
        pieces.append((m.start(), m.end(), normalised(m.group())))
    for a, b, n in pieces:
        if not n and all(ord(c) in hidden for c in text[a:b]):
            continue
        for m in re.finditer(r"[^\W_]+|[\W_]+", n):
            if WORD.match(m.group()):
                if open_at is None:
                    open_at = [a, b]
                elif m.start() and open_at:
                    out.append(tuple(open_at))
                    open_at = [a, b]
                open_at[1] = b
            elif open_at is not None:
                out.append(tuple(open_at))
                open_at = None
    if open_at is not None:
        out.append(tuple(open_at))
    return out
