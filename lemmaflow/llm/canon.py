"""One consistent form for texts that look alike but differ in their characters.

Composition, widths, blanks and invisible characters are unified first. Then scripts are repaired token
by token, in tokens that mix scripts only: the dominant script of a token is that of its letters that
have no double in another script (or, if it has none, of such letters in the whole text), and its
look-alike letters are replaced by their doubles in that script if the result is a word of the corpus.

For comparing texts a token counts by its skeleton, where every look-alike is one letter, if nothing
tells its script: a token made of look-alikes only, in whatever script, or one whose repair no word of
the corpus confirms. In the canonical text such tokens keep their letters.

Texts that look alike form classes (alike_classes); pairs of them are made from the classes.

Rules: letter case, marks, digits, superscripts and punctuation stay as they are; line ends are LF;
blanks at either end are dropped; null and blank texts have no canonical form; redelivered keys count
once; extra columns are ignored; whole texts are compared, by a 256-bit digest of each form.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.functions.charclass import ranges
from lemmaflow.functions.lookalikes import plain_table, to_latin, to_script
from lemmaflow.runtime import arrow_batch, arrow_schema, staged

_SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
_TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯ҃-҇]+[^\W\d_]*)*")
_HAS = (re.compile(r"[A-Za-zÀ-ɏ]"), re.compile(r"[Ѐ-ԯ]"), re.compile(r"[Ͱ-Ͽἀ-῿]"))


def _class(points) -> re.Pattern:
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges(frozenset(points))) + "]")


@cache
def _special() -> re.Pattern:
    """Any character that plain() changes."""
    return _class(cp for cp in {*plain_table(), 13} - {32} if not 0xD800 <= cp < 0xE000)


def plain(text: str) -> str:
    """Composed, with unified widths and blanks and without invisible characters."""
    out = unicodedata.normalize("NFC", text)
    if _special().search(out):  # most texts have nothing to change, and searching is quick
        out = out.translate(plain_table()).replace("\r\n", "\n").replace("\r", "\n")
        out = unicodedata.normalize("NFC", out)
    return out.strip()


@lru_cache(1 << 14)
def _script(c: str) -> str:
    name = unicodedata.name(c, "")
    return next((s for s in _SCRIPTS if name.startswith(s)), "")


@lru_cache(1)
def _doubled() -> frozenset[str]:
    """Letters that have a double in another script."""
    latin = to_latin()
    return frozenset(latin) | frozenset(latin.values())


@lru_cache(1 << 14)
def _in_doubt(c: str) -> bool:
    """Whether the letter, or the one its marks stand on, has a double in another script."""
    return unicodedata.normalize("NFD", c)[0] in _doubled()


@cache
def _doubt() -> re.Pattern:
    """Any letter in doubt, in the blocks of the three scripts."""
    return _class(cp for low, high in ((0x41, 0x250), (0x370, 0x530), (0x1E00, 0x2000)) for cp in range(low, high) if _in_doubt(chr(cp)))


@cache
def _certain_letters() -> dict[str, re.Pattern]:
    """Runs of the letters of each script that no other script has a double of."""
    blocks = [cp for low, high in ((0x41, 0x250), (0x370, 0x530), (0x1E00, 0x2000)) for cp in range(low, high) if chr(cp).isalpha() and not _in_doubt(chr(cp))]
    return {s: re.compile(_class(cp for cp in blocks if _script(chr(cp)) == s).pattern + "+") for s in _SCRIPTS}


def _certain(text: str) -> Counter:
    return Counter({s: sum(map(len, found)) for s, p in _certain_letters().items() if (found := p.findall(text))})


@lru_cache(1 << 17)
def _own_script(token: str) -> str:
    return _foremost(_certain(token))


def _foremost(counts: Counter) -> str:
    if not counts:
        return ""
    top = max(counts.values())
    best = [s for s in _SCRIPTS if counts.get(s) == top]
    return best[0] if len(best) == 1 else ""


@lru_cache(1 << 17)
def repair(token: str, script: str) -> str:
    """``token`` with its look-alikes of other scripts replaced by their doubles in ``script``."""
    doubles = to_script(script)

    def double(c: str) -> str:
        if _script(c) in ("", script):
            return c
        base, *marks = unicodedata.normalize("NFD", c)
        return doubles.get(c) or doubles.get(base, base) + "".join(marks)

    return unicodedata.normalize("NFC", "".join(map(double, token)))


def skeleton(token: str) -> str:
    latin = to_latin()
    return "\u0001" + "".join(latin.get(c, c) for c in unicodedata.normalize("NFD", token))


@cache
def _undecided() -> re.Pattern:
    """A token all of whose letters have doubles in another script."""
    letters = _doubt().pattern
    return re.compile(rf"(?<![^\W\d_])(?<![\u0300-\u036f\u0483-\u0487]){letters}(?:{letters}|[\u0300-\u036f\u0483-\u0487])*(?![^\W\d_])")


def repairs(text: str) -> dict[str, str]:
    """Token -> its candidate repair, for the tokens of a plain text that mix scripts."""
    if sum(bool(x.search(text)) for x in _HAS) < 2:
        return {}
    main = None
    out: dict[str, str] = {}
    for token in set(_TOKEN.findall(text)):
        if sum(bool(x.search(token)) for x in _HAS) < 2 or not _doubt().search(token):
            continue
        target = _own_script(token)
        if not target and not _certain(token):
            if main is None:
                main = _foremost(_certain(text)) or _foremost(Counter(s for c in text if (s := _script(c))))
            target = main
        fixed = repair(token, target) if target else token
        # a token that stays mixed is no word; it is listed for its skeleton
        out[token] = fixed if sum(bool(x.search(fixed)) for x in _HAS) < 2 else token
    return out


def look_of(text: str, found: dict[str, str], sure: dict[str, str]) -> str:
    """What a plain text is compared by: sure repairs made, and skeletons where nothing tells the script."""
    changed = rewritten(text, {a: sure.get(a) or skeleton(a) for a in found if not _undecided().fullmatch(a)})
    return _undecided().sub(lambda m: skeleton(m.group()), changed)


def clean_words(text: str, doubtful: dict[str, str]) -> set[str]:
    """Tokens of a plain text that are of one script and could be the result of a repair."""
    return {t for t in set(_TOKEN.findall(text)) if t not in doubtful and _doubt().search(t)}


def rewritten(text: str, change: dict[str, str]) -> str:
    return _TOKEN.sub(lambda m: change.get(m.group(), m.group()), text) if change else text


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def _over(source: DataFrame, ddl: str, rows) -> DataFrame:
    arrow = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(rows(batch))
            yield arrow_batch(arrow, zip(*found) if found else [[] for _ in arrow])

    return source.mapInArrow(run, ddl)


def canonical(df: DataFrame, key: str, text: str, vocabulary: DataFrame | None = None, with_text: bool = True) -> DataFrame:
    """(key, canonical_text, look binary, exact binary) of every non-blank text, one row per key.

    Texts that look the same share ``look``; equal texts share ``exact``. ``vocabulary``: further
    (word) rows that confirm repairs, besides the words of the texts themselves. Without ``with_text``
    the canonical texts are null, and only those that need repairs are ever written down.
    """
    kind = dict(df.dtypes)[key]
    docs = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t is not null")

    def first_rows(batch):
        # one reading of the texts settles those that need no repair, and gives the repairs that the others
        # need and the words that may confirm them
        words: set[str] = set()
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p = plain(t)
            if not p:
                continue
            found = repairs(p)
            words |= clean_words(p, found)
            if found:
                yield k, list(found.values()), None, p, None, _digest(t)
            else:
                yield k, None, None, p if with_text else None, _digest(look_of(p, {}, {})), _digest(t)
        yield from ((None, None, w, None, None, None) for w in words)

    first = staged(_over(docs, f"k {kind}, candidates array<string>, word string, p string, look binary, exact binary", first_rows), "canon-first")
    sound = first.where("k is not null and candidates is null").select("k", F.col("p").alias("canonical_text"), "look", "exact")
    doubtful = first.where("k is not null and candidates is not null").dropDuplicates(["k"])
    candidates = doubtful.select("k", F.explode("candidates").alias("word"))
    words = first.where("word is not null").select("word")
    if vocabulary is not None:
        words = words.unionByName(vocabulary.select("word"))
    confirmed = candidates.select("word").distinct().join(words.distinct(), "word", "left_semi")
    known = candidates.join(confirmed, "word").groupBy("k").agg(F.collect_set("word").alias("known"))

    def final_rows(batch):
        for k, p, exact, known in zip(*(batch.column(i).to_pylist() for i in range(4))):
            found = repairs(p)
            words = set(known or ())
            sure = {a: b for a, b in found.items() if b in words}
            yield k, rewritten(p, sure) if with_text else None, _digest(look_of(p, found, sure)), exact

    marked = doubtful.select("k", "p", "exact").join(known, "k", "left")
    repaired = _over(marked, f"k {kind}, canonical_text string, look binary, exact binary", final_rows)
    return sound.dropDuplicates(["k"]).unionByName(repaired).withColumnRenamed("k", key)


def alike_classes(forms: DataFrame, key: str) -> DataFrame:
    """(key, class_id, n_looks, n_alike): one row per text of a class of texts that look the same but aren't all equal.

    class_id is the hexadecimal digest of the common look, n_looks the number of different texts in the
    class and n_alike that of the keys the text looks like without being equal. Copies are counted
    before they meet, so no class gathers in one task.
    """
    members = forms.select(key, "look", "exact").distinct()
    copies = members.groupBy("look", "exact").agg(F.count("*").alias("n"))
    classes = copies.groupBy("look").agg(F.count("*").alias("n_looks"), F.sum("n").alias("n_members")).where("n_looks > 1")
    found = copies.join(classes, "look").select("look", "exact", "n_looks", (F.col("n_members") - F.col("n")).alias("n_alike"))
    return members.join(found, ["look", "exact"]).select(key, F.lower(F.hex("look")).alias("class_id"), "n_looks", "n_alike")


def alike_pairs(forms: DataFrame, key: str) -> DataFrame:
    """(key_a, key_b), smaller first: different keys whose texts look the same but aren't equal.

    For reports that must name every pair; alike_classes() says the same in one row per text. Only
    texts of one look are paired, and copies of one text meet no copy of the same text.
    """
    members = forms.select(F.col(key).alias("k"), "look", "exact").distinct()
    classes = members.select("look", "exact").distinct()
    several = classes.groupBy("look").agg(F.count("*").alias("n")).where("n > 1").select("look")
    classes = classes.join(several, "look", "left_semi")
    a, b = classes.alias("a"), classes.alias("b")
    pairs = a.join(b, F.col("a.look").eqNullSafe(F.col("b.look")) & (F.col("a.exact") < F.col("b.exact"))).select(F.col("a.look").alias("look"), F.col("a.exact").alias("ea"), F.col("b.exact").alias("eb"))
    left = members.select(F.col("k").alias("ka"), "look", F.col("exact").alias("ea"))
    right = members.select(F.col("k").alias("kb"), "look", F.col("exact").alias("eb"))
    out = pairs.join(left, ["look", "ea"]).join(right, ["look", "eb"]).where("ka <> kb")
    return out.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))
