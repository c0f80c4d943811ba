"""Sentences of texts in many languages and scripts, with statistics learned from the texts themselves.

Learning reads every text once and counts, per language, what stands around each period: which word is
before it and whether a capital, a small letter, a digit or the end of a paragraph follows. As the last
period of a paragraph always ends a sentence, log-likelihood ratios tell which words are followed by a
capital but end paragraphs too seldom to end sentences (titles, initials, ordinals), which are followed
by small letters or digits too often to be words (abbreviations inside sentences), which pairs hold
together over a period (collocations), and which words begin sentences (starters). Classifying reads
every text once more and judges each mark by these.

Rules: offsets are code points, end exclusive, without white space at either end. Null and blank texts
have no sentence. Closing marks, quotes and brackets belong to the sentence they close, a list number to
its item. A quoted question or exclamation with more of the sentence behind it doesn't end it. A blank
line or paragraph separator always ends a sentence, a single line break does not. Scripts with marks of
their own end at those only; Thai, Lao, Khmer and Burmese text ends at white space. Redelivered or equal
texts are split alike; extra columns are ignored.
"""

from __future__ import annotations

import re as _re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.runtime import arrow_batch, arrow_schema, staged

#: Ratios beyond this count as evidence (chance in about one of two thousand words), and the least share of a language's
#: periods that a word must stand before: so at most 1 / LEAST_SHARE words of a language enter the model.
LEAST_RATIO, LEAST_SHARE, LEAST_COUNT = 12.1, 2e-6, 6
#: A word ends a sentence before a capital if at least this share of its cases does; between the two
#: shares the next word decides.
SURELY_NOT, SURELY = 0.3, 0.7
PROFILE = 100
#: Distinct counts of a language that a task gathers before it hands them on.
HELD = 200_000
_COUNTED = ("ends", "upper", "caseless", "lower", "digits", "starts", "middles")

# Marks and scripts.
OWN_MARKS = "।॥։።፧؟۔។။။။"
WIDE_MARKS = "。！？｡"
CLOSERS = "»”’“\"')]}」』】）》〉›"
OPENERS = "«„“\"'([{¿¡「『【（《〈‹"
NO_MARK = "฀-๿຀-໿ក-៿က-႟"
MARKED = "ऀ-ॿঀ-෿԰-֏ሀ-፿぀-ヿ㐀-䶿一-鿿"

_EDGE = _re.compile(
    rf"(?P<para>(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)\s*| \s*)"
    rf"|(?P<mark>[.!?…;;{OWN_MARKS}{WIDE_MARKS}]+)(?P<close>[{_re.escape(CLOSERS)}]*)(?P<space>\s*)"
    rf"|(?<=[{NO_MARK}])(?P<gap>\s+)|(?<!\s)(?P<gap2>\s++)(?=[{NO_MARK}])"
)
# Read backwards from a period: the word before it.
_BEFORE = _re.compile(r"[\w\u0300-\u036f][\w.\-’'\u0300-\u036f]*")
_WORD = _re.compile(r"[\w\u0300-\u036f’'\-]+")
_INITIALS = _re.compile(r"(?:[^\W\d_]\.\s?)*[^\W\d_]\Z")
_MIDDLE = _re.compile(r"(?<=\w )[^\W\d_]\w*+(?=[ ,])")
_BLANK = _re.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)| ")
_NUMBER = _re.compile(r"[\d.,\-:/]*\d\Z")
_LINE_NUMBER = _re.compile(r"(?:\A|[\r\n])[^\S\r\n]*\(?(?:\d{1,4}|[^\W\d_])(?:\.\d{1,3})*\Z")


def _after(text: str, at: int) -> str:
    """What follows: E end of paragraph, U capital, L small letter, C letter without case, D digit, - dash, O other."""
    n = len(text)
    gap = at
    while gap < n and text[gap].isspace():
        gap += 1
    if gap >= n or (gap > at and _BLANK.search(text, at, gap)):
        return "E"
    c = text[gap]
    k = gap
    while c in OPENERS and k + 1 < n:
        k += 1
        c = text[k]
    if c.isdigit():
        return "D"
    if c.isalpha():
        return "U" if c.isupper() or c.istitle() else "L" if c.islower() else "C"
    return "-" if c in "—–-" else "," if c in ",:;.)" and k == gap else "O"


def period_key(text: str, at: int) -> tuple[str, str]:
    """(key of the word before the period at ``at``, the word); keys keep what statistics tell apart."""
    m = _BEFORE.match(text[max(0, at - 40) : at][::-1])
    if not m:
        return "", ""
    word = m.group()[::-1].lstrip(".-’'")
    if not word:
        return "", ""
    if _NUMBER.match(word):
        return "#", word
    if _INITIALS.match(word) and word[0].isupper() and (len(word) == 1 or "." in word):
        return (word if len(word) == 1 else "&"), word
    key = word.lower()
    start = at - len(word)
    before = text[max(0, start - 2) : start].rstrip()
    return ("#" + key if before[-1:].isdigit() else key), word


def _next_word(text: str, at: int) -> str:
    m = _WORD.search(text, at, at + 60)
    return m.group() if m and not text[at : m.start()].strip(OPENERS + " \t\r\n ") else ""


def period_counts(text: str, out: Counter) -> None:
    """Adds what stands around the periods of ``text``: (kind, key, what follows) -> count; a word alone counts mid-sentence."""
    for m in _re.finditer(r"\.(?=\s|\Z)(?<!\.\.)", text):
        at = m.start()
        key, _ = period_key(text, at)
        if not key:
            continue
        kind = _after(text, at + 1)
        out["p", key, kind] += 1
        if kind in "UC":
            follower = _next_word(text, at + 1).lower()
            if follower:
                out["c", f"{key} {follower}", kind] += 1
    for m in _re.finditer(r"[!?]\s++(?=\w)|(?<!\s)[^\S\n]*+\n[^\S\n]*+\n\s*+(?=\w)", text):
        word = _next_word(text, m.end())
        if word and word[0].isupper():
            out["s", word.lower(), "S"] += 1
    out.update(_MIDDLE.findall(text))


def language(label: str | None) -> str:
    """A label as two or three small letters; empty if it says nothing."""
    code = _re.split(r"[-_]", (label or "").strip().lower())[0]
    return "" if code in ("", "und", "unknown", "null", "none", "xx") else code[:3]


class Model:
    """What was learned of one language."""

    def __init__(self):
        self.inside: set[str] = set()
        self.ends: dict[str, float] = {}
        self.pairs: set[str] = set()
        self.starters: set[str] = set()
        self.profile: set[str] = set()
        self.known: set[str] = set()
        self.initials = 0.0
        self.others: dict[str, Model] = {}

    def period(self, key: str, follows: str, follower: str) -> bool:
        """Whether a period behind a word ends the sentence, given what follows within the paragraph."""
        bare = key[1:] if key.startswith("#") and len(key) > 1 else key
        if self.others and key not in self.known and key not in ("#", "&"):
            other = self.others.get("~" + script(bare))
            if other is not None and (key in other.ends or bare in other.ends or bare in other.inside):
                return other.period(key, follows, follower)
        if follows == "L":
            return False
        if key == "#" or key in self.inside or bare in self.inside:
            if follows == "D":
                return False
        if follows == "D":
            return key not in self.ends or self.ends[key] > SURELY_NOT
        initial = key == "&" or (len(key) == 1 and key.isupper())
        share = self.ends.get(key)
        if share is None and key != bare:
            share = self.ends.get(bare)
        if share is None:
            share = self.initials if initial else 1.0
        if share < SURELY_NOT or f"{key} {follower}" in self.pairs:
            return False
        return share > SURELY or follower in self.starters


def _cased(c: str) -> bool:
    return c.isupper() or c.islower()


def spans(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text."""
    out: list[tuple[int, int]] = []
    start = 0

    def close(end: int, nxt: int) -> None:
        nonlocal start
        a, b = start, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
        start = nxt

    for m in _EDGE.finditer(text):
        if m.start() < start:
            continue
        mark = m["mark"]
        if mark is None:
            close(m.start(), m.end())
            continue
        closers, after = m["close"], m.end("close")
        before = text[m.start() - 1] if m.start() else ""
        spaced, end = bool(m["space"]), m.end()
        if "“" in closers and text.rfind("„", start, after) <= text.rfind("“", start, m.start("close")):
            # it opens the next quotation: only behind an open „ does it close one
            closers = closers[: closers.index("“")]
            after = end = m.start("close") + len(closers)
            spaced = False
        if mark.strip(";;") == "":
            # a question mark in Greek, a semicolon elsewhere
            if "Ͱ" <= before <= "Ͽ" or "ἀ" <= before <= "῿":
                follows = _after(text, after)
                if (spaced or follows == "E") and follows not in "L,":
                    close(after, end)
            continue
        follows = _after(text, after)
        if follows == "E":
            close(after, end)
            continue
        last = mark.rstrip(";")[-1]
        if last in OWN_MARKS or last in WIDE_MARKS:
            nxt = text[end : end + 1]
            if closers and last in WIDE_MARKS and nxt in ("と", "っ"):
                continue
            if follows == "," or (closers and follows in "L-"):
                continue
            close(after, end)
            continue
        if last in "!?":
            if follows in "L,":
                continue
            if follows == "-":
                # a dash goes on with the sentence of a quotation; else what is behind it decides
                behind = _after(text, text.index(text[end], end) + 1)
                if closers or behind == "L":
                    continue
            elif not spaced and follows not in "UC":
                continue
            close(after, end)
        elif last == "…" or len(mark) > 1:
            if _WIDE.match(before) or (not spaced and _WIDE.match(text[after : after + 1])):
                close(after, end)
            elif follows in "L,":
                continue
            elif follows == "-":
                if not closers and _after(text, text.index(text[end], end) + 1) != "L":
                    close(after, end)
            elif spaced or follows == "U":
                close(after, end)
        else:
            if before >= "\u0530" and _MARKED.match(before):
                continue
            if closers and follows in "L-,":
                continue
            key, word = period_key(text, m.start())
            if not spaced:
                # no blank behind: a capital after a whole word begins a sentence that lacks its blank
                if closers:
                    if follows == "U":
                        close(after, end)
                elif follows == "U" and word[-1:].islower() and len(word) > 1 and "." not in word and text[after + 1 : after + 2].lower() == text[after + 1 : after + 2] and text[after : after + 1].isupper():
                    if model.period(key, "U", _next_word(text, after).lower()):
                        close(after, end)
                continue
            if follows == ",":
                continue
            if follows == "-":
                if _after(text, text.index(text[end], end) + 1) == "L":
                    continue
                follows = "U"
            # a list number ends with a digit or is one letter
            if (before.isdigit() or not text[max(0, m.start() - 2) : m.start() - 1].isalpha()) and _LINE_NUMBER.search(text, max(0, m.start() - 24), m.start()):
                continue
            if closers or model.period(key, "U" if follows in "UCO" else follows, _next_word(text, after).lower()):
                close(after, end)
    close(len(text), len(text))
    return out


_WIDE = _re.compile("[぀-ヿ㐀-䶿一-鿿　-〿！-～]")
_MARKED = _re.compile(f"[{MARKED}{NO_MARK}]")


def learn(df: DataFrame, text: str, label: str) -> dict[str, Model]:
    """The models of all languages, from every row of ``df``."""
    ddl = "language string, kind string, word string, follows string, n bigint"
    arrow = arrow_schema(ddl)

    def counted(counts: dict[str, Counter]) -> pa.RecordBatch:
        rows = [(l, *(("s", k.lower(), "M") if isinstance(k, str) else k), n) for l, c in counts.items() for k, n in c.items()]
        return arrow_batch(arrow, zip(*rows) if rows else [[] for _ in arrow])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for t, l in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code = language(l)
                period_counts(t, counts.setdefault(code, Counter()))
                if len(counts[code]) > HELD:
                    yield counted({code: counts.pop(code)})
            yield counted(counts)

    source = df.select(F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("l")).where("t is not null")
    each = source.mapInArrow(run, ddl).groupBy("language", "kind", "word").agg(*[F.sum(F.when(F.col("follows") == f, F.col("n")).otherwise(0)).alias(name) for f, name in zip("EUCLDSM", _COUNTED)])
    # words that hardly begin a sentence only count in the sums of their language
    seldom = (F.col("kind") == "s") & (F.col("starts") < LEAST_COUNT)
    each = each.withColumn("word", F.when(seldom, "").otherwise(F.col("word"))).groupBy("language", "kind", "word").agg(*[F.sum(c).alias(c) for c in _COUNTED])
    each = staged(each, "period-counts")  # read several times below; the texts are read once
    n = sum((F.col(c) for c in _COUNTED), F.lit(0))
    capital, inside = F.col("upper") + F.col("caseless"), F.col("lower") + F.col("digits")
    words = each.where("kind = 'p'").withColumns({"n": n, "letter": F.regexp_extract("word", "\\p{L}", 0)})
    # as script() has it
    words = words.withColumn("script", F.when(F.col("letter") < "\u0250", "~latin").when(F.col("letter") < "\u0400", "~greek").when(F.col("letter") < "\u0530", "~cyrillic").otherwise("~other"))
    sums = [F.sum(c).alias(c) for c in _COUNTED]
    # every label has its totals, also one of a script that ends no sentence at a period
    totals = each.groupBy("language").agg(*[F.sum(F.when(F.col("kind") == "p", F.col(c)).otherwise(0)).alias(c) for c in _COUNTED]).unionByName(words.groupBy(F.col("script").alias("language")).agg(*sums))
    base = totals.select("language", n.alias("total"), (F.col("ends") / F.greatest(F.col("ends") + capital, F.lit(1))).alias("usual"))
    frequent = words.join(base, "language").where((F.col("n") >= LEAST_COUNT) & (F.col("n") >= F.col("total") * LEAST_SHARE))
    # only words that end paragraphs seldom, or go on often, can differ from ordinary ones; those are compared in every language
    odd = frequent.where((F.col("ends") < SURELY * F.col("usual") * (F.col("ends") + capital)) | (inside > 0.05 * (capital + inside)) | (F.length("word") == 1) | F.col("word").isin("#", "&")).select("word").distinct()
    def foremost(rows: DataFrame, most: int) -> DataFrame:
        # the best of each slice first, so that no language's words gather in one task
        for part in (["language", "kind", "slice"], ["language", "kind"]):
            rank = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("n"), "word"))
            rows = rows.withColumn("slice", F.pmod(F.xxhash64("word"), F.lit(64))).withColumn("r", rank).where(F.col("r") <= most)
        return rows.select(*fixed)

    fixed = ["language", "kind", "word", *_COUNTED]
    top = foremost(words, 2 * PROFILE)
    chosen = frequent.join(odd, "word", "left_semi").select(*fixed).union(top).distinct().union(_pairs(each, frequent.where(inside > 0.05 * (capital + inside))).select(*fixed)).union(_starters(each).select(*fixed))
    chosen = chosen.union(totals.select("language", F.lit("total").alias("kind"), F.lit("").alias("word"), *_COUNTED))
    return models([r.asDict() for r in chosen.collect()])


def _pairs(each: DataFrame, before: DataFrame) -> DataFrame:
    """The pairs that hold together over a period and a capital, of all pairs whose first word is in ``before``.

    What a small letter follows goes on in any case, and a word seen small begins a sentence where it has a capital.
    """
    pairs = each.where("kind = 'c'").withColumns({"a": F.split("word", " ")[0], "b": F.split("word", " ")[1], "n": F.col("upper") + F.col("caseless")}).where("n > 0")
    sums = [pairs.groupBy("language", *by).agg(F.sum("n").alias(name)).where(F.col(name) >= LEAST_COUNT) for by, name in ((["a"], "n_a"), (["b"], "n_b"), ([], "n_all"))]
    found = pairs.where(F.col("n") >= LEAST_COUNT).join(before.select("language", F.col("word").alias("a")), ["language", "a"], "left_semi")
    found = found.join(sums[0], ["language", "a"]).join(sums[1], ["language", "b"]).join(sums[2], "language")
    return found.where(ratio_column(F.col("n"), F.col("n_a"), F.col("n_b") - F.col("n"), F.col("n_all") - F.col("n_a")) > LEAST_RATIO)


def _starters(each: DataFrame) -> DataFrame:
    """The words that begin sentences oftener than they stand inside them."""
    words = each.where("kind = 's'")
    whole = words.groupBy("language").agg(F.greatest(F.sum("starts"), F.lit(1)).alias("s"), F.greatest(F.sum("middles"), F.lit(1)).alias("t"))
    return words.where((F.col("starts") >= LEAST_COUNT) & (F.col("word") != "")).join(whole, "language").where(ratio_column(F.col("starts"), F.col("s"), F.col("middles"), F.col("t")) > LEAST_RATIO)


def ratio_column(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """ratio() of columns."""
    zero = F.lit(0.0)
    p = (k1 + k2) / F.greatest(n1 + n2, F.lit(1))
    p1, p2 = k1 / F.greatest(n1, F.lit(1)), k2 / F.greatest(n2, F.lit(1))

    def part(k: Column, n: Column, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(zero) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(zero)

    value = 2 * (part(k1, n1, p1) + part(k2, n2, p2) - part(k1, n1, p) - part(k2, n2, p))
    return F.when((n1 <= 0) | (n2 <= 0) | (p <= 0) | (p >= 1), zero).when(p1 >= p2, value).otherwise(-value)


def ratio(k1: float, n1: float, k2: float, n2: float) -> float:
    """Signed log-likelihood ratio of two shares: positive where the first is the greater."""
    from math import log

    def part(k: float, n: float, p: float) -> float:
        return (k * log(p) if k else 0.0) + ((n - k) * log(1 - p) if n > k else 0.0)

    if not n1 or not n2:
        return 0.0
    p = (k1 + k2) / (n1 + n2)
    if p <= 0 or p >= 1:
        return 0.0
    p1, p2 = k1 / n1, k2 / n2
    value = 2 * (part(k1, n1, p1) + part(k2, n2, p2) - part(k1, n1, p) - part(k2, n2, p))
    return value if p1 >= p2 else -value


def script(word: str) -> str:
    """The script that a word's first letter belongs to, by its block."""
    c = next((c for c in word if c.isalpha()), "")
    return "latin" if c < "\u0250" else "greek" if c < "\u0400" else "cyrillic" if c < "\u0530" else "other"


def models(rows: list[dict]) -> dict[str, Model]:
    """The models from the counts and the pairs and starters found, also one for all words of a script ('~' and its name)."""
    by: dict[str, list[dict]] = {}
    pooled: dict[tuple[str, str], dict] = {}
    for r in rows:
        by.setdefault(r["language"], []).append(r)
        if r["kind"] == "p" and r["word"] not in ("#", "&"):
            code = "~" + script(r["word"])
            held = pooled.setdefault((code, r["word"]), {"language": code, "kind": "p", "word": r["word"], **dict.fromkeys(_COUNTED, 0)})
            for name in _COUNTED:
                held[name] += r[name]
    for (code, _), r in pooled.items():
        by.setdefault(code, []).append(r)
    out = {code: _model(own) for code, own in by.items()}
    shared = {code: m for code, m in out.items() if code.startswith("~")}
    for code, m in out.items():
        if code not in shared:
            m.others = shared
    return out


def _model(own: list[dict]) -> Model:
    m = Model()
    words = [r for r in own if r["kind"] == "p"]
    whole = next((r for r in own if r["kind"] == "total"), None) or {c: sum(r[c] for r in words) for c in _COUNTED}
    capital = lambda r: r["upper"] + r["caseless"]
    single = lambda w: w == "&" or (len(w) == 1 and w.isupper())
    odd: set[str] = {r["word"] for r in words if single(r["word"])}
    for _ in range(3):  # what is usual is learned from the words that aren't odd, and the other way round
        left = [r for r in words if r["word"] in odd]
        e0, u0 = max(whole["ends"] - sum(r["ends"] for r in left), 1), max(capital(whole) - sum(map(capital, left)), 1)
        i0 = max(whole["lower"] + whole["digits"] - sum(r["lower"] + r["digits"] for r in left), 0)
        usual = e0 / (e0 + u0)
        m.inside, m.ends = set(), {}
        for r in words:
            key, e, u, i = r["word"], r["ends"], capital(r), r["lower"] + r["digits"]
            share = min(1.0, ((e + 0.1) / usual) * (1 - usual) / (u + 1))
            if ratio(i, u + i, i0, u0 + i0) > LEAST_RATIO and i > 0.05 * (u + i):
                m.inside.add(key)
            if u and (ratio(e, e + u, e0, e0 + u0) < -LEAST_RATIO or key in m.inside or key == "#" or single(key)):
                m.ends[key] = share
        found = m.inside | {k for k, v in m.ends.items() if v < SURELY}
        if found | odd == odd:
            break
        odd |= found
    initials = [r for r in words if single(r["word"]) and m.ends.get(r["word"], 0) < SURELY]
    e, u = sum(r["ends"] for r in initials), sum(map(capital, initials))
    m.initials = min(1.0, (e / usual) * (1 - usual) / u) if u else 0.0
    for r in words:
        if single(r["word"]) and r["ends"] == 0 or r["ends"] + capital(r) < 15 and single(r["word"]):
            m.ends.pop(r["word"], None)  # too few to differ from other initials
    counts = {r["word"]: r["ends"] + capital(r) + r["lower"] + r["digits"] for r in words}
    m.known = {w for w, n in counts.items() if n >= 4 * LEAST_COUNT}
    for r in own:
        if r["kind"] == "c":
            a = r["word"].split(" ", 1)[0]
            if a in m.inside:
                m.pairs.add(r["word"])
    m.starters = {r["word"] for r in own if r["kind"] == "s"}
    m.profile = set(sorted((w for w in counts if len(w) > 1), key=lambda w: (-counts[w], w))[:PROFILE])
    return m


def guess(text: str, held: dict[str, Model]) -> str:
    """The language whose frequent last words and first words the whole text shares most."""
    words = Counter(w.lower() for w in _WORD.findall(text))
    score = {code: sum(n for w, n in words.items() if w in m.profile) for code, m in held.items() if code and code[0] != "~"}
    if not score:
        return ""
    code = max(sorted(score), key=score.__getitem__)
    return code if score[code] else ""


@cache
def _plain() -> Model:
    return Model()


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(key, sent_start, sent_end): one row per sentence."""
    kind = dict(df.dtypes)[key]
    sent = df.sparkSession.sparkContext.broadcast(learn(df, text, label))
    ddl = f"k {kind}, sent_start bigint, sent_end bigint"
    arrow = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            keys, starts, ends = [], [], []
            for k, t, l in zip(*(batch.column(i).to_pylist() for i in range(3))):
                code = language(l)
                if code not in held or not code:
                    code = guess(t, held)
                found = spans(t, held.get(code) or _plain())
                keys += [k] * len(found)
                starts += [a for a, _ in found]
                ends += [b for _, b in found]
            yield arrow_batch(arrow, [keys, starts, ends])

    docs = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("l")).where("k is not null and t is not null")
    return docs.mapInArrow(run, ddl).withColumnRenamed("k", key)
