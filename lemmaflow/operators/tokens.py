"""Search tokens: analyzer tokens and the gaps between them, classified, merged and given their forms.

Works on one document at a time inside an Arrow batch; inside, offsets are code points, at the edge
UTF-16 units. What a gap token is depends on its text only, so it is worked out once for each text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import regex

from lemmaflow.errors import TokenizationError
from lemmaflow.functions.charclass import SOFT_HYPHEN, gap_pattern, members, python_class
from lemmaflow.options import LemmaPolicy, TokenizerOptions, UnmatchedPolicy

# Features of a token.
WORD, LEMMA, NUMBER, CURRENCY, AT, SCHEME, SEPARATOR, SHARP, PLUSES, PLUS, URL, EMAIL = (1 << n for n in range(12))

# Names of currencies, in the order they are emitted.
CURRENCY_FORMS = {
    "$": ["доллар", "dollar", "dólar", "美元", "usd"],
    "€": ["евро", "euro", "欧元", "eur"],
    "£": ["фунт", "pound", "pfund", "libra", "livre", "英镑", "gbp"],
    "₽": ["рубль", "ruble", "rubel", "rublo", "rouble", "卢布", "rub"],
    "₣": ["франк", "franc", "franken", "franco", "法郎", "chf"],
    "₩": ["вон", "won", "韩元", "krw"],
    "₹": ["рупия", "rupee", "rupie", "rupia", "roupie", "卢比", "inr"],
    "¥": ["иена", "юань", "yen", "yuan", "日元", "元", "jpy"],
    "元": ["юань", "yuan", "cny"],
}
# Stress marks that forms are freed of.
STRESS = re.compile("[\u0301\u0341]")

# The shape of e-mail addresses, and the marks inside them.
_EMAIL = regex.compile(r"[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?)+")
_EMAIL_MARKS = re.compile(r"[._%+\-]+")
# Addresses in a string of token classes: Separator, Url mark, At, word, mark of e-mails, other.
_ADDRESS = re.compile(
    r"(?<![^S])(?:(?=[^SA]*U[^SA]*(?:S|\Z))[^Sw]*(?P<url>w(?:[^S]*w)?)"
    r"|(?=[^SU]*A[^SU]*(?:S|\Z))[^S]*?(?<![wm])m*+(?P<mail>w[wm]*+A[wm]*w))"
)
_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_HOST = rf"(?:{_LABEL}\.)*[A-Za-z](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.?|\d{{1,3}}(?:\.\d{{1,3}}){{3}}|\[[0-9A-Fa-f:.]+\]"
_URI = regex.compile(
    rf"[A-Za-z][A-Za-z0-9+.\-]*://(?:(?:[A-Za-z0-9_\-!.~'()*;:&=+$,]|%[0-9A-Fa-f]{{2}})*@)?(?P<host>{_HOST})(?::\d*)?"
    r"(?:[/?](?:[A-Za-z0-9_\-!.~'()*;/?:@&=+$,]|%[0-9A-Fa-f]{2}|[^\x00-\x7f\p{Z}\p{Cc}])*)?(?:\#(?:[A-Za-z0-9_\-!.~'()*;/?:@&=+$,]|%[0-9A-Fa-f]{2}|[^\x00-\x7f\p{Z}\p{Cc}])*)?"
)


def _domain(address: str, kind: int) -> str:
    """The host of a URL or what follows the @ of an e-mail address; empty if it isn't one."""
    if kind == URL:
        m = _URI.fullmatch(address)
        return m["host"] if m else ""
    return address.rpartition("@")[2] if _EMAIL.fullmatch(address) else ""


#: Texts whose features and forms a task remembers.
REMEMBERED = 200_000


@lru_cache
def _classes() -> tuple[re.Pattern, ...]:
    return tuple(re.compile(f"[{python_class(n)}]+") for n in "SNW")


def features(text: str, options: TokenizerOptions) -> int:
    """Features of a token without lemmas."""
    if options.classify_currencies and len(text) == 1 and ord(text) in members("C"):
        return CURRENCY
    if options.merge_emails and text == "@":
        return AT
    if options.merge_urls and text == "://":
        return SCHEME
    separators, numbers, words = _classes()
    found = SEPARATOR if separators.search(text) else 0
    if numbers.fullmatch(text) and any(c.isdecimal() for c in text):
        ending = SHARP if text.endswith("#") else PLUSES if text.endswith("++") else PLUS if text.endswith("+") else 0
        return found | NUMBER | WORD | ending
    if words.fullmatch(text) and any(c.isalpha() or c.isdecimal() for c in text):
        return found | WORD
    return found


def type_of(flags: int, options: TokenizerOptions) -> str:
    order = ((URL, "URL"), (EMAIL, "EMAIL"), (CURRENCY, "CURRENCY"), (NUMBER if options.classify_numbers else 0, "NUMBER"), (WORD, "WORD"), (SEPARATOR, "SEPARATOR"))
    return next((name for bit, name in order if flags & bit), "OTHER")


def select_lemmas(analyses: list[tuple[str, float | None]], policy: LemmaPolicy) -> list[str]:
    """Non-empty lemmas: all distinct ones as first seen, or the first of those with the greatest weight."""
    if len(analyses) == 1:
        return [analyses[0][0]] if analyses[0][0] else []
    filled = [(lemma, weight) for lemma, weight in analyses if lemma]
    if policy == LemmaPolicy.ALL:
        return list(dict.fromkeys(lemma for lemma, _ in filled))
    weighted = [x for x in filled if x[1] is not None]
    best = max(weighted, key=lambda x: x[1], default=None) or (filled[0] if filled else None)
    return [best[0]] if best else []


def make_forms(text: str, flags: int, lemmas: list[str], extra: list[str], options: TokenizerOptions) -> list[tuple[str, bool]]:
    """(form, keyword) of a token; repeats are dropped before the letters are made small, as they come."""
    kind = type_of(flags, options)
    if kind in ("NUMBER", "WORD"):
        keyword = kind == "NUMBER" or bool(lemmas) or bool(flags & NUMBER)
        values: dict[str, None] = {}
        for value in lemmas or [text]:
            if STRESS.search(value):
                values[STRESS.sub("", value)] = None
                continue
            values[value] = None
            for bit, ending in ((PLUSES, "++"), (PLUS, "+"), (SHARP, "#")):
                if flags & bit and value.endswith(ending):
                    values[value[: -len(ending)]] = None
                    break
    else:
        keyword, values = True, dict.fromkeys([text, *extra])
        if kind == "CURRENCY" and options.expand_currency_forms:
            values |= dict.fromkeys(CURRENCY_FORMS.get(text, ()))
    return [(v.lower(), keyword) for v in values if v]


class Token:
    """A token in the making."""

    __slots__ = ("text", "start", "end", "flags", "lemmas", "extra")

    def __init__(self, text: str, start: int, end: int, flags: int, lemmas: list[str] | None = None, extra: list[str] | None = None):
        self.text, self.start, self.end, self.flags, self.lemmas, self.extra = text, start, end, flags, lemmas or [], extra or []


class Tokenizer:
    """Turns documents into search tokens under one set of options."""

    def __init__(self, options: TokenizerOptions):
        self.options = options
        self.gaps = re.compile(gap_pattern(options.classify_currencies))
        self._flags: dict[str, int] = {}
        self._known: dict[object, tuple[str, list[tuple[str, bool]]]] = {}

    def flags(self, text: str) -> int:
        """features() of a text, remembered."""
        found = self._flags.get(text)
        if found is None:
            if len(self._flags) > REMEMBERED:
                self._flags.clear()
            found = self._flags[text] = features(text, self.options)
        return found

    def gap(self, text: str, start: int, end: int) -> Iterator[Token]:
        for m in self.gaps.finditer(text, start, end):
            piece = m.group()
            yield Token(piece, m.start(), m.end(), self.flags(piece))

    def simple(self, piece: str) -> tuple[str, list[tuple[str, bool]]]:
        """(type, forms) of a gap token that isn't merged."""
        return self._known.get(piece) or self.whole(piece, piece, self.flags(piece), [], [])

    def whole(self, key: object, piece: str, flags: int, lemmas: list[str], extra: list[str]) -> tuple[str, list[tuple[str, bool]]]:
        """(type, forms) of a token, remembered by ``key``."""
        found = self._known.get(key)
        if found is None:
            if len(self._known) > REMEMBERED:
                self._known.clear()
            found = self._known[key] = type_of(flags, self.options), make_forms(piece, flags, lemmas, extra, self.options)
        return found

    def prepared(self, text: str, analyzed: list[tuple]) -> list[Token]:
        """Tokens that cover ``text`` from its start to its end; analyzed: (text, start, end, [(lemma, weight)])."""
        out: list[Token] = []
        cursor = 0
        for piece, start, end, analyses in analyzed:
            if start < 0:
                if self.options.unmatched == UnmatchedPolicy.FAIL:
                    raise TokenizationError("a token without offsets")
                continue
            if end > len(text):
                raise TokenizationError("a token ends behind its text")
            if not piece:
                continue
            lemmas = select_lemmas(analyses, self.options.lemmas)
            if start < cursor:  # it claims what another token has: its next occurrence, or what is left of it
                later = text.find(piece, cursor)
                if later >= 0:
                    start, end = later, later + len(piece)
                elif end > cursor:
                    start = cursor
                else:
                    continue
            out.extend(self.gap(text, cursor, start))
            token = Token(piece, start, end, WORD | LEMMA if lemmas else self.flags(piece), lemmas)
            self._take_ending(text, token)
            out.append(token)
            cursor = max(start, token.end)
        out.extend(self.gap(text, cursor, len(text)))
        return out

    _ENDS = ("#", "+", chr(SOFT_HYPHEN))
    _ENDING = re.compile(chr(SOFT_HYPHEN) + r"*(?:(?P<sharp>\#)|(?P<pluses>\+\+)|(?P<plus>\+))?")

    def _take_ending(self, text: str, token: Token) -> None:
        """Soft hyphens behind a word, and one # or + or ++ the analyzer has dropped."""
        if token.flags & WORD and text[token.end : token.end + 1] in self._ENDS:
            m = self._ENDING.match(text, token.end)
            token.end = m.end()
            token.flags |= {"sharp": SHARP, "pluses": PLUSES, "plus": PLUS}.get(m.lastgroup or "", 0)

    def merged(self, text: str, tokens: list[Token]) -> list[Token]:
        """``tokens`` with addresses made one token each.

        Each token is written as a letter of its class, so that an address is a match in a string of
        classes: it lies between separators, holds one kind of address mark only, and reaches from word
        to word.
        """
        classes = "".join(map(self._class_of, tokens))
        out: list[Token] = []
        done = 0
        for m in _ADDRESS.finditer(classes):
            kind = URL if m["url"] else EMAIL
            a, b = m.span("url" if m["url"] else "mail")
            start, end = tokens[a].start, tokens[b - 1].end
            domain = _domain(text[start:end], kind)
            if domain:
                out += tokens[done:a]
                out.append(Token(text[start:end], start, end, kind, extra=[domain]))
                done = b
        return out + tokens[done:]

    @staticmethod
    def _class_of(t: Token) -> str:
        for flags, letter in ((SEPARATOR, "S"), (SCHEME, "U"), (AT, "A"), (WORD | NUMBER, "w")):
            if t.flags & flags:
                return letter
        return "m" if _EMAIL_MARKS.fullmatch(t.text) else "x"

    def tokenize(self, text: str, analyzed: list[tuple] | None = None) -> list[tuple]:
        """(text, start, end, type, [(form, keyword)]) in code points; together the tokens are the text."""
        merging = (self.options.merge_urls and "://" in text) or (self.options.merge_emails and "@" in text)
        if not analyzed and not merging:
            out, at = [], 0
            for piece in self.gaps.findall(text):
                kind, forms = self.simple(piece)
                out.append((piece, at, at := at + len(piece), kind, forms))
            return out
        out = []
        found = self.prepared(text, analyzed or [])
        for t in self.merged(text, found) if merging else found:
            source = text[t.start : t.end]
            kind, forms = self.whole((source, t.flags, *t.lemmas, *t.extra), source, t.flags, t.lemmas, t.extra)
            if not forms:
                raise TokenizationError("a token without forms")
            out.append((source, t.start, t.end, kind, forms))
        return out


def to_utf16(text: str):
    """A function from code-point to UTF-16 offsets of ``text``."""
    if text.isascii() or max(text, default="") <= "￿":
        return lambda n: n
    import numpy as np

    wide = np.frombuffer(text.encode("utf-32-le"), np.uint32) > 0xFFFF
    at = np.concatenate([[0], np.cumsum(1 + wide)]).tolist()
    return at.__getitem__


def from_utf16(text: str):
    """A function from UTF-16 to code-point offsets of ``text``; what is unknown or lies behind the text stays so."""
    if text.isascii() or max(text, default="") <= "￿":
        return lambda n: n
    from bisect import bisect_left

    at = to_utf16(text)
    places = [at(n) for n in range(len(text) + 1)]
    return lambda n: n if n < 0 or n > places[-1] else bisect_left(places, n)
