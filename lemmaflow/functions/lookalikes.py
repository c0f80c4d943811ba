"""Character data shared by everything that compares texts by how they look."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

# Letters of two scripts that look the same, Latin first.
CYRILLIC = (
    "AА BВ CС EЕ HН IІ JЈ KК MМ OО PР SЅ TТ XХ YУ aа cс eе iі jј oо pр sѕ xх yу"
    " ËЁ ëё ÏЇ ïї hһ dԁ qԛ wԝ GԌ QԚ WԜ lӏ"
).split()
GREEK = "AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ XΧ YΥ oο vν pρ uυ iι aα".split()


@cache
def pairs() -> list[str]:
    """The pairs above, and those of letters that carry the same marks on letters that look the same."""
    plain = {pair[1]: pair[0] for pair in CYRILLIC + GREEK}
    out = CYRILLIC + GREEK
    for cp in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(cp))
        if marks and base in plain and chr(cp) not in plain:
            whole = unicodedata.normalize("NFC", plain[base] + "".join(marks))
            if len(whole) == 1:
                out = [*out, whole + chr(cp)]
    return out


@cache
def to_latin() -> dict[str, str]:
    """Cyrillic or Greek letter -> the Latin letter it looks like."""
    return {pair[1]: pair[0] for pair in pairs()}


@cache
def to_script(script: str) -> dict[str, str]:
    """Letter of any other script -> the letter of ``script`` (LATIN, CYRILLIC or GREEK) it looks like."""
    latin = to_latin()
    if script == "LATIN":
        return latin
    own = {pair[0]: pair[1] for pair in pairs() if (pair[1] >= "\u0400" and pair[1] < "\u0530") == (script == "CYRILLIC")}
    return own | {c: own[x] for c, x in latin.items() if x in own and own[x] != c}


@cache
def invisible() -> frozenset[int]:
    """Code points without a visible form: format characters, selectors, fillers, controls, noncharacters."""
    kept = {9, 10, 13}
    found = {cp for cp in range(sys.maxunicode + 1) if unicodedata.category(chr(cp)) in ("Cf", "Cc") and cp not in kept}
    found |= {0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
    found |= {*range(0xFDD0, 0xFDF0), *(plane << 16 | low for plane in range(17) for low in (0xFFFE, 0xFFFF))}
    return frozenset(found)


@cache
def widths() -> dict[int, str]:
    """Full- and half-width forms and Latin ligatures -> ordinary forms; every blank but tabs and line ends -> a space."""
    out = {cp: unicodedata.normalize("NFKC", chr(cp)) for cp in range(0xFB00, 0xFB07)}
    for cp in range(0x3000, 0x10000):
        kind = unicodedata.decomposition(chr(cp)).split()
        if kind and kind[0] in ("<wide>", "<narrow>"):
            out[cp] = "".join(chr(int(x, 16)) for x in kind[1:])
    for cp in range(sys.maxunicode + 1):
        if unicodedata.category(chr(cp)) == "Zs":
            out[cp] = " "
    return out


@cache
def plain_table() -> dict[int, str | None]:
    """For str.translate: widths unified, invisible characters dropped."""
    return widths() | dict.fromkeys(invisible())


@cache
def skeleton_table() -> dict[int, str | None]:
    """For str.translate of lower-case text: also look-alikes in either case folded to one letter.

    Letters whose capitals look alike fall together in lower case too, so the fold is the same before
    and after a change of case.
    """
    parent: dict[str, str] = {}

    def find(c: str) -> str:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    for pair in pairs():
        a, b = find(pair[0].lower()), find(pair[1].lower())
        if a != b:
            parent[max(a, b)] = min(a, b)
    return plain_table() | {ord(c): find(c) for c in list(parent)} | {ord("ς"): find("σ")}
