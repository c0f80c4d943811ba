"""Character classes of the tokenizer: separators, number parts and word parts.

Each class is a rule over Unicode categories with a few fixed exceptions; it is available as a set of
code points, and as the inside of a regular-expression class for Python and for the JVM and RE2.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

SOFT_HYPHEN = 0xAD
YUAN = 0x5143

# Marks and numbers added to Unicode too late to be word parts, by category; the last
# number is a threshold, code points above it are all too late.
LATE = {
    "Mc": ({3315, 5909, 7415}, 44012),
    "Mn": (
        {2045, 2558, 2901, 3076, 3132, 3328, 3457, 3770, 3790, 6068, 6069, 6159, 43052, 43263, *range(2200, 2260), *range(2810, 2816), *range(3387, 3389), *range(6847, 6863), *range(7670, 7675)},
        65071,
    ),
    "Nl": (set(), 42735),
    "No": (set(), 43061),
}
# Further word parts, Roman numerals among them that are never too late.
WORD_PARTS = {1371, 1372, 1374, 1758, 8544, 8553, 8554, 8557, 8559, 8560, 8569, 8570, 8573, SOFT_HYPHEN}
# Punctuation inside numbers.
NUMBER_MARKS = {
    43, 35, 46, 894, 903, 1417, 1567, 1748, 1793, 1794, 2404, 2405, 4962, 4967, 5742, 6100, 6101, 6145, 6147, 6153, 6468, 6469,
    8230, 8252, 8253, 8263, 8264, 8265, 65106, 65110, 65111,
}
# Blanks that don't separate.
HARD_BLANKS = {0xA0, 0x2007, 0x202F}
_NEVER = {"Cs", "Co", "Cn"}
_category = unicodedata.category
_SEPARATING = ("Cc", "Cf", "Ps", "Pe", "Pi", "Pf", "Zl", "Zp", "Zs")


@cache
def _sets() -> dict[str, frozenset[int]]:
    separators, numbers, words, currency = set(), set(), set(), set()
    for cp in range(sys.maxunicode + 1):
        c = _category(chr(cp))
        if c in _NEVER:
            continue
        late = LATE.get(c)
        part = cp in WORD_PARTS or c == "Me" or (late is not None and cp not in late[0] and cp <= late[1])
        if cp == 0x22 or (c in _SEPARATING and cp not in HARD_BLANKS):
            separators.add(cp)
        if c == "Nd" or part or cp in NUMBER_MARKS:
            numbers.add(cp)
        if c[0] == "L" or c == "Nd" or part:
            words.add(cp)
        if c == "Sc" or cp == YUAN:
            currency.add(cp)
    return {"S": frozenset(separators), "N": frozenset(numbers), "W": frozenset(words), "C": frozenset(currency)}


def members(name: str) -> frozenset[int]:
    """Code points of S (separators), N (number parts), W (word parts) or C (currency symbols)."""
    return _sets()[name]


def ranges(points: frozenset[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cp in sorted(points):
        if out and out[-1][1] == cp - 1:
            out[-1] = (out[-1][0], cp)
        else:
            out.append((cp, cp))
    return out


@cache
def python_class(name: str) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges(members(name)))


@cache
def hex_class(name: str) -> str:
    """For Java and RE2."""
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges(members(name)))


def gap_pattern(classify_currencies: bool, inside=python_class) -> str:
    """One alternation that cuts any text into gap tokens without remainder."""
    money = f"|[{inside('C')}]" if classify_currencies else ""
    return f"://|@{money}|[{inside('S')}]+|[{inside('N')}]+|[{inside('W')}]+|(?s:.)"


@cache
def java_class(name: str) -> str:
    """For the JVM only: whole categories first, which are quick to test, then what else belongs."""
    wide = {"W": ("L", "Nd"), "N": ("Nd",), "S": (), "C": ("Sc",)}[name]
    rest = {cp for cp in members(name) if not unicodedata.category(chr(cp)).startswith(wide)} if wide else members(name)
    named, listed = "".join(f"\\p{{{c}}}" for c in wide), ranges(frozenset(rest))
    inside = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in listed)
    # what lies below the first listed character, as blanks and most punctuation, is refused at once
    return f"{named}[[^\\x{{0}}-\\x{{{listed[0][0] - 1:X}}}]&&[{inside}]]" if wide and listed and listed[0][0] else named + inside
