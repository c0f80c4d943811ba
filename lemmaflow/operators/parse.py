"""Analyzer output: JSON arrays of tokens, aligned to the text they were made from."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.errors import ParseError
from lemmaflow.functions.text import UNMATCHED_MESSAGE
from lemmaflow.runtime import map_rows

_SOFT_HYPHEN = "­"
_BLANK = re.compile(r"[ \t\r\n]*")


def _no_constant(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_no_constant)


def _where(text: str, at: int) -> str:
    line = text.count("\n", 0, at) + 1
    return f" at line {line}, column {at - (text.rfind(chr(10), 0, at) + 1) + 1}."


def _text(x) -> str:
    """A string, or nothing; halves of surrogate pairs that no text can hold become U+FFFD."""
    return x.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if isinstance(x, str) else ""


def parse_tokens(output: str) -> list[tuple[str, list[dict]]]:
    """(text, analyses) of every item of one or more arrays; an analysis has lemma, gr and weight."""
    items, at = [], _BLANK.match(output).end()
    if at == len(output):
        raise ParseError("The root must be an array" + _where(output, at))
    while at < len(output):
        if output[at] != "[":
            raise ParseError("The root must be an array" + _where(output, at))
        try:
            found, end = _DECODER.raw_decode(output, at)
        except (ValueError, RecursionError) as error:
            raise ParseError("Failed to parse the analyzer's output" + _where(output, getattr(error, "pos", at))) from None
        for item in found:
            if not isinstance(item, dict):
                raise ParseError("An item must be an object" + _where(output, at))
            analyses = item.get("analysis")
            analyses = analyses if isinstance(analyses, list) else []
            if any(not isinstance(a, dict) for a in analyses):
                raise ParseError("An analysis must be an object" + _where(output, at))
            items.append((_text(item.get("text")), [_analysis(a) for a in analyses]))
        at = _BLANK.match(output, end).end()
    return items


def _analysis(a: dict) -> dict:
    weight = a.get("wt")
    number = isinstance(weight, (int, float)) and not isinstance(weight, bool)
    return {"lemma": _text(a.get("lex")), "gr": _text(a.get("gr")), "weight": float(weight) if number else None}


class Aligner:
    """Finds tokens in a text from left to right."""

    def __init__(self, text: str):
        self.text, self.cursor = text, 0
        self._bare: str | None = None
        self._at: list[int] = []

    def find(self, token: str) -> tuple[int, int] | None:
        """(start, end) of the token's next occurrence: exact, or else with soft hyphens of the text ignored.

        A match moves the cursor behind it, a failure leaves it.
        """
        start = self.text.find(token, self.cursor)
        if start >= 0:
            self.cursor = start + len(token)
            return start, self.cursor
        if _SOFT_HYPHEN not in self.text or _SOFT_HYPHEN in token:
            return None
        if self._bare is None:
            self._at = [n for n, c in enumerate(self.text) if c != _SOFT_HYPHEN]
            self._bare = self.text.replace(_SOFT_HYPHEN, "")
        from bisect import bisect_left

        low = bisect_left(self._at, self.cursor)
        found = self._bare.find(token, low)
        if found < 0:
            return None
        # leading soft hyphens belong to the match; those behind the last letter don't
        first = self._at[found - 1] + 1 if found > low else self.cursor
        self.cursor = self._at[found + len(token) - 1] + 1
        return first, self.cursor


def align(text: str, tokens: list[tuple[str, list[dict]]]) -> tuple[list[tuple[str, int, int, list[dict]]], list[tuple[str, str, int, int]]]:
    """Tokens with code-point offsets (-1 where unmatched), and the issues (code-point offset, UTF-16 length)."""
    aligner, out, issues = Aligner(text), [], []
    for token, analyses in tokens:
        span = aligner.find(token)
        if span is None:
            issues.append(("UNMATCHED_TOKEN", UNMATCHED_MESSAGE + token, aligner.cursor, len(token.encode("utf-16-le")) // 2))
            span = (-1, -1)
        out.append((token, *span, analyses))
    return out, issues


DOCUMENT = "tokens array<struct<text:string,start:int,end:int,analyses:array<struct<lemma:string,gr:string,weight:double>>>>, issues array<struct<type:string,message:string,offset:int,length:int>>, error string"


def model_documents(df: DataFrame, key: str, text: str, output: str) -> DataFrame:
    """(key, tokens, issues, error) of texts and their analyzer output: every token at its place, or at -1 with an issue.

    Offsets are UTF-16 units of the text as it stands. Output that isn't what it should be gives an error
    and no tokens; a null text or output gives nulls.
    """
    from lemmaflow.operators.analyze import preparation_issues
    from lemmaflow.operators.tokens import to_utf16

    def rows(x: dict):
        t, out = x["t"], x["o"]
        if t is None or out is None:
            return [(x["k"], None, None, None)]
        at = to_utf16(t)
        safe, found = preparation_issues(t)
        issues = [(kind, message, at(o), at(o + 1) - at(o)) for kind, message, o in found]
        try:
            aligned, missed = align(safe, parse_tokens(out))
        except ParseError as e:
            return [(x["k"], None, None, f"ParseError: {e}")]
        issues += [(kind, message, at(o), n) for kind, message, o, n in missed]
        place = lambda o: at(o) if o >= 0 else -1
        return [(x["k"], [(w, place(s), place(e), [(a["lemma"], a["gr"], a["weight"]) for a in analyses]) for w, s, e, analyses in aligned], issues, None)]

    docs = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(output).cast("string").alias("o"))
    return map_rows(docs, f"k {dict(df.dtypes)[key]}, {DOCUMENT}", rows).withColumnRenamed("k", key)
