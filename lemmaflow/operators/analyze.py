"""Documents to search tokens and positional postings: limits, chunks, analysis, alignment, tokens.

Every step up to the postings is narrow: one pass over the documents inside Arrow batches, no shuffle.
Analyses come from an ``engine``, or arrive as a column of ``answers`` that one has attached (see
lemmaflow.sources.engines); a document without an answer is tokenized from its text alone.

Rules: a null text has no tokens; an empty one has none and ends at 0. Rows that can't be analyzed, or
whose request failed, stop the query; with mode PERMISSIVE each result has a column ``error``, and such a
document one row with the error and nulls. Messages never hold text. Other columns named in ``keep`` are
carried along; the rest is dropped, so clashing names do no harm. ``deltas`` names a column of
ARRAY<STRUCT<at, add>>, in order of ``at``, that leads offsets of a filtered text back to the unfiltered one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.errors import AnswerError, InvalidOptions, LemmaflowError
from lemmaflow.functions.text import CONTROL_MESSAGE, LINE_MESSAGE, NONCHARACTER_MESSAGE
from lemmaflow.operators.parse import align, parse_tokens
from lemmaflow.operators.tokens import Tokenizer, from_utf16, to_utf16
from lemmaflow.options import AnalysisOptions, OversizedPolicy, PositionPolicy, TokenizerOptions
from lemmaflow.runtime import MOST_ROWS, arrow_batch, arrow_schema

STATS = "struct<elapsed_ms:double,mode:string,in_chars:int,in_bytes:int,out_chars:int,out_bytes:int>"
#: Tokens that are analyzed already; offsets in UTF-16 units, -1 where unknown.
MODEL = "array<struct<text:string,start:int,end:int,analyses:array<struct<lemma:string,weight:double>>>>"
#: Answers of an engine: for code points ``at`` to ``at + n`` the output, or analyzed tokens, or the error, and the request's figures if there are any.
ANSWERS = f"array<struct<at:int,n:int,json:string,error:string,stats:{STATS},tokens:{MODEL}>>"
DELTAS = "array<struct<at:int,add:int>>"
TOKENS = "array<struct<text:string,start:int,end:int,type:string,forms:array<struct<text:string,keyword:boolean>>>>"
ISSUES = "array<struct<type:string,message:string,offset:int,length:int>>"
#: Token types that the term stream leaves out.
SKIPPED = ("SEPARATOR", "OTHER")

_BREAK = regex.compile(r"[\t\n\x0b\f\r\x1c-\x1f\p{Z}]")
_UNSAFE = regex.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\r\n﷐-﷯" + "".join(f"\\U{p << 16 | 0xFFFE:08x}\\U{p << 16 | 0xFFFF:08x}" for p in range(17)) + "]")


def units(text: str) -> int:
    return len(text) if text.isascii() or max(text, default="") <= "￿" else len(text.encode("utf-16-le")) // 2


def prefix(text: str, limit: int) -> str:
    """The longest prefix of whole characters within ``limit`` UTF-16 units."""
    if units(text) <= limit:
        return text
    return text.encode("utf-16-le")[: 2 * limit].decode("utf-16-le", "ignore")


def reader_chunks(text: str, limit: int) -> list[tuple[int, int]]:
    """(start, end) in code points of the chunks an analyzer is given.

    A chunk has at most ``limit`` units and ends behind its last blank, or at the limit if it has none;
    a character of two units is never cut, so a limit of 1 may be passed by 1.
    """
    out, at = [], 0
    while at < len(text):
        window = prefix(text[at : at + limit], limit) or text[at]
        end = at + len(window)
        if end < len(text):
            blanks = [m.end() for m in _BREAK.finditer(window)]
            end = at + (blanks[-1] if blanks else len(window))
        out.append((at, end))
        at = end
    return out


def preparation_issues(text: str) -> tuple[str, list[tuple[str, str, int]]]:
    """(safe text for a JSON line, [(type, message, code-point offset)])."""
    issues = []

    def note(m) -> str:
        c = m.group()
        if c in "\r\n":
            issues.append(("CONTROL_CHARACTER", LINE_MESSAGE, m.start()))
        elif ord(c) < 0xA0:
            issues.append(("CONTROL_CHARACTER", CONTROL_MESSAGE, m.start()))
        else:
            issues.append(("NONCHARACTER", NONCHARACTER_MESSAGE, m.start()))
        return " "

    return _UNSAFE.sub(note, text), issues


class Analysis:
    """What analyze_text() gives, in UTF-16 units."""

    __slots__ = ("tokens", "issues", "final")

    def __init__(self, tokens, issues, final):
        self.tokens, self.issues, self.final = tokens, issues, final


def analyze_text(text: str, answers: list[dict] | None, tokenizer: Tokenizer, options: AnalysisOptions, look_up=None) -> Analysis:
    """Tokens of one document.

    ``answers``: analyzer output for pieces of it, by code-point start and length. ``look_up`` gives the
    analyzed tokens of a piece at once: (text, start, end, [(lemma, weight)]).
    """
    whole = units(text)
    used = text
    if whole > options.max_input_chars:
        if options.oversized == OversizedPolicy.FAIL:
            raise InvalidOptions(f"the input has more than {options.max_input_chars} characters")
        used = prefix(text, options.max_input_chars)
    failed = next((a["error"] for a in answers or () if a["error"]), None)
    if failed:
        raise AnswerError(failed)
    spans = [(a["at"], min(len(used), a["at"] + a["n"]), a["json"], a["tokens"]) for a in answers] if answers else [(a, b, None, None) for a, b in reader_chunks(used, options.max_chunk_chars)]
    at = to_utf16(used)
    tokens, issues = [], []
    for a, b, output, given in spans:
        piece = used[a:b]
        analyzed = look_up(piece) if look_up else None
        if given is not None:
            points = from_utf16(text)
            analyzed = [(x["text"] or "", points(x["start"]), points(x["end"]), [(y["lemma"], y["weight"]) for y in x["analyses"] or ()]) for x in given]
        if output is not None:
            safe, found = preparation_issues(piece)
            issues += [(kind, message, at(a + o), at(a + o + 1) - at(a + o)) for kind, message, o in found]
            aligned, missed = align(safe, parse_tokens(output))
            issues += [(kind, message, at(a + o), n) for kind, message, o, n in missed]
            analyzed = [(t, s, e, [(x["lemma"], x["weight"]) for x in analyses]) for t, s, e, analyses in aligned]
        tokens += [(t, at(a + s), at(a + e), kind, forms) for t, s, e, kind, forms in tokenizer.tokenize(piece, analyzed)]
    return Analysis(tokens, issues, whole)


def postings_of(tokens: list[tuple], positions: PositionPolicy) -> tuple[list[tuple], int]:
    """((term, start, end, type, keyword, increment, position) rows, increment left at the end)."""
    out, pending, position = [], 1, -1
    for _, start, end, kind, forms in tokens:
        if kind in SKIPPED:
            pending += positions == PositionPolicy.PRESERVE
            continue
        position += pending
        for n, (form, keyword) in enumerate(forms):
            out.append((form, start, end, kind.lower(), keyword, 0 if n else pending, position))
        pending = 1
    return out, pending - 1


def end_increment(tokens: list[tuple], positions: PositionPolicy) -> int:
    """The increment that postings_of() leaves at the end: the tokens that are left out behind the last posting, if they count."""
    if positions != PositionPolicy.PRESERVE:
        return 0
    return next((n for n, t in enumerate(reversed(tokens)) if t[3] not in SKIPPED), len(tokens))


def _describe(e: LemmaflowError) -> str:
    return str(e) if isinstance(e, AnswerError) else f"{type(e).__name__}: {e}"


def _moved(found: Analysis, deltas: list[dict] | None) -> Analysis:
    """``found`` with its offsets in the unfiltered text."""
    if not deltas:
        return found
    places = [d["at"] for d in deltas]

    def at(o: int) -> int:
        n = bisect_right(places, o)
        return o + deltas[n - 1]["add"] if n else o

    tokens = [(t, at(s), at(e), kind, forms) for t, s, e, kind, forms in found.tokens]
    issues = [(kind, message, at(o), at(o + n) - at(o)) for kind, message, o, n in found.issues]
    return Analysis(tokens, issues, at(found.final))


class _Source:
    """What all operators below share: documents, where analyses come from, and what becomes of failures."""

    def __init__(self, df: DataFrame, key: str, text: str, answers: str | None, tokenizer: TokenizerOptions, options: AnalysisOptions, keep: tuple[str, ...], mode: str, engine, deltas: str | None):
        self.look_up = None
        if engine is not None:
            from lemmaflow.sources.engines import check_policy

            check_policy(engine, options)
            self.look_up = engine.look_up() if hasattr(engine, "look_up") else None
            if self.look_up is None:
                df, answers = engine.attach(df, key, text, options), "answers"
        self.df, self.kept = df, (key, *keep)
        self.extra = [F.col(text).cast("string"), (F.col(answers) if answers else F.lit(None)).cast(ANSWERS), (F.col(deltas) if deltas else F.lit(None)).cast(DELTAS)]
        self.tokenizer, self.options, self.mode = tokenizer, options, mode

    def rows(self, ddl: str, made, nothing: tuple | None = None, weight=None) -> DataFrame:
        """``made(found)`` gives the rows of an analyzed document; ``nothing`` is the row of a null text, if it has any.

        Rows go on as soon as there are MOST_ROWS, whatever the size of the batch they come from; ``weight(row)``
        tells how many a row counts for that holds lists.
        """
        types, lenient = dict(self.df.dtypes), self.mode == "PERMISSIVE"
        head = ", ".join(f"`{c}` {types[c]}" for c in self.kept)
        whole = f"{head}, {ddl}" + (", error string" if lenient else "")
        arrow, width = arrow_schema(whole), len(arrow_schema(ddl))
        fixed, tokenizer_options, options, look_up = len(self.kept), self.tokenizer, self.options, self.look_up

        def of(t: str | None, asked, deltas, tokenizer: Tokenizer) -> list[tuple]:
            if t is None:
                return [(*nothing, None) if lenient else nothing] if nothing else []
            try:
                found = made(_moved(analyze_text(t, asked, tokenizer, options, look_up), deltas))
            except LemmaflowError as e:
                if not lenient:
                    raise
                return [(*(nothing or [None] * width), _describe(e))]
            return [(*r, None) for r in found] if lenient else found

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokenizer = Tokenizer(tokenizer_options)
            for batch in batches:

                def parts(index: list[int], out: list[tuple]) -> Iterator[pa.RecordBatch]:
                    for a in range(0, len(out), MOST_ROWS):
                        picked = pa.array(index[a : a + MOST_ROWS], pa.int64())
                        columns = [batch.column(i).take(picked) for i in range(fixed)]  # noqa: B023
                        yield arrow_batch(arrow, [*columns, *zip(*out[a : a + MOST_ROWS])])

                index: list[int] = []
                out: list[tuple] = []
                held = 0
                for n, x in enumerate(zip(*(batch.column(fixed + i).to_pylist() for i in range(3)))):
                    got = of(*x, tokenizer)
                    out += got
                    index += [n] * len(got)
                    held += sum(map(weight, got)) if weight else len(got)
                    if held >= MOST_ROWS:
                        yield from parts(index, out)
                        index, out, held = [], [], 0
                yield from parts(index, out)

        return self.df.select(*self.kept, *[c.alias(f"_x{n}") for n, c in enumerate(self.extra)]).mapInArrow(run, whole)


def analyze(df: DataFrame, key: str, text: str, answers: str | None = None, tokenizer: TokenizerOptions = TokenizerOptions(), options: AnalysisOptions = AnalysisOptions(), keep: tuple[str, ...] = (), mode: str = "FAILFAST", engine=None, deltas: str | None = None) -> DataFrame:
    """One row per document: tokens, issues, final_offset and end_increment; a null or failed text has none of them."""

    def rows(found: Analysis) -> list[tuple]:
        # tuples in the order of the structs' fields
        return [(found.tokens, found.issues, found.final, end_increment(found.tokens, options.positions))]

    def weight(row: tuple) -> int:
        return 1 + len(row[0]) + len(row[1])

    return _Source(df, key, text, answers, tokenizer, options, keep, mode, engine, deltas).rows(f"tokens {TOKENS}, issues {ISSUES}, final_offset int, end_increment int", rows, ([], [], 0, 0), weight)


def document_ends(df: DataFrame, key: str, text: str, answers: str | None = None, tokenizer: TokenizerOptions = TokenizerOptions(), options: AnalysisOptions = AnalysisOptions(), keep: tuple[str, ...] = (), mode: str = "FAILFAST", engine=None, deltas: str | None = None) -> DataFrame:
    """One row per document: final_offset, end_increment and n_tokens, as analyze() has them; the tokens stay where they are made."""

    def rows(found: Analysis) -> list[tuple]:
        return [(found.final, end_increment(found.tokens, options.positions), len(found.tokens))]

    return _Source(df, key, text, answers, tokenizer, options, keep, mode, engine, deltas).rows("final_offset int, end_increment int, n_tokens bigint", rows, (0, 0, 0))


def search_tokens(df: DataFrame, key: str, text: str, answers: str | None = None, tokenizer: TokenizerOptions = TokenizerOptions(), options: AnalysisOptions = AnalysisOptions(), keep: tuple[str, ...] = (), mode: str = "FAILFAST", engine=None, deltas: str | None = None) -> DataFrame:
    """One row per token: ord, token, start, end, type."""

    def rows(found: Analysis) -> list[tuple]:
        return [(n, t, s, e, k) for n, (t, s, e, k, _) in enumerate(found.tokens)]

    return _Source(df, key, text, answers, tokenizer, options, keep, mode, engine, deltas).rows("ord int, token string, start int, end int, type string", rows)


def term_stream(df: DataFrame, key: str, text: str, answers: str | None = None, tokenizer: TokenizerOptions = TokenizerOptions(), options: AnalysisOptions = AnalysisOptions(), keep: tuple[str, ...] = (), mode: str = "FAILFAST", engine=None, deltas: str | None = None) -> DataFrame:
    """One row per term: term, start, end, type, keyword, pos_inc, position."""

    def rows(found: Analysis) -> list[tuple]:
        return postings_of(found.tokens, options.positions)[0]

    return _Source(df, key, text, answers, tokenizer, options, keep, mode, engine, deltas).rows("term string, start int, end int, type string, keyword boolean, pos_inc int, position int", rows)


def document_terms(df: DataFrame, key: str, text: str, answers: str | None = None, tokenizer: TokenizerOptions = TokenizerOptions(), options: AnalysisOptions = AnalysisOptions(), keep: tuple[str, ...] = (), mode: str = "FAILFAST", engine=None, deltas: str | None = None) -> DataFrame:
    """One row per document and distinct term: term, n. Counted where the document is, without a shuffle."""

    def rows(found: Analysis) -> list[tuple]:
        return list(Counter(r[0] for r in postings_of(found.tokens, options.positions)[0]).items())

    return _Source(df, key, text, answers, tokenizer, options, keep, mode, engine, deltas).rows("term string, n bigint", rows)


def document_stats(df: DataFrame, key: str, text: str, answers: str | None = None, tokenizer: TokenizerOptions = TokenizerOptions(), options: AnalysisOptions = AnalysisOptions(), keep: tuple[str, ...] = (), mode: str = "FAILFAST", engine=None, deltas: str | None = None) -> DataFrame:
    """One row per document that has terms: n_terms, n_positions, n_distinct; without a shuffle."""

    def rows(found: Analysis) -> list[tuple]:
        posted = postings_of(found.tokens, options.positions)[0]
        return [(len(posted), posted[-1][6] + 1, len({r[0] for r in posted}))] if posted else []

    return _Source(df, key, text, answers, tokenizer, options, keep, mode, engine, deltas).rows("n_terms bigint, n_positions bigint, n_distinct bigint", rows)


def corrected(offset: Column, deltas: Column) -> Column:
    """An offset of filtered text in the unfiltered one; ``deltas``: ARRAY<STRUCT<at, add>> in order of at."""
    return offset + F.coalesce(F.element_at(F.transform(F.filter(deltas, lambda d: d["at"] <= offset), lambda d: d["add"]), -1), F.lit(0))
