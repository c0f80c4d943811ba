"""Nested JSON records to linked flat tables by vectorised structural indexing.

The bodies of one Arrow batch become one byte array. Bitmaps of quotes and brackets, the parity of the
quotes and prefix sums of the brackets give, for all records at once, which bytes are structure, how
deep they lie and in which container. Spans come out of these arrays; no record is parsed to objects.

Rules: a null, empty or incomplete body has no row; a bare object where a list belongs is a list of
one; a missing, null, empty or scalar value is an empty list; an element that isn't an object keeps its
position and has no children; of repeated keys the last counts; unknown fields are skipped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.runtime import arrow_batch, arrow_schema

_OPEN, _CLOSE = (123, 91), (125, 93)
_STRUCT = np.zeros(256, np.uint8)
for _k, _b in enumerate(b"{[}]:,", 1):
    _STRUCT[_b] = _k
_LB, _LS, _RB, _RS, _COLON, _COMMA, _START, _END = 1, 2, 3, 4, 5, 6, 7, 8
_SCALAR = re.compile(rb"(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\Z")
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n")] = True
_ESC = np.zeros(256, bool)
_ESC[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True


def _allowed() -> np.ndarray:
    """[previous structure, its container is a list, what stands between (0 nothing, 1 string, 2 scalar), next]."""
    ok = np.zeros((9, 2, 4, 9), bool)
    ok[_LB, 0, 0, _RB] = ok[_LB, 0, 1, _COLON] = True
    ok[_LS, 1, 0, [_LB, _LS, _RS]] = True
    ok[_COMMA, 0, 1, _COLON] = True
    ok[_COLON, 0, 0, [_LB, _LS]] = True
    ok[_COMMA, 1, 0, [_LB, _LS]] = True
    for gap in (1, 2):
        ok[_LS, 1, gap, [_COMMA, _RS]] = True
        ok[_COLON, 0, gap, [_COMMA, _RB]] = True
        ok[_COMMA, 1, gap, [_COMMA, _RS]] = True
        ok[_START, :, gap, _END] = True
    for end in (_RB, _RS):
        ok[end, 0, 0, [_COMMA, _RB]] = True
        ok[end, 1, 0, [_COMMA, _RS]] = True
        ok[end, :, 0, _END] = True
    ok[_START, :, 0, [_LB, _LS]] = True
    return ok


_ALLOWED = _allowed()


class Index:
    """Structural index of many JSON texts in one byte array."""

    def __init__(self, bodies: list[bytes]):
        n = len(bodies)
        raw = b"\n".join(bodies) + b"\n"
        self.raw, self.buf = raw, np.frombuffer(raw, np.uint8)
        buf = self.buf
        sizes = np.fromiter(map(len, bodies), np.int64, n)
        self.ends = np.cumsum(sizes + 1) - 1  # position of the newline that ends each record
        self.starts = self.ends - sizes
        at = np.arange(len(buf), dtype=np.int64)
        slash = buf == 92
        if slash.any():
            last_other = np.maximum.accumulate(np.where(slash, -1, at))
            before = np.empty_like(last_other)
            before[0], before[1:] = -1, last_other[:-1]
            escaped = ((at - 1 - before) & 1).astype(bool)
        else:
            escaped = np.zeros(len(buf), bool)
        quote = (buf == 34) & ~escaped
        seen = np.cumsum(quote)
        self._quote_at = np.flatnonzero(quote)
        rec = np.repeat(np.arange(n), sizes + 1)
        base = np.where(self.starts > 0, seen[np.maximum(self.starts - 1, 0)], 0)
        inside = ((seen - base[rec]) & 1).astype(bool)
        good = ((seen[self.ends] - base) & 1) == 0
        # strings: no raw control characters, only known escapes
        bad_at = inside & (buf < 32)
        if slash.any():
            bad_at |= escaped & inside & ~_ESC[buf]
            u = np.flatnonzero(escaped & inside & (buf == 117))
            if len(u):
                pad = np.concatenate([buf, np.zeros(4, np.uint8)])
                hexes = _HEX[pad[u[:, None] + np.arange(1, 5)]].all(axis=1)
                bad_at[u[~hexes]] = True
            bad_at |= slash & ~inside
        good[np.unique(rec[bad_at])] = False
        pos = np.flatnonzero((_STRUCT[buf] > 0) & ~inside & ~quote)
        kind = _STRUCT[buf[pos]]
        prec = rec[pos]
        step = np.where(kind <= _LS, 1, np.where(kind <= _RS, -1, 0))
        run = np.cumsum(step)
        first = np.searchsorted(pos, self.starts)
        last = np.searchsorted(pos, self.ends)
        zero = np.concatenate([[0], run])
        depth = run - zero[first][prec] + (step < 0)  # an opening and its closing bracket share a depth
        good &= zero[last] == zero[first]
        low = np.zeros(n, bool)
        low[np.unique(prec[(depth < 1) & (step != 0)])] = True
        good &= ~low
        # containers: within a record and depth, the latest opening bracket; brackets pair off in order
        order = np.lexsort((pos, depth, prec))
        o_open = kind[order] <= _LS
        own = np.maximum.accumulate(np.where(o_open, np.arange(len(order)), -1)) if len(order) else np.empty(0, np.int64)
        cont = np.full(len(pos), -1, np.int64)
        if len(order):
            same = np.maximum(own, 0)
            a, b = order[same], order
            fits = (own >= 0) & (prec[a] == prec[b]) & (depth[a] == depth[b])
            cont[order] = np.where(fits, a, -1)
        self.pos, self.kind, self.rec, self.depth, self.own = pos, kind, prec, depth, cont
        close = (kind == _RB) | (kind == _RS)
        mate = kind[np.maximum(cont, 0)]
        wrong = (close & ((cont < 0) | (mate != kind - 2))) | ((kind >= _COLON) & (cont < 0))
        wrong |= (kind == _COLON) & (mate != _LB)
        good[np.unique(prec[wrong])] = False
        self._closing = np.full(len(pos), -1, np.int64)
        self._closing[cont[close & (cont >= 0)]] = np.flatnonzero(close & (cont >= 0))
        # the container around a bracket: that of the latest opening bracket one level up
        self.up = np.full(len(pos), -1, np.int64)
        opens = np.flatnonzero(kind <= _LS)
        if len(opens):
            big = int(depth.max()) + 2 if len(depth) else 2
            code = prec * big + np.maximum(depth, 0)
            by = np.lexsort((opens, code[opens]))
            sorted_open, sorted_code = opens[by], code[opens][by]
            span = len(pos) + 1
            flat = sorted_code * span + sorted_open
            for group in (opens, np.flatnonzero(close)):
                want = (code[group] - 1) * span + group
                k = np.searchsorted(flat, want) - 1
                hit = np.maximum(k, 0)
                fits = (k >= 0) & (sorted_code[hit] == code[group] - 1) & (depth[group] > 1)
                self.up[group] = np.where(fits, sorted_open[hit], -1)
        good &= self._grammar(n, quote, seen, inside, first, last)
        self.good = good

    def _grammar(self, n, quote, seen, inside, first, last) -> np.ndarray:
        """Which records obey the order of JSON's parts."""
        buf, pos, kind = self.buf, self.pos, self.kind
        plain = ~_SPACE[buf] & ~inside & ~quote & (_STRUCT[buf] == 0)
        plains = np.cumsum(plain)
        m = len(pos)
        counts = last - first
        total = m + 2 * n
        seq_pos, seq_kind, seq_list, seq_rec = (np.empty(total, np.int64) for _ in range(4))
        rid = np.repeat(np.arange(n), counts + 2)
        begin = np.cumsum(counts + 2) - (counts + 2)
        mask = np.ones(total, bool)
        mask[begin] = mask[begin + counts + 1] = False
        seq_rec[:] = rid
        seq_pos[begin], seq_kind[begin], seq_list[begin] = self.starts - 1, _START, 0
        stop = begin + counts + 1
        seq_pos[stop], seq_kind[stop], seq_list[stop] = self.ends, _END, 0
        seq_pos[mask], seq_kind[mask] = pos, kind
        around = np.where(kind >= _COLON, self.own, np.where(kind <= _LS, np.arange(m), self.up))
        seq_list[mask] = np.where(around >= 0, kind[np.maximum(around, 0)] == _LS, 0) if m else 0
        a, b = slice(None, -1), slice(1, None)
        same = seq_rec[a] == seq_rec[b]
        lo, hi = seq_pos[a], seq_pos[b] - 1
        zs, zp = np.concatenate([[0], seen]), np.concatenate([[0], plains])
        self._quotes, self._plains = zs, zp
        strings = (zs[np.maximum(hi, -1) + 1] - zs[lo + 1]) // 2
        others = zp[hi + 1] - zp[lo + 1]
        gap = np.where(strings == 0, np.where(others == 0, 0, 2), np.where((strings == 1) & (others == 0), 1, 3))
        scalars = np.flatnonzero(same & (gap == 2))
        if len(scalars):
            texts = [self.raw[x + 1 : y + 1].strip(b" \t\r\n") for x, y in zip(lo[scalars].tolist(), hi[scalars].tolist())]
            known = {t: bool(_SCALAR.match(t)) for t in set(texts)}
            gap[scalars[[not known[t] for t in texts]]] = 3
        ok = _ALLOWED[seq_kind[a], seq_list[a], gap, seq_kind[b]] | ~same
        bad = np.zeros(n, bool)
        bad[np.unique(seq_rec[a][~ok])] = True
        return ~bad

    def _blank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether only white space lies between the structural bytes numbered ``a`` and ``b``."""
        lo, hi = self.pos[a] + 1, self.pos[b]
        return (self._quotes[lo] == self._quotes[hi]) & (self._plains[lo] == self._plains[hi])

    def fields(self, names: list[bytes]) -> list[dict[str, np.ndarray]]:
        """For each name: objects that have the field, and the colon before its value; of repeats the last."""
        colon = np.flatnonzero((self.kind == _COLON) & self.good[self.rec])
        # the key lies between the last two quotes before the colon
        end = self._quote_at[self._quotes[self.pos[colon]] - 1] if len(colon) else colon
        start = self._quote_at[self._quotes[self.pos[colon]] - 2] + 1 if len(colon) else colon
        size, owner = end - start, self.own[colon]
        slashes = np.concatenate([[0], np.cumsum(self.buf == 92)])
        odd = np.flatnonzero(slashes[end] > slashes[start]) if len(colon) else colon
        spelled = {int(n): json.loads(b'"' + self.raw[start[n] : end[n]] + b'"').encode("utf-8", "surrogatepass") for n in odd}
        out = []
        for name in names:
            fits = np.flatnonzero(size == len(name))
            if len(fits):
                same = (self.buf[start[fits, None] + np.arange(len(name))] == np.frombuffer(name, np.uint8)).all(axis=1)
                fits = fits[same]
            fits = np.union1d(fits, [n for n, word in spelled.items() if word == name]).astype(np.int64)
            if spelled:
                fits = fits[[spelled.get(int(n), name) == name for n in fits]]
            obj, at = owner[fits], colon[fits]
            order = np.lexsort((at, obj))
            obj, at = obj[order], at[order]
            final = np.ones(len(obj), bool)
            final[:-1] = obj[1:] != obj[:-1]
            out.append({"obj": obj[final], "colon": at[final]})
        return out

    def container_of(self, colon: np.ndarray) -> np.ndarray:
        """The bracket that opens the value behind each colon, or -1 for a scalar."""
        nxt = np.minimum(colon + 1, len(self.pos) - 1)
        return np.where((self.kind[nxt] <= _LS) & self._blank(colon, nxt), nxt, -1) if len(colon) else colon

    def scalar_at(self, colon: int) -> str | float | bool | None:
        """The scalar behind a colon; None for a container."""
        if self.kind[colon + 1] <= _LS:
            return None
        text = self.raw[self.pos[colon] + 1 : self.pos[colon + 1]].strip()
        return json.loads(text) if text else None

    def elements(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into lists, position, opening bracket or -1) of each element; -1 in lists has none."""
        kind, none = self.kind, np.empty(0, np.int64)
        which = np.full(len(kind) + 1, -1, np.int64)  # the last place stands for no container
        held = np.flatnonzero(lists >= 0)
        bare = held[kind[lists[held]] == _LB]
        real = held[kind[lists[held]] == _LS]
        which[lists[real]] = real
        of = np.where(kind == _COMMA, which[self.own], np.where(kind <= _LS, which[self.up], -1)) if len(kind) else none
        inner = np.flatnonzero(of >= 0)
        inner = inner[np.argsort(of[inner], kind="stable")]
        group, comma = of[inner], kind[inner] == _COMMA
        commas = np.bincount(group[comma], minlength=len(lists)) if len(lists) else none
        # an element's position is the number of its list's commas before it
        before = np.cumsum(comma) - comma
        first = np.searchsorted(group, group)
        place = before - before[first] if len(inner) else none
        full = np.zeros(len(lists), bool)
        full[real] = ~((self._closing[lists[real]] == lists[real] + 1) & self._blank(lists[real], np.maximum(self._closing[lists[real]], 0)))
        count = np.where(full, commas + 1, 0)
        count[bare] = 1
        offset = np.cumsum(count) - count
        index = np.repeat(np.arange(len(lists)), count)
        position = np.arange(len(index)) - offset[index]
        opening = np.full(len(index), -1, np.int64)
        opening[offset[bare]] = lists[bare]
        child = np.flatnonzero(~comma & (kind[inner] == _LB))
        opening[offset[group[child]] + place[child]] = inner[child]
        return index, position, opening


_NAMES = [b"tokens", b"analyses", b"grammar", b"variants", b"text", b"start", b"end", b"lemma", b"weight", b"raw", b"pos", b"common", b"grammemes"]
LEVELS = {
    "records": "rec_id bigint, n_tokens bigint",
    "tokens": "rec_id bigint, token_pos bigint, text string, start_offset bigint, end_offset bigint",
    "analyses": "rec_id bigint, token_pos bigint, analysis_pos bigint, lemma string, weight double, grammar_raw string, part_of_speech string, common array<string>",
    "variants": "rec_id bigint, token_pos bigint, analysis_pos bigint, variant_pos bigint, grammemes array<string>",
    "paths": "rec_id bigint, token_pos bigint, analysis_pos bigint, variant_pos bigint",
    "model": "rec_id bigint, tokens array<struct<text:string,analysis:array<struct<lex:string,gr:string,wt:double>>>>",
}


def _string(x) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x)


def _number(x, cast):
    try:
        return None if x is None or isinstance(x, bool) else cast(x)
    except (TypeError, ValueError):
        return None


def flatten_batch(ids: list[int], bodies: list[bytes], level: str) -> dict[str, list]:
    """Rows of one level (see LEVELS) of the records of a batch."""
    ix = Index(bodies)
    found = ix.fields(_NAMES[:4] if level in ("paths", "records") else _NAMES)
    at = [dict(zip(f["obj"].tolist(), f["colon"].tolist())) if n > 3 else {} for n, f in enumerate(found)]

    def lists(objects: np.ndarray, name: int) -> np.ndarray:
        """The container in a field of each object, or -1."""
        value = np.full(len(ix.kind) + 1, -1, np.int64)  # the last place stands for no object
        value[found[name]["obj"]] = ix.container_of(found[name]["colon"])
        return value[objects]

    def scalar(o: int, name: int):
        k = at[name].get(o)
        return ix.scalar_at(k) if k is not None else None

    def strings(o: int, name: int) -> list[str]:
        k = at[name].get(o)
        v = -1 if k is None else int(ix.container_of(np.array([k]))[0])
        if v < 0:
            return [] if k is None or ix.scalar_at(k) is None else [_string(ix.scalar_at(k))]
        text = ix.raw[ix.pos[v] : ix.pos[ix._closing[v]] + 1]
        found = json.loads(text)
        return [_string(x) for x in found] if isinstance(found, list) else []

    recs = np.flatnonzero(ix.good)
    root = np.full(len(bodies), -1, np.int64)
    top = np.flatnonzero((ix.kind == _LB) & (ix.depth == 1) & ix.good[ix.rec])
    root[ix.rec[top]] = top
    rid = np.array(ids, np.int64)
    tok_rec, tok_pos, tok = ix.elements(lists(root[recs], 0))
    if level == "records":
        return {"rec_id": rid[recs].tolist(), "n_tokens": np.bincount(tok_rec, minlength=len(recs)).tolist()}
    t_rec = rid[recs[tok_rec]]
    if level == "tokens":
        t = tok.tolist()
        return {
            "rec_id": t_rec.tolist(), "token_pos": tok_pos.tolist(), "text": [_string(scalar(o, 4)) for o in t],
            "start_offset": [_number(scalar(o, 5), int) for o in t], "end_offset": [_number(scalar(o, 6), int) for o in t],
        }
    an_tok, an_pos, an = ix.elements(lists(tok, 1))
    gram = lists(an, 2)
    gram = np.where((gram >= 0) & (ix.kind[np.maximum(gram, 0)] == _LB), gram, -1) if len(ix.kind) else gram
    if level == "analyses":
        a, g = an.tolist(), gram.tolist()
        return {
            "rec_id": t_rec[an_tok].tolist(), "token_pos": tok_pos[an_tok].tolist(), "analysis_pos": an_pos.tolist(),
            "lemma": [_string(scalar(o, 7)) for o in a], "weight": [_number(scalar(o, 8), float) for o in a],
            "grammar_raw": [_string(scalar(o, 9)) for o in g], "part_of_speech": [_string(scalar(o, 10)) for o in g],
            "common": [strings(o, 11) for o in g],
        }
    if level == "model":
        each: list[list[tuple]] = [[] for _ in tok]
        for n, o, g in zip(an_tok.tolist(), an.tolist(), gram.tolist()):
            each[n].append((_string(scalar(o, 7)), _string(scalar(g, 9)), _number(scalar(o, 8), float)))
        whole: dict[int, list[tuple]] = {}
        for r, o, found_in in zip(t_rec.tolist(), tok.tolist(), each):
            whole.setdefault(r, []).append((_string(scalar(o, 4)), [dict(zip(("lex", "gr", "wt"), x)) for x in found_in]))
        return {"rec_id": list(whole), "tokens": [[{"text": t, "analysis": x} for t, x in v] for v in whole.values()]}
    va_an, va_pos, va = ix.elements(lists(gram, 3))
    v_rec, v_tok, v_an = t_rec[an_tok[va_an]], tok_pos[an_tok[va_an]], an_pos[va_an]
    if level == "variants":
        return {"rec_id": v_rec.tolist(), "token_pos": v_tok.tolist(), "analysis_pos": v_an.tolist(), "variant_pos": va_pos.tolist(), "grammemes": [strings(o, 12) for o in va.tolist()]}
    bare_an = np.setdiff1d(np.arange(len(an)), va_an)
    bare_tok = np.setdiff1d(np.arange(len(tok)), an_tok)
    bare_rec = np.setdiff1d(np.arange(len(recs)), tok_rec)
    no = lambda k: np.full(k, -1, np.int64)
    return {
        "rec_id": np.concatenate([v_rec, t_rec[an_tok[bare_an]], t_rec[bare_tok], rid[recs[bare_rec]]]),
        "token_pos": np.concatenate([v_tok, tok_pos[an_tok[bare_an]], tok_pos[bare_tok], no(len(bare_rec))]),
        "analysis_pos": np.concatenate([v_an, an_pos[bare_an], no(len(bare_tok) + len(bare_rec))]),
        "variant_pos": np.concatenate([va_pos, no(len(bare_an) + len(bare_tok) + len(bare_rec))]),
    }


#: Bytes of JSON indexed at once; a larger single record is indexed alone.
BLOCK_BYTES = 4 << 20


def flatten(df: DataFrame, level: str = "paths", key: str = "rec_id", body: str = "body") -> DataFrame:
    """One flat table of the nested records; rows of different levels join on their positions.

    ``level``: records, tokens, analyses, variants, paths (one row per innermost element, -1 where a
    level has none), or model (one row per record that holds tokens, as an analyzer would answer). A redelivered record, with the same key, counts once. Other columns are ignored.
    A null key or body, and a body that isn't complete JSON, have no row; an empty input gives none.
    """
    schema = LEVELS[level]
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(ids: list, bodies: list) -> pa.RecordBatch:
            rows = flatten_batch(ids, bodies, level)
            return arrow_batch(arrow, [rows[f.name] for f in arrow])

        ids, bodies, size = [], [], 0
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = b.as_buffer().to_pybytes() if b.is_valid else b""
                if i is None or not text:
                    continue
                if size + len(text) > BLOCK_BYTES and ids:
                    yield emit(ids, bodies)
                    ids, bodies, size = [], [], 0
                ids.append(i), bodies.append(text)
                size += len(text)
        if ids:
            yield emit(ids, bodies)

    source = df.select(F.col(key).cast("bigint").alias("k"), F.col(body).cast("string").alias("b")).where("k is not null and b is not null and b <> ''")
    keys = [c for c in ("rec_id", "token_pos", "analysis_pos", "variant_pos") if c in schema]
    return source.mapInArrow(run, schema).dropDuplicates(keys)
