"""Native column functions: safe text, UTF-16 offsets and grammar strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unsafe controls (all but tab, LF and CR) and noncharacters, as a Java class.
UNSAFE_CONTROLS = "\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{7F}-\\x{9F}"
NONCHARACTERS = "\\x{FDD0}-\\x{FDEF}" + "".join(f"\\x{{{p << 16 | 0xFFFE:X}}}\\x{{{p << 16 | 0xFFFF:X}}}" for p in range(17))
LINE_BREAKS = "\\r\\n"
# The messages of issues.
CONTROL_MESSAGE = "Control character replaced with space"
LINE_MESSAGE = "Line separator replaced with space for JSON-line protocol"
NONCHARACTER_MESSAGE = "Unicode noncharacter replaced with space"
UNMATCHED_MESSAGE = "Could not align token to original text: "


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf16_offset(text: Column, code_points: Column) -> Column:
    """The UTF-16 offset of a code-point offset; -1 stays -1."""
    return F.when(code_points < 0, F.lit(-1)).otherwise(utf16_length(F.substr(text, F.lit(1), code_points.cast("int"))))


def _unsafe(json_line: bool) -> str:
    return f"[{UNSAFE_CONTROLS}{NONCHARACTERS}{LINE_BREAKS if json_line else ''}]"


def prepare(text: Column, json_line: bool = False) -> Column:
    """``text`` with every unsafe control and noncharacter (and, for a JSON line, line break) as a space.

    Each character is replaced by one, so code-point offsets in the result are those of the original.
    """
    return F.regexp_replace(text, _unsafe(json_line), " ")


def preparation_issues(text: Column, json_line: bool = False) -> Column:
    """ARRAY<STRUCT<type, message, offset, length>> of what prepare() replaces; null for null; offsets in UTF-16 units."""
    found = F.regexp_extract_all(text, F.lit(_unsafe(json_line)), F.lit(0))
    between = F.transform(F.split(text, _unsafe(json_line), -1), utf16_length)
    lengths = F.transform(found, utf16_length)
    # offsets are running sums of what lies before; both arrays are only as long as there are issues
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.array_append(acc["out"], acc["at"] + x["gap"]).alias("out"))
    pairs = F.arrays_zip(F.slice(between, 1, F.greatest(F.size(found), F.lit(1))).alias("gap"), lengths.alias("n"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    offsets = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    kind = lambda c: F.when(c.rlike(f"[{UNSAFE_CONTROLS}{LINE_BREAKS}]"), "CONTROL_CHARACTER").otherwise("NONCHARACTER")
    message = lambda c: F.when(c.rlike("[\\r\\n]"), LINE_MESSAGE).when(c.rlike(f"[{UNSAFE_CONTROLS}]"), CONTROL_MESSAGE).otherwise(NONCHARACTER_MESSAGE)
    each = F.transform(
        F.arrays_zip(found.alias("c"), offsets.alias("o"), lengths.alias("n")),
        lambda x: F.struct(kind(x["c"]).alias("type"), message(x["c"]).alias("message"), x["o"].alias("offset"), x["n"].alias("length")),
    )
    none = F.array().cast("array<struct<type:string,message:string,offset:int,length:int>>")
    return F.when(F.size(found) > 0, each).when(text.isNotNull(), none)


def prepare_utf16(data: bytes) -> tuple[str, list[tuple[str, str, int, int]]]:
    """Safe text of raw UTF-16-BE bytes: lone surrogates, which no Spark string can hold, become U+FFFD."""
    text = data.decode("utf-16-be", "surrogatepass")
    out, issues, at = [], [], 0
    for c in text:
        if "\ud800" <= c <= "\udfff":
            half = "high" if c < "\udc00" else "low"
            issues.append(("UNPAIRED_SURROGATE", f"Unpaired {half} surrogate", at, 1))
            c = "�"
        out.append(c)
        at += 2 if c > "￿" else 1
    return "".join(out), issues


def prepared_utf16(df: DataFrame, key: str, data: str) -> DataFrame:
    """(key, text, issues) of raw UTF-16-BE bytes, which may hold lone surrogates; null bytes give null."""
    from lemmaflow.runtime import map_rows

    ddl = f"k {dict(df.dtypes)[key]}, text string, issues array<struct<type:string,message:string,offset:int,length:int>>"
    rows = map_rows(df.select(F.col(key).alias("k"), F.col(data).alias("d")), ddl, lambda x: [(x["k"], *((None, None) if x["d"] is None else prepare_utf16(bytes(x["d"]))))])
    return rows.withColumnRenamed("k", key)


def _grammemes(part: Column) -> Column:
    trim = lambda x: F.regexp_replace(x, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")
    return F.filter(F.transform(F.split(part, ","), trim), lambda x: x != "")


def parse_grammar(raw: Column) -> Column:
    """STRUCT<raw, pos, common, variants> of a grammar string; null counts as empty.

    Sets come sorted and without repeats. A right side without a value gives one empty variant; one of
    nothing but bars gives none.
    """
    text = F.coalesce(raw, F.lit(""))
    sides = F.split(text, "=", 2)
    left = _grammemes(sides[0])
    right = F.when(F.size(sides) > 1, sides[1]).otherwise(F.lit(""))
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, "^[(\\x00-\\x20]+", ""), "[)\\x00-\\x20]+$", "")
    pieces = F.split(F.regexp_replace(right, "\\|+$", ""), "\\|")
    tidy = lambda x: F.array_sort(F.array_distinct(x))
    none = F.array().cast("array<array<string>>")
    variants = (
        F.when(F.trim(F.regexp_replace(right, "\\s", "")) == "", F.array(F.array().cast("array<string>")))
        .when(F.regexp_replace(right, "\\|", "") == "", none)
        .otherwise(F.transform(pieces, lambda p: tidy(_grammemes(bare(p)))))
    )
    return F.struct(text.alias("raw"), F.get(left, F.lit(0)).alias("pos"), tidy(F.slice(left, 2, 1 << 30)).alias("common"), variants.alias("variants"))


def all_grammemes(grammar: Column) -> Column:
    """The common grammemes and those of every variant, sorted and without repeats."""
    return F.array_sort(F.array_distinct(F.concat(grammar["common"], F.flatten(grammar["variants"]))))


def normalize_term(text: Column) -> Column:
    """A pattern or term as the index has it: small letters, without analysis."""
    return F.lower(text)
