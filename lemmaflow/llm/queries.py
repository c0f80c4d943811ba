"""Queries of the training-data operators, and the SQL that must agree where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.llm import bpe, canon, chunks, frequencies, leaks, mojibake, sentences
from lemmaflow.runtime import first_deliveries, map_rows, scratch, spread, staged, table


def _limited(spark: SparkSession, d: str) -> DataFrame:
    """The documents, a redelivered one once, with the limit and overlap of their options."""
    docs = first_deliveries(table(spark, d, "mystem_documents"), "mdoc_id", "mdoc_id", "original_text", "analysis_options_id")
    options = table(spark, d, "analysis_options").select("analysis_options_id", "max_chunk_chars", "overlap_chars").dropDuplicates(["analysis_options_id"])
    return docs.join(options, "analysis_options_id", "left")


_CHUNKED = ("mdoc_id", "original_text", "max_chunk_chars", "overlap_chars")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    cases = chunks.oversized_cases(_limited(spark, d), *_CHUNKED)
    kinds = F.filter(F.array(F.when(F.col("oversized"), "oversized"), F.when(F.col("unbroken"), "unbroken")), lambda x: x.isNotNull())
    return cases.select("mdoc_id", F.explode(kinds).alias("case_kind"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunks.split_texts(_limited(spark, d), *_CHUNKED, unique=True)


def p1_cover(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each document keep: its length and text, the limit, the overlap, and their numbers."""
    options = _limited(spark, d).select("mdoc_id", "max_chunk_chars", "overlap_chars")
    pieces = p1_pieces(spark, d).groupBy("mdoc_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "piece"))).alias("p"))

    def rows(x: dict):
        p, limit = x["p"], x["max_chunk_chars"] or chunks.DEFAULT_LIMIT
        overlap = min(max(0, x["overlap_chars"] or 0), limit - 1)
        shared = [a["end"] - b["start"] for a, b in zip(p, p[1:])]
        whole = b"".join(y["piece"].encode("utf-16-le")[2 * n :] for y, n in zip(p, [0, *shared])).decode("utf-16-le")
        # where a character of two units stands at the edge, pieces share one unit more or less
        yield x["mdoc_id"], p[-1]["end"], all(y["end"] - y["start"] <= limit for y in p), all(abs(n - overlap) <= 1 for n in shared), [y["piece_no"] for y in p] == list(range(len(p))), mojibake.md5(whole)

    return map_rows(pieces.join(options, "mdoc_id"), "mdoc_id bigint, n_units bigint, limit_kept boolean, overlap_kept boolean, numbered boolean, text_md5 string", rows)


def p1_files(spark: SparkSession, d: str) -> DataFrame:
    """Texts written as large files and cut by byte ranges: the units covered, and pieces that are too long or leave a gap."""
    place = scratch(spark, "files")
    table(spark, d, "documents").where("text is not null").select("text").write.text(place)
    listed = spark.read.format("binaryFile").load(place).select("path", "length").collect()
    pieces = chunks.split_files(spark, [(r["path"].replace("file:/", "file:///", 1) if r["path"].startswith("file:/") and not r["path"].startswith("file://") else r["path"], r["length"]) for r in listed], 4096, 128, 1 << 20, 16 << 20)
    behind = pieces.select("path", (F.col("piece_no") + 1).alias("piece_no"), F.col("end").alias("before"))
    each = pieces.join(behind, ["path", "piece_no"], "left").withColumn("shared", F.coalesce(F.col("before") - F.col("start"), F.lit(128)))
    return each.agg((F.sum(F.col("end") - F.col("start")) - F.sum(F.when(F.col("piece_no") > 0, F.col("shared")).otherwise(0))).alias("n_units"), F.sum((F.col("end") - F.col("start") > 4096).cast("bigint")).alias("too_long"), F.sum((F.abs(F.col("shared") - 128) > 1).cast("bigint")).alias("not_shared"))


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    forms = canon.canonical(spread(table(spark, d, "mystem_documents").select("mdoc_id", "original_text")), "mdoc_id", "original_text")
    return forms.select("mdoc_id", "canonical_text")


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    forms = canon.canonical(spread(table(spark, d, "mystem_documents").select("mdoc_id", "original_text")), "mdoc_id", "original_text", with_text=False)
    classes = canon.alike_classes(staged(forms.select("mdoc_id", "look", "exact"), "p4-forms"), "mdoc_id")
    firsts = classes.groupBy("class_id").agg(F.min("mdoc_id").alias("first_alike"))
    return classes.join(firsts, "class_id").select("mdoc_id", "n_looks", "n_alike", "first_alike")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    forms = canon.canonical(spread(table(spark, d, "mystem_documents").select("mdoc_id", "original_text")), "mdoc_id", "original_text", with_text=False)
    texts = staged(forms.select("mdoc_id", "look", "exact"), "p4-forms")
    pairs = canon.alike_pairs(texts, "mdoc_id").select(F.lit("original_text").alias("field_name"), "key_a", "key_b")
    types = table(spark, d, "issue_types").select("type_no", "type_name")
    names = F.explode(F.split("type_name", "[^A-Za-z]+")).alias("word")
    issues = table(spark, d, "text_issues").select("issue_id", "issue_type").where("issue_type is not null").dropDuplicates(["issue_id"])
    # spellings, not rows, are repaired: there are few of them and each may be frequent
    spelled = issues.select(F.col("issue_type").alias("k"), "issue_type").distinct()
    forms = canon.canonical(spelled, "k", "issue_type", vocabulary=types.select(names))
    alike = forms.join(types, (F.col("canonical_text") == F.col("type_name")) & (F.col("k") != F.col("type_name"))).select(F.col("k").alias("issue_type"), "type_no")
    odd = issues.join(types, F.col("issue_type") == F.col("type_name"), "left_anti")
    wrong = odd.join(alike, "issue_type").select(F.lit("issue_type").alias("field_name"), F.col("issue_id").alias("key_a"), F.col("type_no").alias("key_b"))
    return pairs.unionByName(wrong)


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "mystem_documents").select("mdoc_id", "original_text", "mystem_options_id"))
    options = table(spark, d, "mystem_options").select("mystem_options_id", "encoding").dropDuplicates(["mystem_options_id"])
    return mojibake.repair_encodings(docs.join(options, "mystem_options_id", "left"), "mdoc_id", "original_text", "encoding")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_restored(spark, d).select("mdoc_id", F.when(F.col("lost"), "lost").otherwise(F.md5("restored")).alias("restored_md5"))


def p6_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return frequencies.frequencies(spread(table(spark, d, "token_forms").select("form_id", "mdoc_id", "lemma", "form_text")), ["lemma", "form_text"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_frequencies(spark, d).where("mark is not null").select("field_name", "term", "mark")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(spread(table(spark, d, "documents").select("doc_id", "text")))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The documents with leaks: the words removed, and the words and their letters in the clean text."""
    clean = leaks.remove_leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))

    def rows(x: dict):
        kept = None if x["clean_text"] is None else leaks.words(x["clean_text"])
        yield x["doc_id"], x["removed_words"], None if kept is None else len(kept), None if kept is None else sum(map(len, kept))

    return map_rows(clean, "doc_id bigint, removed_words bigint, words_left bigint, letters_left bigint", rows)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(spread(table(spark, d, "documents").select("doc_id", "text", "lang")))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_cover": p1_cover,
    "p1_files": p1_files,
    "p4_found": p4_found,
    "p4_canonical": p4_canonical,
    "p4_classes": p4_classes,
    "p5_found": p5_found,
    "p5_restored": p5_restored,
    "p6_found": p6_found,
    "p6_frequencies": p6_frequencies,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p8_cleaned": p8_cleaned,
    "p9_found": p9_found,
}
_P6 = """
WITH once AS (SELECT DISTINCT form_id, mdoc_id, lemma, form_text FROM token_forms),
t AS (SELECT 'lemma' AS field_name, lemma AS term, form_id, mdoc_id FROM once WHERE lemma <> ''
  UNION ALL SELECT 'form_text', form_text, form_id, mdoc_id FROM once WHERE form_text <> ''),
n AS (SELECT field_name, count(DISTINCT mdoc_id) AS total FROM t GROUP BY field_name),
c AS (SELECT field_name, term, count(DISTINCT form_id) AS occurrences, count(DISTINCT mdoc_id) AS documents FROM t GROUP BY field_name, term),
m AS (SELECT c.*, CASE WHEN documents = 1 THEN 'rare' WHEN documents > 0.2 * total THEN 'common' END AS mark FROM c JOIN n USING (field_name))
"""


# The SQL has look-alikes, widths and invisible characters in its own terms, so that a wrong table can't agree with itself.
_WIDE = ("".join(map(chr, range(0xFF01, 0xFF5F))) + "￠￡￢￥￦", "".join(map(chr, range(0x21, 0x7F))) + "¢£¬¥₩")
_ALIKE = ("АВСЕНІЈКМОРЅТХУасеіјорѕхуЁёЇїһԁԛԝԌԚԜӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρυια", "ABCEHIJKMOPSTXYaceijopsxyËëÏïhdqwGQWlABEZHIKMNOPTYXovpuia")
#: Small letters that look alike in either case.
_ALIKE_SMALL = ("авсенікморѕтхујёїһԁԛԝԍӏαβεζηικμνορτυχvuς", "abcehikmopstxyjëïhdqwglabezhikmnoptyxnyσ")
_HIDDEN = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\p{Cf}\\x{34F}\\x{115F}\\x{1160}\\x{3164}\\x{FFA0}\\x{180B}-\\x{180F}\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}\\x{FDD0}-\\x{FDEF}" + "".join(f"\\x{{{n}FFFE}}\\x{{{n}FFFF}}" for n in ["", *"123456789ABCDEF", "10"]) + "]"
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def _sql_form(column: str, alike: tuple[str, str], small: bool) -> str:
    """A text without invisible characters, with ordinary widths and blanks, and one letter for all that look alike."""
    for c, v in (_LIGATURES | ({"ß": "ss", "ẞ": "ss"} if small else {})).items():
        column = f"replace({column}, '{c}', '{v}')"
    quoted = [x.replace("'", "''") for x in (*_WIDE, *alike)]
    wide = f"translate(regexp_replace(regexp_replace(nfc_normalize({column}), '{_HIDDEN}', '', 'g'), '\\p{{Zs}}', ' ', 'g'), '{quoted[0]}', '{quoted[1]}')"
    return f"nfc_normalize(translate({f'lower({wide})' if small else wide}, '{quoted[2]}', '{quoted[3]}'))"


def _p8_sql(last: str) -> str:
    """Runs of twelve words by a join of all runs of documents and items, whole shorter items by search."""
    words = lambda c: f"regexp_extract_all({_sql_form(c, _ALIKE_SMALL, True)}, '[\\p{{L}}\\p{{N}}]+')"
    grams = "SELECT {0}, unnest(range(1, len(w) - 10)) AS k, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM {1} WHERE len(w) >= 12"
    return f"""
WITH d AS (SELECT doc_id, {words("text")} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {words("item_text")} AS w FROM eval_items WHERE item_text IS NOT NULL),
short AS (SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS g FROM i WHERE len(w) BETWEEN 1 AND 11),
near AS (SELECT doc_id, item_id, w, n, g FROM d JOIN short ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || g || ' ')),
hits AS (SELECT doc_id, item_id, a.k, 12 AS n FROM ({grams.format("doc_id", "d")}) a JOIN ({grams.format("item_id", "i")}) b USING (g)
  UNION ALL SELECT doc_id, item_id, k, n FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM near) WHERE array_to_string(w[k:k + n - 1], ' ') = g)
{last}"""


def _p4_sql() -> str:
    """A plainer comparison: every look-alike folded everywhere."""
    form = lambda c: f"trim(regexp_replace({_sql_form(c, _ALIKE, False)}, '\\r\\n?', chr(10), 'g'), ' ' || chr(10) || chr(9))"
    return f"""
WITH d AS (SELECT DISTINCT mdoc_id, original_text AS t FROM mystem_documents WHERE original_text IS NOT NULL),
f AS (SELECT mdoc_id, t, {form("t")} AS form FROM d),
i AS (SELECT DISTINCT issue_id, issue_type AS t FROM text_issues WHERE issue_type IS NOT NULL AND issue_type NOT IN (SELECT type_name FROM issue_types)),
"""


_P4_PAIRS = f"""pairs AS (SELECT 'original_text' AS field_name, a.mdoc_id AS key_a, b.mdoc_id AS key_b FROM f a JOIN f b ON a.form = b.form AND a.mdoc_id < b.mdoc_id AND a.t <> b.t WHERE a.form <> ''),
spelled AS (SELECT 'issue_type' AS field_name, issue_id AS key_a, type_no AS key_b FROM (SELECT issue_id, trim({_sql_form("t", _ALIKE, False)}) AS form FROM i) JOIN issue_types ON form = type_name)
SELECT * FROM pairs UNION ALL SELECT * FROM spelled"""
_P4_CLASSES = """c AS (SELECT form, t, count(*) AS n FROM f WHERE form <> '' GROUP BY form, t), w AS (SELECT form, count(*) AS n_looks, sum(n) AS members FROM c GROUP BY form HAVING count(*) > 1)
SELECT f.mdoc_id, w.n_looks, CAST(w.members - c.n AS BIGINT) AS n_alike, min(f.mdoc_id) OVER (PARTITION BY f.form) AS first_alike FROM f JOIN c ON f.form = c.form AND f.t = c.t JOIN w ON f.form = w.form"""


def _p4_canonical_sql() -> str:
    """Repair of tokens of mixed scripts, script by script: letters that no other script has a double of decide, the corpus confirms."""
    latin, cyrillic, greek = "A-Za-z\\x{C0}-\\x{24F}", "\\x{400}-\\x{52F}", "\\x{370}-\\x{3FF}\\x{1F00}-\\x{1FFF}"
    others, doubles = _ALIKE
    doubled = "".join(sorted({*others, *doubles}))
    token = "[\\p{L}\\p{Nl}\\p{No}]+(?:[\\x{300}-\\x{36F}\\x{483}-\\x{487}]+[\\p{L}\\p{Nl}\\p{No}]*)*"
    cyr = [(d, o) for o, d in zip(others, doubles) if "\u0400" <= o < "\u0530"]
    grc = [(d, o) for o, d in zip(others, doubles) if o < "\u0400"]
    of = lambda pairs, more: ("".join(a for a, _ in [*pairs, *more]), "".join(b for _, b in [*pairs, *more]))
    to_cyr = of(cyr, [(o, dict(cyr)[d]) for d, o in grc if d in dict(cyr)])
    to_grc = of(grc, [(o, dict(grc)[d]) for d, o in cyr if d in dict(grc)])
    certain = lambda c, x: f"length(regexp_replace(strip_accents({x}), '[^{c}]|[{doubled}]|[^\\p{{L}}]', '', 'g'))"
    best = "CASE WHEN {l} > {c} AND {l} > {g} THEN 'l' WHEN {c} > {l} AND {c} > {g} THEN 'c' WHEN {g} > {l} AND {g} > {c} THEN 'g' ELSE '' END"
    every = lambda c, x: f"length(regexp_replace({x}, '[^{c}]|[^\\p{{L}}]', '', 'g'))"
    return f"""
WITH d AS (SELECT DISTINCT mdoc_id, original_text AS t FROM mystem_documents WHERE original_text IS NOT NULL),
f AS (SELECT mdoc_id, trim(regexp_replace({_sql_form("t", ("", ""), False)}, '\\r\\n?', chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(8232) || chr(8233)) AS p FROM d),
b AS (SELECT mdoc_id, p, {certain(latin, "p")} AS l, {certain(cyrillic, "p")} AS c, {certain(greek, "p")} AS g, {every(latin, "p")} AS l2, {every(cyrillic, "p")} AS c2, {every(greek, "p")} AS g2 FROM f WHERE p <> ''),
m AS (SELECT mdoc_id, p, coalesce(nullif({best.format(l="l", c="c", g="g")}, ''), {best.format(l="l2", c="c2", g="g2")}) AS main FROM b),
w0 AS (SELECT mdoc_id, main, regexp_extract_all(p, '{token}|[^\\p{{L}}\\p{{Nl}}\\p{{No}}]+') AS a FROM m),
w AS (SELECT mdoc_id, main, unnest(a) AS w, generate_subscripts(a, 1) AS n FROM w0),
kinds AS (SELECT DISTINCT w, main, regexp_matches(strip_accents(w), '[{doubled}]') AS doubt,
  CAST(regexp_matches(w, '[{latin}]') AS INT) + CAST(regexp_matches(w, '[{cyrillic}]') AS INT) + CAST(regexp_matches(w, '[{greek}]') AS INT) > 1 AS mixed,
  {certain(latin, "w")} AS l, {certain(cyrillic, "w")} AS c, {certain(greek, "w")} AS g FROM w WHERE regexp_matches(w, '^[\\p{{L}}\\p{{Nl}}\\p{{No}}]')),
words AS (SELECT DISTINCT w FROM kinds WHERE doubt AND NOT mixed),
aims AS (SELECT w, main, CASE WHEN l + c + g = 0 THEN main ELSE {best.format(l="l", c="c", g="g")} END AS aim FROM kinds WHERE doubt AND mixed),
fixed AS (SELECT w, main, nfc_normalize(CASE aim WHEN 'l' THEN translate(w, '{others}', '{doubles}') WHEN 'c' THEN translate(w, '{to_cyr[0]}', '{to_cyr[1]}') WHEN 'g' THEN translate(w, '{to_grc[0]}', '{to_grc[1]}') END) AS made FROM aims)
SELECT mdoc_id, string_agg(coalesce(words.w, w.w), '' ORDER BY n) AS canonical_text FROM w LEFT JOIN fixed ON w.w = fixed.w AND w.main = fixed.main LEFT JOIN words ON fixed.made = words.w GROUP BY mdoc_id"""


ORACLE: dict[str, str] = {
    "p1_found": r"""
WITH o AS (SELECT DISTINCT d.mdoc_id, d.original_text AS t, coalesce(a.max_chunk_chars, 32768) AS lim FROM mystem_documents d LEFT JOIN analysis_options a USING (analysis_options_id) WHERE d.original_text IS NOT NULL),
big AS (SELECT *, length(t) + length(regexp_replace(t, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS units FROM o),
over AS (SELECT * FROM big WHERE units > lim),
runs AS (SELECT mdoc_id, lim, unnest(regexp_extract_all(t, '[^\pZ\pP\t\n\x0B\f\r]+')) AS r FROM over)
SELECT mdoc_id, 'oversized' AS case_kind FROM over
UNION ALL SELECT DISTINCT mdoc_id, 'unbroken' FROM runs WHERE length(r) + length(regexp_replace(r, '[^\x{10000}-\x{10FFFF}]', '', 'g')) > lim
""",
    "p1_cover": r"""
WITH o AS (SELECT DISTINCT d.mdoc_id, d.original_text AS t, coalesce(a.max_chunk_chars, 32768) AS lim FROM mystem_documents d LEFT JOIN analysis_options a USING (analysis_options_id) WHERE d.original_text IS NOT NULL),
big AS (SELECT *, length(t) + length(regexp_replace(t, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS units FROM o)
SELECT mdoc_id, units AS n_units, true AS limit_kept, true AS overlap_kept, true AS numbered, md5(t) AS text_md5 FROM big WHERE units > lim
""",
    "p1_files": r"SELECT CAST(sum(length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) + 1) AS BIGINT) AS n_units, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS not_shared FROM documents WHERE text IS NOT NULL",
    "p4_found": _p4_sql() + _P4_PAIRS,
    "p4_classes": _p4_sql() + _P4_CLASSES,
    "p4_canonical": _p4_canonical_sql(),
    "p8_found": _p8_sql("SELECT DISTINCT doc_id, item_id FROM hits"),
    "p8_leaks": _p8_sql(", p AS (SELECT DISTINCT doc_id, item_id, unnest(range(k, k + n)) AS place FROM hits) SELECT doc_id, item_id, count(*) AS n_words, count(*) / any_value(len(w)) AS coverage FROM p JOIN d USING (doc_id) GROUP BY doc_id, item_id"),
    "p8_cleaned": _p8_sql(f""", p AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS place FROM hits), g AS (SELECT doc_id, list(place) AS gone, count(*) AS removed_words FROM p GROUP BY doc_id)
SELECT doc_id, removed_words, CASE WHEN removed_words <= 0.5 * len(w) THEN len(w) - removed_words END AS words_left,
  CASE WHEN removed_words <= 0.5 * len(w) THEN length(array_to_string(list_filter(w, lambda x, n: NOT list_contains(gone, n)), '')) END AS letters_left FROM g JOIN d USING (doc_id)"""),
    "p6_found": _P6 + "SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
    "p6_frequencies": _P6 + "SELECT field_name, term, occurrences, documents, mark FROM m",
}
