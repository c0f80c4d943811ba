"""Queries of the text-analysis operators, each with the SQL that must agree where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.functions import text as T
from lemmaflow.functions.sql import register
from lemmaflow.operators import analyze, lemmas, nested, search
from lemmaflow.operators.analyze import document_stats, document_terms, reader_chunks, search_tokens, term_stream
from lemmaflow.operators.parse import align
from lemmaflow.operators.tokens import to_utf16
from lemmaflow.options import AnalysisOptions, PositionPolicy, TokenizerOptions
from lemmaflow.runtime import first_deliveries, map_rows, scratch, spread, table
from lemmaflow.sources.engines import DictionaryEngine, NoEngine, PrecomputedEngine
from lemmaflow.streaming.postings import read_term_stats, stream_postings, stream_term_stats, term_counts, write_batches, write_stream

SEARCH, ENTITIES = TokenizerOptions.search(), TokenizerOptions.entity_aware()
PRESERVE = AnalysisOptions(positions=PositionPolicy.PRESERVE)
PHRASE, APART = ["до", "н", "э"], ["к", "и"]
SHOULD, MUST, MUST_NOT = ["очень", "weistim", "the"], ["и"], ["всегда"]
# Queries as a user would type them; they take the way of the documents.
ASKED = [(1, "До н. э."), (2, "Fig. 9 AND the"), (3, "стр. 805, рис.")]


def _docs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", *more))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """The analyzer's documents, a redelivered one once."""
    return first_deliveries(table(spark, d, "mystem_documents"), "mdoc_id", "mdoc_id", "original_text")


def _postings(spark: SparkSession, d: str, tokenizer: TokenizerOptions = SEARCH, options: AnalysisOptions = AnalysisOptions()) -> DataFrame:
    return term_stream(_docs(spark, d), "doc_id", "text", tokenizer=tokenizer, options=options)


def _gap_tokens(options: TokenizerOptions):
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = search_tokens(_docs(spark, d), "doc_id", "text", tokenizer=options)
        return found.select("doc_id", F.col("ord").cast("bigint").alias("ord"), "token", F.col("start").cast("bigint").alias("start_offset"), F.col("end").cast("bigint").alias("end_offset"), "type")

    return query


def token_type_counts(spark: SparkSession, d: str) -> DataFrame:
    found = search_tokens(_docs(spark, d, "lang"), "doc_id", "text", tokenizer=SEARCH, keep=("lang",))
    return found.groupBy("lang", "type").agg(F.count("*").alias("n"))


def _positions(options: AnalysisOptions):
    def query(spark: SparkSession, d: str) -> DataFrame:
        p = _postings(spark, d, options=options)
        return p.select("doc_id", "term", F.col("start").cast("bigint").alias("start_offset"), F.col("position").cast("bigint").alias("position"), F.col("pos_inc").cast("bigint").alias("pos_inc"), "type", "keyword")

    return query


def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.term_stats(document_terms(_docs(spark, d), "doc_id", "text", tokenizer=SEARCH))


def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return document_stats(_docs(spark, d), "doc_id", "text", tokenizer=SEARCH)


def document_ends(spark: SparkSession, d: str) -> DataFrame:
    found = analyze.document_ends(_docs(spark, d), "doc_id", "text", tokenizer=SEARCH, options=PRESERVE)
    return found.select("doc_id", F.col("final_offset").cast("bigint").alias("final_offset"), F.col("end_increment").cast("bigint").alias("end_increment"), "n_tokens")


def analyzed_query(spark: SparkSession, d: str) -> DataFrame:
    asked = term_stream(spark.createDataFrame(ASKED, "query_id bigint, text string"), "query_id", "text", tokenizer=SEARCH)
    return search.analyzed_query(_postings(spark, d), asked)


def prepared_text(json_line: bool):
    def query(spark: SparkSession, d: str) -> DataFrame:
        t = F.col("original_text")
        return _texts(spark, d).select("mdoc_id", T.prepare(t, json_line).alias("prepared"), F.size(T.preparation_issues(t, json_line)).cast("bigint").alias("n_issues")).where("prepared is not null")

    return query


def preparation_issues(spark: SparkSession, d: str) -> DataFrame:
    issues = T.preparation_issues(F.col("original_text"), True)
    each = _texts(spark, d).where("original_text is not null").select("mdoc_id", F.explode(issues).alias("i"))
    return each.select("mdoc_id", "i.type", "i.message", F.col("i.offset").cast("bigint").alias("issue_offset"), F.col("i.length").cast("bigint").alias("issue_length"))


def _grammar(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "grammar_strings").select("gr_id", "raw").dropDuplicates(["gr_id"])
    return rows.select("gr_id", T.parse_grammar(F.col("raw")).alias("g"))


def grammar_parse(spark: SparkSession, d: str) -> DataFrame:
    variants = F.transform("g.variants", lambda v: F.concat_ws(",", v))
    return _grammar(spark, d).select("gr_id", F.col("g.pos").alias("pos"), F.concat_ws(",", "g.common").alias("common"), F.size("g.variants").cast("bigint").alias("n_variants"), F.concat_ws("|", variants).alias("variants"))


def all_grammemes(spark: SparkSession, d: str) -> DataFrame:
    return _grammar(spark, d).select("gr_id", F.concat_ws(",", T.all_grammemes(F.col("g"))).alias("grammemes"))


def _analyses(spark: SparkSession, d: str) -> DataFrame:
    flat = nested.flatten(spread(table(spark, d, "model_records").select("rec_id", "body")), "analyses")
    listed = flat.groupBy("rec_id", "token_pos").agg(F.array_sort(F.collect_list(F.struct("analysis_pos", "lemma", "weight"))).alias("analyses"))
    return listed


def lemma_all(spark: SparkSession, d: str) -> DataFrame:
    return _analyses(spark, d).select("rec_id", "token_pos", F.concat_ws(",", lemmas.all_lemmas(F.col("analyses"))).alias("lemmas"))


def lemma_best_weight(spark: SparkSession, d: str) -> DataFrame:
    return _analyses(spark, d).select("rec_id", "token_pos", lemmas.best_lemma(F.col("analyses")).alias("lemma"))


def _entity(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        docs = _docs(spark, d).where(F.col("text").contains("://") | F.col("text").contains("@"))
        p = term_stream(docs, "doc_id", "text", tokenizer=ENTITIES).where(F.col("type") == kind)
        return p.groupBy("doc_id", "start", "end").agg(F.max(F.when(F.col("pos_inc") > 0, F.col("term"))).alias("address"), F.max(F.when(F.col("pos_inc") == 0, F.col("term"))).alias("domain")).select("doc_id", F.col("start").cast("bigint").alias("start_offset"), "address", "domain")

    return query


def currency_forms(spark: SparkSession, d: str) -> DataFrame:
    p = _postings(spark, d, TokenizerOptions(classify_currencies=True, expand_currency_forms=True))
    return p.where(F.col("type") == "currency").select("doc_id", F.col("start").cast("bigint").alias("start_offset"), F.col("term").alias("form"))


def number_forms(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d).where(F.col("type") == "number").select("doc_id", F.col("start").cast("bigint").alias("start_offset"), F.col("term").alias("form"), "keyword")


def _dictionary(spark: SparkSession, d: str) -> DictionaryEngine:
    return DictionaryEngine(table(spark, d, "token_forms").select("token_text", "lemma"), "token_text", "lemma")


def dictionary_terms(spark: SparkSession, d: str) -> DataFrame:
    p = term_stream(_texts(spark, d), "mdoc_id", "original_text", tokenizer=SEARCH, engine=_dictionary(spark, d))
    return p.where("keyword and type = 'word'").groupBy("mdoc_id", "term").agg(F.count("*").alias("n"))


def lemma_phrase(spark: SparkSession, d: str) -> DataFrame:
    p = term_stream(_texts(spark, d), "mdoc_id", "original_text", tokenizer=SEARCH, engine=_dictionary(spark, d))
    return search.phrase_query(p, ["очень", "врыгола"], [0, 2], key="mdoc_id")


def align_records(spark: SparkSession, d: str) -> DataFrame:
    """The recorded tokens found again in their documents, beside the offsets that were recorded."""
    flat = nested.flatten(spread(table(spark, d, "model_records").select("rec_id", "body")), "tokens")
    listed = flat.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("token_pos", "text", "start_offset"))).alias("tokens"))
    ids = table(spark, d, "model_records").select("rec_id", "mdoc_id").dropDuplicates(["rec_id"])

    def rows(x):
        t = x["original_text"]
        at = to_utf16(t)
        found, _ = align(t, [(y["text"] or "", []) for y in x["tokens"]])
        for y, (_, s, e, _) in zip(x["tokens"], found):
            yield x["rec_id"], y["token_pos"], at(s) if s >= 0 else -1, at(e) if e >= 0 else -1, y["start_offset"]

    joined = listed.join(ids, "rec_id").join(_texts(spark, d).where("original_text is not null"), "mdoc_id")
    return map_rows(joined.select("rec_id", "original_text", "tokens"), "rec_id bigint, token_pos bigint, start_offset bigint, end_offset bigint, recorded_start bigint", rows)


def precomputed_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of documents whose analyses were recorded: the record's tokens as the analyzer's answer.

    Of several records of a document the newest usable one counts: the greatest rec_id whose body holds tokens.
    """
    records = table(spark, d, "model_records")
    items = nested.flatten(spread(records.select("rec_id", "body")), "model").select("rec_id", F.to_json("tokens").alias("json"))
    last = items.join(records.select("rec_id", "mdoc_id").distinct(), "rec_id").groupBy("mdoc_id").agg(F.max_by("json", "rec_id").alias("json"))
    docs = _texts(spark, d).join(last, "mdoc_id")
    p = term_stream(docs, "mdoc_id", "original_text", tokenizer=ENTITIES, engine=PrecomputedEngine("json"))
    return p.select("mdoc_id", "term", F.col("start").cast("bigint").alias("start_offset"), F.col("end").cast("bigint").alias("end_offset"), "type", "keyword", F.col("position").cast("bigint").alias("position"))


def chunk_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Where an analyzer's chunks of 200 units lie."""

    def rows(x):
        at = to_utf16(x["original_text"])
        return [(x["mdoc_id"], n, at(a), at(b)) for n, (a, b) in enumerate(reader_chunks(x["original_text"], 200))]

    return map_rows(_texts(spark, d).where("original_text is not null"), "mdoc_id bigint, chunk_no bigint, start_offset bigint, end_offset bigint", rows)


def normalized_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "token_forms").select(T.normalize_term(F.col("token_text")).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("n"))


def echo_tokens(spark: SparkSession, d: str) -> DataFrame:
    return term_stream(_docs(spark, d), "doc_id", "text", engine=NoEngine()).groupBy("type").agg(F.count("*").alias("n"))


def stream_term_counts(spark: SparkSession, d: str) -> DataFrame:
    """Term counts of the documents read as a stream; the stream's files lie in the shared folder."""
    schema = table(spark, d, "documents").select("doc_id", "text").schema
    source = spark.readStream.schema(schema).parquet(f"{d}/documents.parque[t]")
    place = scratch(spark, "stream")
    stream_term_stats(source, "doc_id", "text", f"{place}/out", f"{place}/state", tokenizer=SEARCH, partitions=spark.sparkContext.defaultParallelism).awaitTermination()
    return read_term_stats(spark, f"{place}/out").select("term", F.col("tf").alias("n"))


def stream_postings_sink(spark: SparkSession, d: str) -> DataFrame:
    """Postings of the documents read as a stream, appended to Parquet exactly once, and counted there by type."""
    schema = table(spark, d, "documents").select("doc_id", "text").schema
    source = spark.readStream.schema(schema).parquet(f"{d}/documents.parque[t]")
    place = scratch(spark, "stream")
    write_stream(stream_postings(source, "doc_id", "text", tokenizer=SEARCH, partitions=spark.sparkContext.defaultParallelism), f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out").groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("position").cast("bigint")).alias("positions"))


def stream_hourly_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the documents by the hour they were written, counted in the stream."""
    schema = table(spark, d, "documents").select("doc_id", "text", "written_at").schema
    source = spark.readStream.schema(schema).parquet(f"{d}/documents.parque[t]").where("written_at is not null").withColumn("written_at", F.col("written_at").cast("timestamp"))
    place = scratch(spark, "stream")
    postings = stream_postings(source.withWatermark("written_at", "3650 days"), "doc_id", "text", tokenizer=SEARCH, keep=("written_at",), partitions=spark.sparkContext.defaultParallelism)
    counts = term_counts(postings, "written_at")
    write_batches(counts, f"{place}/out", f"{place}/state", "complete").awaitTermination()
    return spark.read.parquet(f"{place}/out").groupBy(F.date_format("window_start", "yyyy-MM").alias("month")).agg(F.sum("n").alias("n"), F.countDistinct("term").alias("n_terms"))


def written_postings(spark: SparkSession, d: str) -> DataFrame:
    """One term's postings, written as Parquet by the hash of the term and read from its part."""
    place = scratch(spark, "postings")
    search.write_postings(_postings(spark, d), place)
    return search.read_term(spark, place, "weistim").select("doc_id", F.col("start").cast("bigint").alias("start_offset"), F.col("position").cast("bigint").alias("position"))


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The table function in SQL: tokens by type, with the lengths of their texts in UTF-16 units."""
    register(spark)
    _docs(spark, d).where("text is not null").createOrReplaceTempView("lemmaflow_documents")
    return spark.sql("SELECT s.type AS type, count(*) AS n, sum(CAST(utf16_length(s.token) AS BIGINT)) AS units FROM lemmaflow_documents, LATERAL search_tokens(text) s GROUP BY s.type")


QUERIES = {
    "gap_tokens_conservative": _gap_tokens(TokenizerOptions.conservative()),
    "gap_tokens_search": _gap_tokens(SEARCH),
    "token_type_counts": token_type_counts,
    "positions_compact": _positions(AnalysisOptions()),
    "positions_preserve": _positions(PRESERVE),
    "term_stats": term_stats,
    "doc_stats": doc_stats,
    "posting_stats": lambda s, d: search.term_stats(_postings(s, d)),
    "posting_doc_stats": lambda s, d: search.doc_stats(_postings(s, d)),
    "document_ends": document_ends,
    "term_query": lambda s, d: search.term_query(_postings(s, d), "weistim"),
    "prefix_query": lambda s, d: search.pattern_query(_postings(s, d), "Врыгол*"),
    "analyzed_query": analyzed_query,
    "phrase_query": lambda s, d: search.phrase_query(_postings(s, d), PHRASE),
    "phrase_gap_query": lambda s, d: search.phrase_query(_postings(s, d, options=PRESERVE), APART, [0, 4]),
    "boolean_query": lambda s, d: search.boolean_query(_postings(s, d), SHOULD, MUST, MUST_NOT),
    "boolean_topk": lambda s, d: search.boolean_query(_postings(s, d), SHOULD, k=20),
    "prepare_text": prepared_text(False),
    "prepare_json_line": prepared_text(True),
    "preparation_issues": preparation_issues,
    "grammar_parse": grammar_parse,
    "all_grammemes": all_grammemes,
    "lemma_all": lemma_all,
    "lemma_best_weight": lemma_best_weight,
    "url_tokens": _entity("url"),
    "email_tokens": _entity("email"),
    "currency_forms": currency_forms,
    "number_forms": number_forms,
    "dictionary_terms": dictionary_terms,
    "lemma_phrase": lemma_phrase,
    "align_records": align_records,
    "precomputed_terms": precomputed_terms,
    "chunk_bounds": chunk_bounds,
    "normalized_terms": normalized_terms,
    "echo_tokens": echo_tokens,
    "stream_term_counts": stream_term_counts,
    "stream_postings_sink": stream_postings_sink,
    "stream_hourly_terms": stream_hourly_terms,
    "written_postings": written_postings,
    "sql_functions": sql_functions,
}

# The SQL says classes, messages and forms anew, in its own terms, so that a wrong table can't agree with itself.
_S = '"\\p{Cc}\\p{Cf}\\p{Ps}\\p{Pe}\\p{Pi}\\p{Pf}\\p{Zl}\\p{Zp} \\x{1680}\\x{2000}-\\x{2006}\\x{2008}-\\x{200A}\\x{205F}\\x{3000}'
_PARTS = "\\p{Nd}\\p{M}\\p{Nl}\\p{No}\\x{AD}\\x{55B}\\x{55C}\\x{55E}\\x{6DE}"
_W = "\\p{L}" + _PARTS
_N = _PARTS + "+#.;·։؟۔܁܂।॥።፧᙮។៕᠁᠃᠉᥄᥅…‼‽⁇⁈⁉﹒﹖﹗" + "\\x{37E}\\x{387}"
_C = "\\p{Sc}元"
_CUT = "://|@|%s[" + _S + "]+|[" + _N + "]+|[" + _W + "]+|(?s:.)"
_CONTROLS = "\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{7F}-\\x{9F}"
_UNSAFE = _CONTROLS + "\\x{FDD0}-\\x{FDEF}" + "".join(f"\\x{{{p}FFFE}}\\x{{{p}FFFF}}" for p in ["", *"123456789ABCDEF", "10"])
_MONEY = """$ доллар, $ dollar, $ dólar, $ 美元, $ usd, € евро, € euro, € 欧元, € eur, £ фунт, £ pound, £ pfund, £ libra, £ livre, £ 英镑, £ gbp,
₽ рубль, ₽ ruble, ₽ rubel, ₽ rublo, ₽ rouble, ₽ 卢布, ₽ rub, ₣ франк, ₣ franc, ₣ franken, ₣ franco, ₣ 法郎, ₣ chf, ₩ вон, ₩ won, ₩ 韩元, ₩ krw,
₹ рупия, ₹ rupee, ₹ rupie, ₹ rupia, ₹ roupie, ₹ 卢比, ₹ inr, ¥ иена, ¥ юань, ¥ yen, ¥ yuan, ¥ 日元, ¥ 元, ¥ jpy, 元 юань, 元 yuan, 元 cny"""
_LEN16 = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def _q(text: str) -> str:
    return text.replace("'", "''")


def _tokens(currencies: bool, numbers: bool, source: str = "SELECT doc_id, text, lang FROM documents", key: str = "doc_id") -> str:
    money = f"WHEN regexp_full_match(token, '[{_C}]') THEN 'CURRENCY' " if currencies else ""
    return f"""
src AS ({source}),
cut AS (SELECT *, regexp_extract_all(text, '{_q(_CUT % (f'[{_C}]|' if currencies else ''))}') AS l FROM src WHERE text IS NOT NULL),
raw AS (SELECT * EXCLUDE (l, text), unnest(l) AS token, generate_subscripts(l, 1) - 1 AS ord FROM cut),
placed AS (SELECT *, sum({_LEN16.format("token")}) OVER (PARTITION BY {key} ORDER BY ord) AS end_offset FROM raw),
tok AS (SELECT *, end_offset - {_LEN16.format("token")} AS start_offset, CASE {money}
  WHEN regexp_full_match(token, '[{_q(_N)}]+') AND regexp_matches(token, '\\p{{Nd}}') THEN '{"NUMBER" if numbers else "WORD"}'
  WHEN regexp_full_match(token, '[{_W}]+') AND regexp_matches(token, '[\\p{{L}}\\p{{Nd}}]') THEN 'WORD'
  WHEN regexp_matches(token, '[{_q(_S)}]') THEN 'SEPARATOR' ELSE 'OTHER' END AS type FROM placed)"""


_FORMS = """
f0 AS (SELECT *, CASE WHEN regexp_matches(token, '[\\x{301}\\x{341}]') THEN [regexp_replace(token, '[\\x{301}\\x{341}]', '', 'g')]
  WHEN regexp_matches(token, '\\p{Nd}') AND regexp_full_match(token, '[@N]+') AND regexp_matches(token, '(#|\\+)$')
    THEN [token, regexp_replace(token, '(#|\\+\\+|\\+)$', '')] ELSE [token] END AS fl,
  regexp_matches(token, '\\p{Nd}') AND regexp_full_match(token, '[@N]+') OR type = 'CURRENCY' AS keyword FROM tok),
bearing AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS compact, ord - coalesce(lag(ord) OVER (PARTITION BY doc_id ORDER BY ord), -1) AS step FROM f0 WHERE type NOT IN ('SEPARATOR', 'OTHER')),
post AS (SELECT * EXCLUDE fl, lower(unnest(fl)) AS term, generate_subscripts(fl, 1) - 1 AS form_no FROM bearing)""".replace("@N", _q(_N))

_POST = "WITH " + _tokens(True, True) + "," + _FORMS
_TEXTS = "SELECT DISTINCT mdoc_id, original_text AS text FROM mystem_documents WHERE original_text IS NOT NULL"
_ASKED = " UNION ALL ".join(f"SELECT {i} AS doc_id, '{t}' AS text, '' AS lang" for i, t in ASKED)
_asked = _POST.replace("SELECT doc_id, text, lang FROM documents", _ASKED).replace("WITH ", "", 1)
for _name in ("src", "cut", "raw", "placed", "tok", "f0", "bearing", "post"):
    _asked = _asked.replace(f"{_name} AS (", f"q_{_name} AS (").replace(f"FROM {_name}", f"FROM q_{_name}")
_in = lambda terms: ", ".join(f"'{t}'" for t in terms)
_GRAMMEMES = "list_filter(list_transform(string_split({0}, ','), lambda x: regexp_replace(x, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')), lambda x: x <> '')"
_GRAMMAR = f"""
WITH r AS (SELECT DISTINCT gr_id, coalesce(raw, '') AS raw FROM grammar_strings),
p AS (SELECT gr_id, CASE WHEN contains(raw, '=') THEN raw[:instr(raw, '=') - 1] ELSE raw END AS a, CASE WHEN contains(raw, '=') THEN raw[instr(raw, '=') + 1:] ELSE '' END AS b FROM r),
l AS (SELECT gr_id, b, {_GRAMMEMES.format("a")} AS g FROM p),
g AS (SELECT gr_id, g[1] AS pos, list_sort(list_distinct(g[2:])) AS common, CASE WHEN trim(regexp_replace(b, '\\s', '', 'g')) = '' THEN [CAST([] AS VARCHAR[])]
  WHEN replace(b, '|', '') = '' THEN CAST([] AS VARCHAR[][])
  ELSE list_transform(string_split(regexp_replace(b, '\\|+$', ''), '|'), lambda v: list_sort(list_distinct({_GRAMMEMES.format("regexp_replace(regexp_replace(v, '^[(\\x00-\\x20]+', ''), '[)\\x00-\\x20]+$', '')")}))) END AS variants FROM l)
"""
_AN = """
WITH r AS (SELECT DISTINCT rec_id, CAST(body AS JSON) AS j FROM model_records WHERE json_valid(body)),
t0 AS (SELECT rec_id, {tokens} AS l FROM r), t AS (SELECT rec_id, unnest(l) AS tok, generate_subscripts(l, 1) - 1 AS token_pos FROM t0),
a0 AS (SELECT rec_id, token_pos, {analyses} AS l FROM t), a AS (SELECT rec_id, token_pos, unnest(l) AS an, generate_subscripts(l, 1) - 1 AS n FROM a0),
x AS (SELECT rec_id, token_pos, n, json_extract_string(an, '$.lemma') AS lemma, TRY_CAST(json_extract_string(an, '$.weight') AS DOUBLE) AS weight FROM a)
"""
_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN CAST({0} AS JSON[]) WHEN 'OBJECT' THEN [{0}] ELSE CAST([] AS JSON[]) END"
_AN = _AN.format(tokens=_LIST.format("json_extract(j, '$.tokens')"), analyses=_LIST.format("json_extract(tok, '$.analyses')"))
_FORM_VALUES = ", ".join(f"('{c}', '{f}')" for c, f in [*(x.split() for x in _MONEY.split(",")), *((c, c) for c in "$€£₽₣₩₹¥元")])
_HOSTS = "(?:(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\\.)*[A-Za-z](?:[A-Za-z0-9-]*[A-Za-z0-9])?)"
_DOMAIN = "[\\p{L}\\p{N}](?:[\\p{L}\\p{N}-]*[\\p{L}\\p{N}])?(?:\\.[\\p{L}\\p{N}](?:[\\p{L}\\p{N}-]*[\\p{L}\\p{N}])?)+"
_WORDISH = "\\p{L}\\p{Nd}"

ORACLE = {
    **{
        f"gap_tokens_{name}": "WITH " + _tokens(c, c) + " SELECT doc_id, ord, token, CAST(start_offset AS BIGINT) AS start_offset, CAST(end_offset AS BIGINT) AS end_offset, type FROM tok"
        for name, c in (("conservative", False), ("search", True))
    },
    "token_type_counts": "WITH " + _tokens(True, True) + " SELECT lang, type, count(*) AS n FROM tok GROUP BY lang, type",
    "positions_compact": _POST + " SELECT doc_id, term, CAST(start_offset AS BIGINT) AS start_offset, compact AS position, CASE WHEN form_no = 0 THEN 1 ELSE 0 END AS pos_inc, lower(type) AS type, keyword FROM post",
    "positions_preserve": _POST + " SELECT doc_id, term, CAST(start_offset AS BIGINT) AS start_offset, ord AS position, CASE WHEN form_no = 0 THEN step ELSE 0 END AS pos_inc, lower(type) AS type, keyword FROM post",
    "term_stats": _POST + " SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM post GROUP BY term",
    "doc_stats": _POST + " SELECT doc_id, count(*) AS n_terms, max(compact) + 1 AS n_positions, count(DISTINCT term) AS n_distinct FROM post GROUP BY doc_id",
    "posting_stats": _POST + " SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM post GROUP BY term",
    "posting_doc_stats": _POST + " SELECT doc_id, count(*) AS n_terms, max(compact) + 1 AS n_positions, count(DISTINCT term) AS n_distinct FROM post GROUP BY doc_id",
    "document_ends": "WITH " + _tokens(True, True) + f""", e AS (SELECT doc_id, count(*) AS n, max(CASE WHEN type NOT IN ('SEPARATOR', 'OTHER') THEN ord END) AS last FROM tok GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE {_LEN16.format("text")} END AS final_offset, coalesce(n - 1 - coalesce(last, -1), 0) AS end_increment, coalesce(n, 0) AS n_tokens FROM documents LEFT JOIN e USING (doc_id)""",
    "term_query": _POST + " SELECT DISTINCT doc_id FROM post WHERE term = 'weistim'",
    "prefix_query": _POST + " SELECT DISTINCT doc_id FROM post WHERE term LIKE 'врыгол%'",
    "analyzed_query": _POST + "," + _asked + " SELECT q.doc_id AS query_id, p.doc_id, count(DISTINCT p.term) AS matched_terms FROM post p JOIN (SELECT DISTINCT doc_id, term FROM q_post) q ON p.term = q.term GROUP BY ALL",
    "phrase_query": _POST + f" SELECT DISTINCT a.doc_id FROM post a JOIN post b ON a.doc_id = b.doc_id AND b.compact = a.compact + 1 AND b.term = '{PHRASE[1]}' JOIN post c ON a.doc_id = c.doc_id AND c.compact = a.compact + 2 AND c.term = '{PHRASE[2]}' WHERE a.term = '{PHRASE[0]}'",
    "phrase_gap_query": _POST + f" SELECT DISTINCT a.doc_id FROM post a JOIN post b ON a.doc_id = b.doc_id AND b.ord = a.ord + 4 AND b.term = '{APART[1]}' WHERE a.term = '{APART[0]}'",
    "boolean_query": _POST + f" SELECT doc_id, count(*) FILTER (term IN ({_in(SHOULD + MUST)})) AS score FROM post GROUP BY doc_id HAVING bool_or(term = '{MUST[0]}') AND NOT bool_or(term = '{MUST_NOT[0]}')",
    "boolean_topk": _POST + f" SELECT doc_id, count(*) AS score FROM post WHERE term IN ({_in(SHOULD)}) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20",
    "prepare_text": f"WITH d AS ({_TEXTS}) SELECT mdoc_id, regexp_replace(text, '[{_UNSAFE}]', ' ', 'g') AS prepared, length(text) - length(regexp_replace(text, '[{_UNSAFE}]', '', 'g')) AS n_issues FROM d",
    "prepare_json_line": f"WITH d AS ({_TEXTS}) SELECT mdoc_id, regexp_replace(text, '[{_UNSAFE}\\r\\n]', ' ', 'g') AS prepared, length(text) - length(regexp_replace(text, '[{_UNSAFE}\\r\\n]', '', 'g')) AS n_issues FROM d",
    "preparation_issues": f"""WITH d AS ({_TEXTS}), c AS (SELECT mdoc_id, regexp_extract_all(text, '[{_UNSAFE}\\r\\n]|[^{_UNSAFE}\\r\\n]+') AS l FROM d),
e AS (SELECT mdoc_id, unnest(l) AS p, generate_subscripts(l, 1) AS n FROM c), o AS (SELECT *, sum({_LEN16.format("p")}) OVER (PARTITION BY mdoc_id ORDER BY n) - {_LEN16.format("p")} AS place FROM e)
SELECT mdoc_id, CASE WHEN regexp_matches(p, '[{_CONTROLS}\\r\\n]') THEN 'CONTROL_CHARACTER' ELSE 'NONCHARACTER' END AS type,
  CASE WHEN regexp_matches(p, '[\\r\\n]') THEN 'Line separator replaced with space for JSON-line protocol' WHEN regexp_matches(p, '[{_CONTROLS}]') THEN 'Control character replaced with space' ELSE 'Unicode noncharacter replaced with space' END AS message,
  CAST(place AS BIGINT) AS issue_offset, CAST({_LEN16.format("p")} AS BIGINT) AS issue_length FROM o WHERE regexp_full_match(p, '[{_UNSAFE}\\r\\n]')""",
    "grammar_parse": _GRAMMAR + "SELECT gr_id, pos, array_to_string(common, ',') AS common, len(variants) AS n_variants, array_to_string(list_transform(variants, lambda v: array_to_string(v, ',')), '|') AS variants FROM g",
    "all_grammemes": _GRAMMAR + "SELECT gr_id, array_to_string(list_sort(list_distinct(list_concat(common, flatten(variants)))), ',') AS grammemes FROM g",
    "lemma_all": _AN + ", f AS (SELECT rec_id, token_pos, lemma, min(n) AS n FROM x WHERE lemma <> '' GROUP BY ALL) SELECT rec_id, token_pos, coalesce((SELECT string_agg(lemma, ',' ORDER BY n) FROM f WHERE f.rec_id = y.rec_id AND f.token_pos = y.token_pos), '') AS lemmas FROM (SELECT DISTINCT rec_id, token_pos FROM x) y",
    "lemma_best_weight": _AN + "SELECT rec_id, token_pos, first(lemma ORDER BY weight DESC NULLS LAST, n) FILTER (lemma <> '') AS lemma FROM x GROUP BY rec_id, token_pos",
    "url_tokens": f"""WITH g0 AS (SELECT doc_id, regexp_extract_all(text, '[{_q(_S)}]+|[^{_q(_S)}]+') AS l FROM documents WHERE contains(text, '://') OR contains(text, '@')),
g AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS n FROM g0), o AS (SELECT *, sum({_LEN16.format("p")}) OVER (PARTITION BY doc_id ORDER BY n) - {_LEN16.format("p")} AS place FROM g),
u AS (SELECT doc_id, place + length(regexp_extract(p, '^[^{_WORDISH}]*')) AS start_offset, regexp_extract(p, '[{_WORDISH}].*[{_WORDISH}]') AS a FROM o WHERE contains(p, '://') AND NOT contains(p, '@'))
SELECT doc_id, CAST(start_offset AS BIGINT) AS start_offset, lower(a) AS address, lower(regexp_extract(a, '://({_HOSTS})', 1)) AS domain FROM u WHERE regexp_full_match(a, '[A-Za-z][A-Za-z0-9+.-]*://{_HOSTS}(:[0-9]*)?([/?#].*)?')""",
    "email_tokens": f"""WITH g0 AS (SELECT doc_id, regexp_extract_all(text, '[{_q(_S)}]+|[^{_q(_S)}]+') AS l FROM documents WHERE contains(text, '@')),
g AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS n FROM g0), o AS (SELECT *, sum({_LEN16.format("p")}) OVER (PARTITION BY doc_id ORDER BY n) - {_LEN16.format("p")} AS place FROM g),
u AS (SELECT doc_id, place, p, regexp_extract(p, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}._%+-]*@{_DOMAIN}') AS a FROM o WHERE contains(p, '@') AND NOT contains(p, '://'))
SELECT doc_id, CAST(place + instr(p, a) - 1 AS BIGINT) AS start_offset, lower(a) AS address, lower(regexp_extract(a, '@(.*)', 1)) AS domain FROM u WHERE a <> ''""",
    "currency_forms": "WITH " + _tokens(True, False) + f", v(symbol, form) AS (VALUES {_FORM_VALUES}) SELECT doc_id, CAST(start_offset AS BIGINT) AS start_offset, coalesce(form, lower(token)) AS form FROM tok LEFT JOIN v ON token = symbol WHERE type = 'CURRENCY'",
    "number_forms": _POST + " SELECT doc_id, CAST(start_offset AS BIGINT) AS start_offset, term AS form, true AS keyword FROM post WHERE type = 'NUMBER'",
    "dictionary_terms": f"""WITH d AS ({_TEXTS}), w AS (SELECT mdoc_id, unnest(regexp_extract_all(text, '[{_W}]+')) AS word FROM d),
v AS (SELECT DISTINCT lower(token_text) AS w, lemma FROM token_forms WHERE token_text <> '' AND lemma <> '')
SELECT mdoc_id, lower(regexp_replace(lemma, '[\\x{{301}}\\x{{341}}]', '', 'g')) AS term, count(*) AS n FROM w JOIN v ON lower(word) = w GROUP BY ALL""",
    "normalized_terms": "SELECT lower(token_text) AS term, count(*) AS n FROM token_forms WHERE token_text IS NOT NULL GROUP BY 1",
    "echo_tokens": "WITH " + _tokens(False, False) + ", c AS (SELECT lower(type) AS type FROM tok WHERE type NOT IN ('SEPARATOR', 'OTHER')), x AS (SELECT token FROM tok WHERE type = 'WORD' AND regexp_full_match(token, '[" + _q(_N) + "]+') AND regexp_matches(token, '\\p{Nd}') AND regexp_matches(token, '(#|\\+)$') AND NOT regexp_matches(token, '[\\x{301}\\x{341}]')) SELECT 'word' AS type, (SELECT count(*) FROM c) + (SELECT count(*) FROM x) AS n",
    "stream_postings_sink": _POST + " SELECT lower(type) AS type, count(*) AS n, CAST(sum(compact) AS BIGINT) AS positions FROM post GROUP BY 1",
    "stream_hourly_terms": _POST.replace("SELECT doc_id, text, lang FROM documents", "SELECT doc_id, text, written_at FROM documents WHERE written_at IS NOT NULL") + " SELECT strftime(written_at, '%Y-%m') AS month, count(*) AS n, count(DISTINCT term) AS n_terms FROM post GROUP BY 1",
    "written_postings": _POST + " SELECT doc_id, CAST(start_offset AS BIGINT) AS start_offset, compact AS position FROM post WHERE term = 'weistim'",
    "sql_functions": "WITH " + _tokens(True, True) + f" SELECT type, count(*) AS n, CAST(sum({_LEN16.format('token')}) AS BIGINT) AS units FROM tok GROUP BY type",
    "lemma_phrase": "WITH " + _tokens(True, True, _TEXTS, "mdoc_id").replace("regexp_extract_all(text, '", f"regexp_extract_all(text, '[{_W}]+|") + f""",
v AS (SELECT DISTINCT lower(token_text) AS w, lemma FROM token_forms WHERE token_text <> '' AND lemma <> ''),
kinds AS (SELECT * FROM tok WHERE type NOT IN ('SEPARATOR', 'OTHER') OR lower(token) IN (SELECT w FROM v)),
p AS (SELECT mdoc_id, token, row_number() OVER (PARTITION BY mdoc_id ORDER BY ord) AS position FROM kinds),
m AS (SELECT mdoc_id, position, lower(regexp_replace(coalesce(lemma, token), '[\\x{{301}}\\x{{341}}]', '', 'g')) AS term FROM p LEFT JOIN v ON lower(token) = w)
SELECT DISTINCT a.mdoc_id FROM m a JOIN m b ON a.mdoc_id = b.mdoc_id AND b.position = a.position + 2 WHERE a.term = 'очень' AND b.term = 'врыгола'""",
    "chunk_bounds": f"""WITH RECURSIVE d AS ({_TEXTS}),
u AS (SELECT mdoc_id, regexp_replace(text, '[\\x{{10000}}-\\x{{10FFFF}}]', chr(57344) || chr(57345), 'g') AS u FROM d WHERE text <> ''),
c AS (SELECT mdoc_id, u, CAST(-1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM u
  UNION ALL SELECT mdoc_id, u, n + 1, b, b + CASE WHEN length(u) - b <= 200 THEN length(u) - b ELSE
    CASE WHEN regexp_matches(w, '[\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\pZ]') THEN length(regexp_extract(w, '^(?s:.*)[\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\pZ]')) ELSE length(w) END END
  FROM (SELECT *, regexp_replace(substring(u, b + 1, 200), chr(57344) || '$', '') AS w FROM c WHERE b < length(u)))
SELECT mdoc_id, n AS chunk_no, a AS start_offset, b AS end_offset FROM c WHERE n >= 0""",
    "align_records": f"""WITH RECURSIVE d AS ({_TEXTS}),
{_AN.strip().removeprefix("WITH ").rsplit("a0 AS", 1)[0].rstrip().rstrip(",")},
k AS (SELECT DISTINCT rec_id, mdoc_id FROM model_records),
y AS (SELECT t.rec_id, token_pos, coalesce(json_extract_string(tok, '$.text'), '') AS w, TRY_CAST(json_extract(tok, '$.start') AS BIGINT) AS recorded_start FROM t),
s AS (SELECT rec_id, text, CAST(-1 AS BIGINT) AS token_pos, CAST(0 AS BIGINT) AS cursor, CAST(-1 AS BIGINT) AS a, CAST(-1 AS BIGINT) AS b, CAST(NULL AS BIGINT) AS recorded_start FROM (SELECT DISTINCT rec_id FROM y) JOIN k USING (rec_id) JOIN d USING (mdoc_id)
  UNION ALL SELECT rec_id, text, token_pos, CASE WHEN found IS NULL THEN cursor ELSE cursor + hit - 1 + length(found) END, CASE WHEN found IS NULL THEN -1 ELSE cursor + hit - 1 END, CASE WHEN found IS NULL THEN -1 ELSE cursor + hit - 1 + length(found) END, recorded_start
  FROM (SELECT *, CASE WHEN found = '' THEN 1 ELSE instr(rest, found) END AS hit FROM
   (SELECT *, CASE WHEN w = '' OR contains(rest, w) THEN w WHEN contains(text, chr(173)) AND NOT contains(w, chr(173)) THEN nullif(regexp_extract(rest, soft), '') END AS found FROM
    (SELECT s.rec_id, text, y.token_pos, cursor, y.recorded_start, w, substring(text, cursor + 1) AS rest, chr(173) || '*' || array_to_string(list_transform(string_split(w, ''), lambda c: regexp_escape(c)), chr(173) || '*') AS soft FROM s JOIN y ON s.rec_id = y.rec_id AND y.token_pos = s.token_pos + 1))))
SELECT rec_id, token_pos, CASE WHEN a < 0 THEN -1 ELSE {_LEN16.format("substring(text, 1, a)")} END AS start_offset, CASE WHEN b < 0 THEN -1 ELSE {_LEN16.format("substring(text, 1, b)")} END AS end_offset, recorded_start FROM s WHERE token_pos >= 0""",
    "stream_term_counts": _POST + " SELECT term, count(*) AS n FROM post GROUP BY term",
}
