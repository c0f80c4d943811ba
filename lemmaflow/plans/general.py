"""Queries of the general data-preparation operators, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.operators.nested import flatten
from lemmaflow.operators.packed import split_packed
from lemmaflow.runtime import spread, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "grammar_strings")).withColumnRenamed("value", "grammeme")


def _level(level: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        flat = flatten(spread(table(spark, d, "model_records").select("rec_id", "body")), level)
        listed = [name for name, kind in flat.dtypes if kind.startswith("array")]
        return flat.withColumns({name: F.concat_ws(",", name) for name in listed})

    return query


QUERIES = {
    "p2_found": p2_found,
    "p3_found": _level("paths"),
    "p3_records": _level("records"),
    "p3_tokens": _level("tokens"),
    "p3_analyses": _level("analyses"),
    "p3_variants": _level("variants"),
}

_TOK = "regexp_extract_all(raw, '\"(?:[^\"]|\"\")*\"|''[^'']*''|«[^»]*»|[^\\s,;/|=、()\"«»'']+')"
_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN CAST({0} AS JSON[]) WHEN 'OBJECT' THEN [{0}] ELSE CAST([] AS JSON[]) END"
_P3 = f"""
WITH r AS (SELECT DISTINCT rec_id, CAST(body AS JSON) AS j FROM model_records WHERE json_valid(body)),
t0 AS (SELECT rec_id, {_LIST.format("json_extract(j, '$.tokens')")} AS l FROM r),
t AS (SELECT rec_id, unnest(CASE WHEN len(l) = 0 THEN [-1] ELSE generate_series(0, len(l) - 1) END) AS token_pos, unnest(CASE WHEN len(l) = 0 THEN [CAST(NULL AS JSON)] ELSE l END) AS tok FROM t0),
a0 AS (SELECT rec_id, token_pos, {_LIST.format("json_extract(tok, '$.analyses')")} AS l FROM t),
a AS (SELECT rec_id, token_pos, unnest(CASE WHEN len(l) = 0 THEN [-1] ELSE generate_series(0, len(l) - 1) END) AS analysis_pos, unnest(CASE WHEN len(l) = 0 THEN [CAST(NULL AS JSON)] ELSE l END) AS an FROM a0),
v0 AS (SELECT rec_id, token_pos, analysis_pos, {_LIST.format("json_extract(an, '$.grammar.variants')")} AS l FROM a)
SELECT rec_id, CAST(token_pos AS BIGINT) AS token_pos, CAST(analysis_pos AS BIGINT) AS analysis_pos,
  CAST(unnest(CASE WHEN len(l) = 0 THEN [-1] ELSE generate_series(0, len(l) - 1) END) AS BIGINT) AS variant_pos FROM v0
"""

_LEVELS = _P3[: _P3.rindex("SELECT rec_id, CAST(token_pos")]
_STRINGS = "coalesce(array_to_string(CAST({0} AS VARCHAR[]), ','), '')"

ORACLE = {
    "p3_tokens": _LEVELS + """SELECT rec_id, CAST(token_pos AS BIGINT) AS token_pos, json_extract_string(tok, '$.text') AS text,
  CAST(json_extract(tok, '$.start') AS BIGINT) AS start_offset, CAST(json_extract(tok, '$.end') AS BIGINT) AS end_offset FROM t WHERE token_pos >= 0""",
    "p3_analyses": _LEVELS + f"""SELECT rec_id, CAST(token_pos AS BIGINT) AS token_pos, CAST(analysis_pos AS BIGINT) AS analysis_pos, json_extract_string(an, '$.lemma') AS lemma,
  TRY_CAST(json_extract_string(an, '$.weight') AS DOUBLE) AS weight, json_extract_string(an, '$.grammar.raw') AS grammar_raw, json_extract_string(an, '$.grammar.pos') AS part_of_speech,
  {_STRINGS.format("json_extract(an, '$.grammar.common')")} AS common FROM a WHERE analysis_pos >= 0""",
    "p3_variants": _LEVELS + f""", v AS (SELECT rec_id, token_pos, analysis_pos, unnest(l) AS variant, generate_subscripts(l, 1) - 1 AS variant_pos FROM v0)
SELECT rec_id, CAST(token_pos AS BIGINT) AS token_pos, CAST(analysis_pos AS BIGINT) AS analysis_pos, CAST(variant_pos AS BIGINT) AS variant_pos, {_STRINGS.format("json_extract(variant, '$.grammemes')")} AS grammemes FROM v""",
    "p2_found": f"""
WITH r AS (SELECT DISTINCT gr_id, raw FROM grammar_strings WHERE raw IS NOT NULL),
t AS (SELECT gr_id, unnest({_TOK}) AS v, generate_subscripts({_TOK}, 1) AS n FROM r),
c AS (SELECT gr_id, n, trim(CASE WHEN v LIKE '"%' AND len(v) > 1 THEN replace(v[2:-2], '""', '"')
  WHEN (v LIKE '''%' OR v LIKE '«%') AND len(v) > 1 THEN v[2:-2] ELSE v END) AS grammeme FROM t)
SELECT gr_id, row_number() OVER (PARTITION BY gr_id ORDER BY n) - 1 AS value_pos, grammeme FROM c WHERE grammeme <> ''
""",
    "p3_found": _P3,
    "p3_records": """SELECT DISTINCT rec_id, CAST(CASE json_type(CAST(body AS JSON), '$.tokens') WHEN 'ARRAY' THEN json_array_length(CAST(body AS JSON), '$.tokens')
  WHEN 'OBJECT' THEN 1 ELSE 0 END AS BIGINT) AS n_tokens FROM model_records WHERE json_valid(body)""",
}
