"""The functions for SQL: native ones as SQL functions, the tokenizer as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lemmaflow.functions.text import LINE_BREAKS, NONCHARACTERS, UNSAFE_CONTROLS
from lemmaflow.options import TokenizerOptions


def register(spark: SparkSession, options: TokenizerOptions = TokenizerOptions.search()) -> None:
    """Adds prepare_text, prepare_json_line, utf16_length, normalize_term and the table function search_tokens."""
    # in an SQL literal a backslash is written twice
    unsafe = f"[{UNSAFE_CONTROLS}{NONCHARACTERS}".replace("\\", "\\\\")
    breaks = LINE_BREAKS.replace("\\", "\\\\")
    bodies = {
        "prepare_text(t STRING) RETURNS STRING": f"regexp_replace(t, '{unsafe}]', ' ')",
        "prepare_json_line(t STRING) RETURNS STRING": f"regexp_replace(t, '{unsafe}{breaks}]', ' ')",
        "utf16_length(t STRING) RETURNS INT": "CAST(octet_length(encode(t, 'UTF-16BE')) / 2 AS INT)",
        "normalize_term(t STRING) RETURNS STRING": "lower(t)",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    class SearchTokens:
        def __init__(self):
            from lemmaflow.operators.tokens import Tokenizer

            self.tokenizer = Tokenizer(options)

        def eval(self, text: str):
            from lemmaflow.operators.tokens import to_utf16

            if text is None:
                return
            at = to_utf16(text)
            for n, (token, start, end, kind, forms) in enumerate(self.tokenizer.tokenize(text)):
                yield n, token, at(start), at(end), kind, [f for f, _ in forms]

    spark.udtf.register("search_tokens", udtf(SearchTokens, returnType="ord int, token string, start int, `end` int, type string, forms array<string>"))
