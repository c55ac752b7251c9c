"""Temporary SQL functions, for users who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from stackroom.functions.text import ACCENTED, UNACCENTED

_SUM = "aggregate({0}, 0D, (acc, x) -> acc + x)".format
_PRODUCTS = "zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE))".format
_NORMS = f"sqrt({_SUM(_PRODUCTS('a', 'a'))}) * sqrt({_SUM(_PRODUCTS('b', 'b'))})"

FUNCTIONS = {
    "cosine_similarity_of(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": f"CASE WHEN {_NORMS} = 0 THEN 0D WHEN size(a) = size(b) THEN {_SUM(_PRODUCTS('a', 'b'))} / ({_NORMS}) END",
    "euclidean_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": f"CASE WHEN size(a) = size(b) THEN sqrt({_SUM('zip_with(a, b, (x, y) -> (x - y) * (x - y))')}) END",
    "token_estimate(t STRING) RETURNS BIGINT": r"CAST(ceil(regexp_count(t, '\\S+') / 0.75D) AS BIGINT)",
    "fold_accents(t STRING) RETURNS STRING": f"lower(translate(t, '{ACCENTED}', '{UNACCENTED}'))",
}

_WORDS = r"filter(split(lower(translate(t, '{0}', '{1}')), '[^\\p{{L}}\\p{{N}}_]+'), w -> w <> '')".format(ACCENTED, UNACCENTED)
_PARTS = r"""transform(filter(transform(split(t, separator), p -> trim(p)), p -> p <> ''),
  p -> named_struct('text', p, 'tokens', CAST(floor(regexp_count(p, '\\S+') / 0.75D) AS BIGINT)))"""
#: The fold over paragraphs keeps where chunks start. `of` and `starts` are bound by a lambda over an array of one.
_STARTS = """aggregate(transform(of, p -> p.tokens), named_struct('starts', CAST(array() AS ARRAY<INT>), 'cur', 0L, 'i', 0),
  (a, n) -> CASE WHEN a.i = 0 OR (a.cur + n > ideal AND a.cur >= least) THEN named_struct('starts', concat(a.starts, array(a.i)), 'cur', n, 'i', a.i + 1)
                 ELSE named_struct('starts', a.starts, 'cur', a.cur + n, 'i', a.i + 1) END, a -> a.starts)"""
_CHUNKS = f"""get(transform(array({_PARTS}), of -> get(transform(array({_STARTS}), starts -> transform(starts,
  (s, i) -> slice(of, s + 1, coalesce(get(starts, i + 1), size(of)) - s))), 0)), 0)"""

#: Functions that give rows as arrays, for SELECT doc_id, n, sentence FROM (SELECT doc_id, sentences_in(text) AS found FROM
#: documents) LATERAL VIEW inline(found). They become part of the query's plan, as a generator over an expression; functions
#: that return a TABLE would be joined back to the documents by the whole text.
ROW_FUNCTIONS = {
    "sentences_in(t STRING) RETURNS ARRAY<STRUCT<n BIGINT, sentence STRING>>": r"""
      transform(filter(transform(split(t, '(?<=[.!?])\\s+|\n+'), s -> trim(s)), s -> s <> ''), (s, i) -> named_struct('n', CAST(i AS BIGINT), 'sentence', s))""",
    "words_in(t STRING) RETURNS ARRAY<STRUCT<pos BIGINT, word STRING>>": f"transform({_WORDS}, (w, i) -> named_struct('pos', CAST(i AS BIGINT), 'word', w))",
    r"chunks_in(t STRING, separator STRING DEFAULT '\n\\s*\n', ideal BIGINT DEFAULT 2000, least BIGINT DEFAULT 512) RETURNS ARRAY<STRUCT<ordem BIGINT, texto STRING, tokens BIGINT>>": f"""
      transform({_CHUNKS}, (c, i) -> named_struct('ordem', CAST(i + 1 AS BIGINT), 'texto', array_join(transform(c, p -> p.text), '\n'), 'tokens', aggregate(c, 0L, (a, p) -> a + p.tokens)))""",
}


def register(spark: SparkSession) -> None:
    for signature, body in (FUNCTIONS | ROW_FUNCTIONS).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
