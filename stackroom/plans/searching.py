"""Semantic, full-text and hybrid search over the collection, and vector functions over its vectors.

Queries are the vectors of rows whose id is divisible by 50, and the words of such benchmark items.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stackroom.functions import analyze, vectors
from stackroom.functions.text import ACCENTED, UNACCENTED
from stackroom.operators import indexed
from stackroom.operators import search as S
from stackroom.plans.registry import prepared, query, shared_path
from stackroom.sources import index, lists, segments

K = 10
#: Query terms that are searched as one query.
TERMS = ["the", "nicht", "de"]

_FOLD = f"lower(translate(%s, '{ACCENTED}', '{UNACCENTED}'))"
_WORDS = f"list_filter(string_split_regex({_FOLD % 'text'}, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"
#: Postings: the first line of a document has label A, the rest C.
POSTINGS = f"""SELECT doc_id AS id, w[p + 1] AS term, p AS pos, CASE WHEN p < n1 THEN 'A' ELSE 'C' END AS label FROM
  (SELECT doc_id, w, n1, unnest(range(len(w))) AS p FROM (SELECT doc_id, list_concat(w1, w2) AS w, len(w1) AS n1 FROM
    (SELECT doc_id, {_WORDS.replace('text', "string_split(text, chr(10))[1]")} AS w1,
            {_WORDS.replace('text', "array_to_string(string_split(text, chr(10))[2:], chr(10))")} AS w2 FROM documents)))"""
_L2 = "round(list_distance(%s::DOUBLE[], %s::DOUBLE[]), 6)"
_COS = "round(1 - list_cosine_similarity(%s::DOUBLE[], %s::DOUBLE[]), 6)"
_RANK = "round(sum(CASE label WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.4 WHEN 'C' THEN 0.2 ELSE 0.1 END::DOUBLE), 6)"
_IN = ", ".join(f"'{x}'" for x in TERMS)


def postings(t, only=None):
    return analyze.postings(t.documents.select(F.col("doc_id").alias("id"), *_words("text")), FIELDS, ["id"], only=only)


def _stored_index(t):
    path = shared_path(t.spark, "index")
    index.write_texts(t.documents.select(F.col("doc_id").alias("id"), *_words("text")), path, "id", FIELDS)
    return path


def _index(t, name, rows, group, **options):
    made = segments.create(t.spark, shared_path(t.spark, name), "id", (group,), **options)
    return segments.update(made, rows, 0)


def _words(text):
    first = F.substring_index(text, "\n", 1)
    return first.alias("first"), F.substr(F.col(text), F.length(first) + 1).alias("rest")


FIELDS = [("first", "A"), ("rest", "C")]


def document_index(t):
    """The documents' index, made once a session for all queries over it."""

    def make():
        docs = t.documento.select("id", "biblioteca_id", F.length("conteudo").alias("size"), *_words("conteudo"))
        return _index(t, "document-index", docs.select("id", "biblioteca_id", "size", analyze.placed_words(FIELDS, positions=False).alias("words")), "biblioteca_id")

    return prepared(t, "document-index", make)


def row_index(t):
    """The index of the rows that have vectors, each with its document's text."""

    def make():
        docs = t.documents.select(F.col("doc_id").alias("documento_id"), F.length("text").alias("size"), *_words("text"))
        docs = docs.select("documento_id", "size", analyze.placed_words(FIELDS, positions=False).alias("words"))
        return _index(t, "row-index", t.doc_embedding.select("id", "library_id", "documento_id").join(docs, "documento_id").drop("documento_id"), "library_id")

    return prepared(t, "row-index", make)


def query_vectors(t):
    return t.doc_embedding.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding_vector").alias("query_vector"))


def query_terms(t):
    words = analyze.tokens(F.col("text"))
    return t.benchmark.where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(words)).alias("term"))


def first_vector(t):
    """The query's vector, joined as a column: one row."""
    return t.doc_embedding.join(F.broadcast(query_vectors(t).where("query_id = 0").limit(1)))


# --- vectors --------------------------------------------------------------------------------------------------------


@query(
    "v1_normalize",
    """SELECT vec_id, round(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))[1], 6) AS first_value,
              round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS total FROM embeddings""",
)
def _(t):
    unit = t.embeddings.select("vec_id", vectors.normalize(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first_value"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("v2_cosine", f"SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine FROM embeddings e, embeddings q WHERE q.vec_id = 0")
def _(t):
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return t.embeddings.join(F.broadcast(q)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


@query("v3_euclidean", f"SELECT e.vec_id, {_L2 % ('e.embedding', 'q.embedding')} AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 0")
def _(t):
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return t.embeddings.join(F.broadcast(q)).select("vec_id", F.round(vectors.euclidean(F.col("embedding"), F.col("q")), 6).alias("distance"))


@query("v4_dot", "SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS dot FROM embeddings e, embeddings q WHERE q.vec_id = 0")
def _(t):
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return t.embeddings.join(F.broadcast(q)).select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("q")), 6).alias("dot"))


@query("v5_norm", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query("v6_is_normalized", "SELECT vec_id, abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 0.001 AS unit FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", vectors.is_normalized(F.col("embedding"), 0.001).alias("unit"))


@query(
    "v7_resize",
    """SELECT vec_id, CAST(48 AS BIGINT) AS cut, CAST(80 AS BIGINT) AS padded, round(list_sum(list_transform(embedding[1:48], lambda x: x::DOUBLE)), 6) AS cut_sum,
              round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS padded_sum FROM embeddings""",
)
def _(t):
    cut, padded = vectors.resize(F.col("embedding"), 48), vectors.resize(F.col("embedding"), 80)
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), 6)
    return t.embeddings.select("vec_id", F.size(cut).cast("long").alias("cut"), F.size(padded).cast("long").alias("padded"), total(cut).alias("cut_sum"), total(padded).alias("padded_sum"))


@query(
    "v8_v9_add_subtract_scale",
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 2)), 6) AS doubled, CAST(0 AS DOUBLE) AS nothing,
              round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 2.5)), 6) AS scaled FROM embeddings""",
)
def _(t):
    v = F.col("embedding")
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda a, y: a + y), 6)
    return t.embeddings.select("vec_id", total(vectors.add(v, v)).alias("doubled"), total(vectors.subtract(v, v)).alias("nothing"), total(vectors.scale(v, 2.5)).alias("scaled"))


@query(
    "v10_equal_within",
    "SELECT e.vec_id, list_bool_and(list_transform(list_zip(e.embedding, q.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE) <= 0.3)) AS near FROM embeddings e, embeddings q WHERE q.vec_id = 0",
)
def _(t):
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return t.embeddings.join(F.broadcast(q)).select("vec_id", vectors.equal_within(F.col("embedding"), F.col("q"), 0.3).alias("near"))


@query("v11_zeros", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, CAST(0 AS DOUBLE) AS norm FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.size("embedding").cast("long").alias("n"), vectors.norm(vectors.zeros(64)).alias("norm"))


@query("v12_random")
def _(t):
    made = t.embeddings.select("vec_id", vectors.random_vector(8, 42).alias("v"))
    return made.select("vec_id", F.round(vectors.norm(vectors.normalize(F.col("v"))), 6).alias("norm"), F.forall("v", lambda x: F.abs(x) <= 1).alias("within"))


# --- search ---------------------------------------------------------------------------------------------------------


@query(
    "x1_semantic_search",
    f"""SELECT id, documento_id, distance, round(1 / (1 + distance), 6) AS score, CAST(0 AS DOUBLE) AS score_text FROM
        (SELECT e.id, e.documento_id, {_L2 % ('e.embedding_vector', 'q.embedding_vector')} AS distance FROM doc_embedding e, doc_embedding q WHERE q.id = 0 AND e.library_id IN (0, 1, 2))
        ORDER BY distance, id LIMIT {K}""",
)
def x1(t):
    rows = first_vector(t).where(F.col("library_id").isin(0, 1, 2))
    found = S.semantic_search(rows, "embedding_vector", F.col("query_vector"), K)
    return found.select("id", "documento_id", "distance", "score", F.lit(0.0).alias("score_text"))


@query(
    "x2_text_search",
    f"WITH p AS ({POSTINGS}) SELECT p.id, {_RANK} AS score FROM p JOIN documento d ON d.id = p.id WHERE term IN ({_IN}) AND biblioteca_id IN (0, 1, 2) GROUP BY p.id ORDER BY score DESC, p.id LIMIT {K}",
)
def x2(t):
    found = indexed.indexed_search(document_index(t), TERMS, K, where=F.col("biblioteca_id").isin(0, 1, 2))
    return found.orderBy(F.desc("text_rank"), "id").limit(K).select("id", F.col("text_rank").alias("score"))


@query(
    "x2b_text_search_strict",
    f"""WITH p AS ({POSTINGS}), o AS (SELECT id, pos, term, CASE label WHEN 'A' THEN 1.0 ELSE 5.0 END::DOUBLE AS inv FROM p WHERE term IN ('the', 'and', 'of')),
        l AS (SELECT *, row_number() OVER w AS r, sum(inv) OVER w AS cum, max(CASE term WHEN 'the' THEN pos END) OVER w AS a, max(CASE term WHEN 'and' THEN pos END) OVER w AS b, max(CASE term WHEN 'of' THEN pos END) OVER w AS c
              FROM o WINDOW w AS (PARTITION BY id ORDER BY pos)),
        s AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN least(a, b, c) END AS start FROM l),
        m AS (SELECT *, lag(start) OVER (PARTITION BY id ORDER BY pos) AS earlier FROM s)
        SELECT e.id, round(sum((e.r - f.r + 1) / (e.cum - f.cum + f.inv) / (1 + (e.pos - f.pos) - (e.r - f.r))), 6) AS score FROM m e JOIN m f ON f.id = e.id AND f.pos = e.start
        WHERE e.earlier IS NULL OR e.earlier < e.start GROUP BY e.id""",
)
def _(t):
    terms = t.spark.createDataFrame([("the",), ("and",), ("of",)], "term string")
    return S.text_scores(postings(t, ["the", "and", "of"]), terms, ["id"], "strict").select("id", F.col("text_rank").alias("score"))


_HYBRID = f"""WITH p AS ({POSTINGS}),
s AS (SELECT e.id, {_COS % ('e.embedding_vector', 'q.embedding_vector')} AS distance FROM doc_embedding e, doc_embedding q WHERE q.id = 0 AND e.library_id IN (0, 1, 2)),
t AS (SELECT e.id, text_rank FROM (SELECT id AS documento_id, {_RANK} AS text_rank FROM p WHERE term IN ({_IN}) GROUP BY id) JOIN doc_embedding e USING (documento_id) WHERE library_id IN (0, 1, 2)),
sr AS (SELECT id, 1.0::DOUBLE / ({K} + r) AS score_sem FROM (SELECT id, rank() OVER (ORDER BY distance) AS r FROM s) WHERE r <= {2 * K}),
tr AS (SELECT id, 1.0::DOUBLE / ({K} + r) AS score_txt FROM (SELECT id, rank() OVER (ORDER BY text_rank DESC) AS r FROM t) WHERE r <= {2 * K})"""


def semantic_side(t, libraries=None):
    rows = first_vector(t) if libraries is None else first_vector(t).where(F.col("library_id").isin(libraries))
    return rows.select("id", S.distance(F.col("embedding_vector"), F.col("query_vector"), "cosine").alias("distance"))


def textual_side(t):
    return S.text_scores(postings(t, TERMS), t.spark.createDataFrame([(x,) for x in TERMS], "term string"), ["id"])


def hybrid_sides(t):
    """Distances and text ranks of the same rows, those of the libraries: a row's text is that of its document."""
    libraries = [0, 1, 2]
    of_libraries = t.doc_embedding.where(F.col("library_id").isin(libraries)).select("id", "documento_id")
    textual = of_libraries.join(textual_side(t).withColumnRenamed("id", "documento_id"), "documento_id").select("id", "text_rank")
    return semantic_side(t, libraries), textual


@query(
    "x3_hybrid_search",
    f"""{_HYBRID} SELECT coalesce(sr.id, tr.id) AS id, round(coalesce(score_sem, 0), 6) AS score_sem, round(coalesce(score_txt, 0), 6) AS score_txt,
        round(coalesce(score_sem, 0) * 0.6::DOUBLE + coalesce(score_txt, 0) * 0.4::DOUBLE, 6) AS score FROM sr FULL JOIN tr ON sr.id = tr.id ORDER BY score DESC, 1 LIMIT {K}""",
)
def x3(t):
    distance = S.distance(F.col("embedding_vector"), F.col("query_vector"), "cosine")
    found = indexed.prepared_search(row_index(t), first_vector(t), " ".join(TERMS), distance, K, where=F.col("library_id").isin(0, 1, 2))
    return found.select("id", F.round("score_sem", 6).alias("score_sem"), F.round("score_txt", 6).alias("score_txt"), "score")


_BATCH_SEM = f"""SELECT q.id AS query_id, e.id, {_COS % ('e.embedding_vector', 'q.embedding_vector')} AS distance,
   row_number() OVER (PARTITION BY q.id ORDER BY {_COS % ('e.embedding_vector', 'q.embedding_vector')}, e.id) AS rank FROM doc_embedding e, doc_embedding q WHERE q.id % 50 = 0"""
_BATCH_TXT = f"""SELECT query_id, p.id, {_RANK} AS text_rank, row_number() OVER (PARTITION BY query_id ORDER BY {_RANK} DESC, p.id) AS rank FROM p
   JOIN (SELECT DISTINCT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark WHERE item_id % 50 = 0) q USING (term) GROUP BY query_id, p.id"""


@query("x4_batch_semantic", f"SELECT query_id, id, distance, rank FROM ({_BATCH_SEM}) WHERE rank <= {K}")
def x4(t):
    return S.batch_semantic(t.doc_embedding, "embedding_vector", query_vectors(t), K).select("query_id", "id", "distance", "rank")


@query("x4b_batch_textual", f"WITH p AS ({POSTINGS}) SELECT query_id, id, text_rank, rank FROM ({_BATCH_TXT}) WHERE rank <= {K}")
def x4b(t):
    return indexed.indexed_batch(document_index(t), query_terms(t), K).select("query_id", "id", "text_rank", "rank")


@query(
    "x4c_batch_hybrid",
    f"""WITH p AS ({POSTINGS}), s AS (SELECT query_id, id, 1.0::DOUBLE / ({K} + rank) AS a FROM ({_BATCH_SEM}) WHERE rank <= {2 * K}),
        x AS (SELECT query_id, id, 1.0::DOUBLE / ({K} + rank) AS b FROM ({_BATCH_TXT}) WHERE rank <= {2 * K}),
        f AS (SELECT query_id, id, round(coalesce(a, 0) * 0.6::DOUBLE + coalesce(b, 0) * 0.4::DOUBLE, 6) AS score FROM s FULL JOIN x USING (query_id, id))
        SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= {K}""",
)
def x4c(t):
    sem = S.batch_semantic(t.doc_embedding, "embedding_vector", query_vectors(t), 2 * K)
    txt = indexed.indexed_batch(document_index(t), query_terms(t), 2 * K)
    return S.batch_hybrid(sem, txt, K).select("query_id", "id", "score", "rank")


@query(
    "x5_linear_hybrid",
    f"""{_HYBRID} SELECT s.id, round((1 - distance) * 0.6::DOUBLE + coalesce(text_rank, 0) * 0.4::DOUBLE, 6) AS score FROM s LEFT JOIN t ON t.id = s.id JOIN doc_embedding e ON e.id = s.id
        JOIN documento d ON d.id = e.documento_id WHERE d.flag_vigente ORDER BY score DESC, s.id LIMIT {K}""",
)
def x5(t):
    current = t.doc_embedding.join(t.documento.where("flag_vigente").select(F.col("id").alias("documento_id")), "documento_id", "left_semi").select("id")
    semantic, textual = hybrid_sides(t)
    return S.linear_hybrid(semantic.join(current, "id", "left_semi"), textual, K).select("id", "score")


@query(
    "x6_filtered_semantic",
    f"""SELECT e.id, round(1 - {_COS % ('e.embedding_vector', 'q.embedding_vector')}, 6) AS score FROM doc_embedding e JOIN documento d ON d.id = e.documento_id, doc_embedding q
        WHERE q.id = 0 AND d.flag_vigente ORDER BY score DESC, e.id LIMIT {K}""",
)
def x6(t):
    current = t.documento.where("flag_vigente").select(F.col("id").alias("documento_id"))
    rows = first_vector(t).join(current, "documento_id", "left_semi")
    return S.semantic_search(rows, "embedding_vector", F.col("query_vector"), K, metric="cosine").select("id", "score")


@query(
    "x7_query_parsing",
    f"""SELECT item_id, array_to_string(list_distinct_sorted, ' ') AS terms FROM (SELECT item_id, list_sort(list_distinct({_WORDS})) AS list_distinct_sorted FROM benchmark)""",
)
def _(t):
    parsed = analyze.parse_query(F.col("text"))
    return t.benchmark.select("item_id", F.array_join(F.array_sort(parsed["terms"]), " ").alias("terms"))


@query("x8_analyzer", f"WITH p AS ({POSTINGS}) SELECT term, count(*) AS n, count(DISTINCT id) AS df FROM p GROUP BY term")
def _(t):
    return postings(t).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("id").alias("df"))


def _stemmed_sql(rows: str) -> str:
    """rows with the stems of their column term: the stemmer's stages as SQL."""
    for rules in analyze.STEM_STAGES:
        fits = " ".join(f"WHEN regexp_matches(term, '{p}') THEN regexp_replace(term, '{p}', '{into.replace('$1', chr(92) + '1')}')" for p, into in rules)
        rows = f"SELECT * REPLACE (CASE {fits} ELSE term END AS term) FROM ({rows})"
    return rows


_STOP = ", ".join(f"'{w}'" for w in analyze.STOP_WORDS)
STEMMED = _stemmed_sql(f"SELECT * FROM ({POSTINGS}) WHERE term NOT IN ({_STOP})")


def stemmed_postings(t, only=None):
    return analyze.postings(t.documents.select(F.col("doc_id").alias("id"), "text"), [("text", "C")], ["id"], analyze.STOP_WORDS, True, only)


@query("x8b_stemmed_terms", f"WITH p AS ({STEMMED}) SELECT term, count(*) AS n, count(DISTINCT id) AS df FROM p GROUP BY term")
def _(t):
    return stemmed_postings(t).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("id").alias("df"))


@query(
    "x8c_stemmed_search",
    f"""WITH p AS ({STEMMED}) SELECT id, round(sum(0.2::DOUBLE), 6) AS score FROM p WHERE term IN ({_stemmed_sql("SELECT unnest(['casas', 'nicht', 'dans']) AS term")})
        AND id NOT IN (SELECT id FROM p WHERE term IN ({_stemmed_sql("SELECT 'with' AS term")})) GROUP BY id ORDER BY score DESC, id LIMIT {K}""",
)
def _(t):
    found = S.text_search(lambda words: stemmed_postings(t, words), "as casas OR nicht OR DANS -with", t.spark, ["id"], "broad", analyze.STOP_WORDS, True)
    return found.orderBy(F.desc("text_rank"), "id").limit(K).select("id", F.col("text_rank").alias("score"))


@query("x9_inverted_index", f"WITH p AS ({POSTINGS}) SELECT id, term, CAST(pos AS BIGINT) AS pos, label FROM p")
def _(t):
    return postings(t)


@query(
    "x9b_stored_index",
    f"WITH p AS ({POSTINGS}) SELECT p.id, {_RANK} AS score FROM p JOIN documento d ON d.id = p.id WHERE term IN ({_IN}) AND biblioteca_id IN (0, 1, 2) GROUP BY p.id ORDER BY score DESC, p.id LIMIT {K}",
)
def _(t):
    """The text search over an index that is written first; only the buckets of its terms are read."""
    path = _stored_index(t)
    docs = t.documento.where(F.col("biblioteca_id").isin(0, 1, 2)).select("id")
    found = S.text_search(lambda words: index.indexed_postings(t.spark, path, words), " ".join(TERMS), t.spark, ["id"])
    return found.join(docs, "id", "left_semi").orderBy(F.desc("text_rank"), "id").limit(K).select("id", F.col("text_rank").alias("score"))


@query("x9c_term_statistics", f"WITH p AS ({POSTINGS}) SELECT term, df, round(ln(1 + (SELECT count(*) FROM documents) / df), 6) AS idf FROM (SELECT term, count(DISTINCT id) AS df FROM p GROUP BY term)")
def _(t):
    path = _stored_index(t)
    return index.term_statistics(t.spark, path, t.documents.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query("x10_phrase", f"WITH p AS ({POSTINGS}) SELECT id, CAST(pos AS BIGINT) AS start FROM (SELECT id, pos, term, lead(term) OVER (PARTITION BY id ORDER BY pos) AS next FROM p) WHERE term = 'of' AND next = 'the'")
def _(t):
    return S.phrase_matches(postings(t, ["of", "the"]), ["of", "the"], "id")


@query(
    "x7b_query_text",
    f"""WITH p AS ({POSTINGS}), phrase AS (SELECT DISTINCT id FROM (SELECT id, term, lead(term) OVER (PARTITION BY id ORDER BY pos) AS next FROM p) WHERE term = 'of' AND next = 'the')
        SELECT p.id, {_RANK} AS score FROM p JOIN documento d ON d.id = p.id WHERE term IN ('and', 'in', 'of', 'the') AND biblioteca_id IN (0, 1, 2) AND flag_vigente
          AND p.id IN (SELECT id FROM phrase) AND p.id NOT IN (SELECT id FROM p WHERE term = 'with') GROUP BY p.id ORDER BY score DESC, p.id LIMIT {K}""",
)
def _(t):
    """Terms, a phrase, an exclusion, the libraries and the current documents of one query text."""
    docs = t.documento.where(F.col("biblioteca_id").isin(0, 1, 2) & F.col("flag_vigente")).select("id")
    found = S.text_search(lambda words: postings(t, words), 'And AND in "of the" NOT with', t.spark, ["id"])
    return found.join(docs, "id", "left_semi").orderBy(F.desc("text_rank"), "id").limit(K).select("id", F.col("text_rank").alias("score"))


@query("x11_exclusion", f"WITH p AS ({POSTINGS}) SELECT id, {_RANK} AS score FROM p WHERE term = 'the' AND id NOT IN (SELECT id FROM p WHERE term IN ('with', 'from')) GROUP BY id")
def _(t):
    index = postings(t, ["the", "with", "from"])
    scored = S.text_scores(index, t.spark.createDataFrame([("the",)], "term string"), ["id"])
    return S.exclude(scored, index, ["with", "from"], "id").select("id", F.col("text_rank").alias("score"))


def vector_index(t):
    """The folder of the vectors' index, made once a session."""

    def make():
        path = shared_path(t.spark, "vector-index")
        lists.create(t.spark, path, t.doc_embedding.select("id", "embedding_vector"), "id", "embedding_vector")
        return path

    return prepared(t, "vector-index", make)


#: What several queries share, by name.
PREPARED = {"prepare_document_index": document_index, "prepare_row_index": row_index, "prepare_vector_index": vector_index}


@query("x12_approximate_nearest")
def x12(t):
    return S.ann_search(t.spark, vector_index(t), query_vectors(t), K).select("query_id", "id", "distance", "rank")


@query("x12b_recall")
def x12b(t):
    """Of each query's K nearest rows by an exact search, those that the index finds."""
    exact = S.batch_semantic(t.doc_embedding, "embedding_vector", query_vectors(t), K).select("query_id", "id")
    found = S.ann_search(t.spark, vector_index(t), query_vectors(t), K).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("nearest"), F.count("hit").alias("found"))


@query(
    "x13_enriched_results",
    f"""SELECT r.id, d.titulo AS titulo_documento, c.titulo AS titulo_capitulo, r.distance FROM
        (SELECT e.*, {_L2 % ('e.embedding_vector', 'q.embedding_vector')} AS distance FROM doc_embedding e, doc_embedding q WHERE q.id = 0 ORDER BY distance, e.id LIMIT {K}) r
        LEFT JOIN documento d ON d.id = r.documento_id LEFT JOIN chapter c ON c.documento_id = r.documento_id AND c.ordem = r.order_chapter""",
)
def _(t):
    found = S.nearest(first_vector(t), "embedding_vector", F.col("query_vector"), K).select("id", "documento_id", "order_chapter", "distance")
    return S.enrich(found, t.documento, t.chapter).select("id", "titulo_documento", "titulo_capitulo", "distance")


@query(
    "x14_library_weights",
    """SELECT e.id, CAST(CASE l.id WHEN 0 THEN 64 ELSE 40 + l.id END AS BIGINT) AS dimension, round(peso_semantico / (peso_semantico + peso_textual), 6) AS w_sem,
              round(CASE WHEN l.id = 0 THEN sqrt(list_dot_product(embedding_vector::DOUBLE[], embedding_vector::DOUBLE[])) ELSE 1 END, 6) AS norm
       FROM doc_embedding e JOIN library l ON l.id = e.library_id""",
)
def _(t):
    libs = t.library.select(F.col("id").alias("library_id"), F.when(F.col("id") == 0, 64).otherwise(F.col("id").cast("int") + 40).alias("dimension"), (F.col("peso_semantico") / (F.col("peso_semantico") + F.col("peso_textual"))).alias("w"))
    fitted = S.fit_to_libraries(t.doc_embedding, "embedding_vector", libs).join(F.broadcast(libs.select("library_id", "w")), "library_id")
    return fitted.select("id", F.size("embedding_vector").cast("long").alias("dimension"), F.round("w", 6).alias("w_sem"), F.round(vectors.norm(F.col("embedding_vector")), 6).alias("norm"))


@query(
    "x15_paired_check",
    """SELECT a.id, cosine, true AS same_dimension, cosine < 0.8 AS warn FROM (SELECT a.id, round(list_cosine_similarity(a.embedding_vector::DOUBLE[], b.embedding_vector::DOUBLE[]), 6) AS cosine
       FROM doc_embedding a JOIN doc_embedding b ON b.id = a.id + 5) a""",
)
def _(t):
    other = t.doc_embedding.select((F.col("id") - 5).alias("id"), "embedding_vector")
    return S.paired_check(t.doc_embedding, other, "id", "embedding_vector")


@query("w1_rank_by_distance", f"SELECT id, r AS rank, distance FROM (SELECT id, distance, rank() OVER (ORDER BY distance) AS r FROM (SELECT e.id, round({_COS % ('e.embedding_vector', 'q.embedding_vector')}, 1) AS distance FROM doc_embedding e, doc_embedding q WHERE q.id = 0)) WHERE r <= 20")
def _(t):
    rows = semantic_side(t).withColumn("distance", F.round("distance", 1))
    return S.cut_with_ties(rows, "distance", 20, True).select("id", F.col("rank").cast("long").alias("rank"), "distance")


@query("w2_rank_by_text", f"WITH p AS ({POSTINGS}) SELECT id, r AS rank, text_rank FROM (SELECT id, text_rank, rank() OVER (ORDER BY text_rank DESC) AS r FROM (SELECT id, {_RANK} AS text_rank FROM p WHERE term IN ({_IN}) GROUP BY id)) WHERE r <= 20")
def _(t):
    return S.cut_with_ties(textual_side(t), "text_rank", 20, False).select("id", F.col("rank").cast("long").alias("rank"), "text_rank")


