"""Text functions and document jobs over the collection. Texts of the tables have one line break between paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackroom.functions import sql
from stackroom.functions import text as X
from stackroom.operators import chunking as C
from stackroom.operators import pages as P
from stackroom.operators import statutes as L
from stackroom.plans.registry import query
from stackroom.sources.stored import python_path

_WC = "CAST(len(regexp_extract_all({0}, '\\S+')) AS BIGINT)"
_FOLD = f"lower(translate({{0}}, '{X.ACCENTED}', '{X.UNACCENTED}'))"
WC, FOLD = _WC.format, _FOLD.format


# --- functions ------------------------------------------------------------------------------------------------------


@query("f1_token_estimate", f"SELECT doc_id, CAST(ceil({WC('text')} / 0.75) AS BIGINT) AS up, CAST(floor({WC('text')} / 0.75) AS BIGINT) AS down, CAST(ceil(length(text) / 3.8) AS BIGINT) AS by_chars FROM documents")
def _(t):
    c = F.col("text")
    return t.documents.select("doc_id", X.token_estimate(c).alias("up"), X.chunk_tokens(c).alias("down"), X.tokens_from_chars(c).alias("by_chars"))


@query("f2_word_count", f"SELECT doc_id, {WC('text')} AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", X.word_count(F.col("text")).alias("n"))


@query("f3_f4_collapse_repeats")
def _(t):
    python_path(t.spark)
    once = X.collapse_repeated_words(F.col("text"))
    return t.documents.select("doc_id", X.word_count(once).alias("n"), X.word_count(X.collapse_repeated_phrases(F.col("text"))).alias("n_phrases"))


@query("f5_strikethrough", "SELECT page_id, regexp_replace(regexp_replace(html, '<b>', '<s>', 'g'), '(?i)</?(s|strike|del)(\\s[^>]*)?>', '', 'g') AS clean FROM pages")
def _(t):
    return t.pages.select("page_id", X.remove_strikethrough(F.replace("html", F.lit("<b>"), F.lit("<s>"))).alias("clean"))


@query(
    "f6_markup_detection",
    "SELECT doc_id, (" + " OR ".join(f"regexp_matches(text, '{p}')" for p in X.MARKDOWN_PATTERNS) + ") AS markdown, contains(lower(substr(text, 1, 256)), '<html') AS html FROM documents",
)
def _(t):
    return t.documents.select("doc_id", X.is_markdown(F.col("text")).alias("markdown"), X.is_html(F.col("text")).alias("html"))


@query(
    "f7_title_derivation",
    """SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^#+', ''))), lambda x: x <> '' AND length(x) < 200)[1], 'Untitled Document') AS by_text,
              translate(regexp_replace(concat(source, '-', lang, '_', doc_id, '.tar.md'), '\\.[^.]*$', ''), '-_', '  ') AS by_name FROM documents""",
)
def _(t):
    name = F.concat(F.lit("/data/in/"), "source", F.lit("-"), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".tar.md"))
    return t.documents.select("doc_id", X.title_from_text(F.col("text")).alias("by_text"), X.title_from_name(name).alias("by_name"))


@query("f8_truncate", "SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS cut FROM documents")
def _(t):
    return t.documents.select("doc_id", X.truncate(F.col("text"), 300).alias("cut"))


@query("f9_accent_fold", f"SELECT doc_id, {FOLD('text')} AS folded, contains({FOLD('text')}, 'eau') AS has_eau, starts_with({FOLD('text')}, 'e') AS on_e FROM documents")
def _(t):
    c = F.col("text")
    return t.documents.select("doc_id", X.fold(c).alias("folded"), X.contains_folded(c, "éau").alias("has_eau"), X.starts_with_folded(c, "É").alias("on_e"))


@query("f9b_any_accent", "SELECT doc_id, lower(strip_accents(translate(text, 'aeostnu', 'ǎéőșțńų') || ' I' || chr(769) || 'x')) AS folded FROM documents")
def _(t):
    """Letters beyond Latin-1 and combining marks."""
    marked = F.concat(F.translate("text", "aeostnu", "ǎéőșțńų"), F.lit(" I\u0301x"))
    return t.documents.select("doc_id", X.fold(marked).alias("folded"))


_NORM = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


@query("f10_f11_checksums", f"SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, md5({_NORM}) AS md5_normal FROM documents")
def _(t):
    _, md5, sha = X.checksums(F.col("text"))
    return t.documents.select("doc_id", md5, sha, F.md5(F.encode(X.normal_form(F.col("text")), "UTF-8")).alias("md5_normal"))


@query("f11b_crc32")
def _(t):
    return t.documents.select("doc_id", X.checksums(F.col("text"))[0])


@query("f12_checksum_verification", "SELECT doc_id, doc_id % 3 <> 2 AS good FROM documents")
def _(t):
    crc, md5, sha = (F.crc32(F.encode("text", "UTF-8")), F.md5(F.encode("text", "UTF-8")), F.sha2(F.encode("text", "UTF-8"), 256))
    given = F.when(F.col("doc_id") % 3 == 0, F.hex(crc)).when(F.col("doc_id") % 3 == 1, F.upper(md5)).otherwise(F.reverse(sha))
    return t.documents.select("doc_id", X.verify_checksum(F.col("text"), given).alias("good"))


@query(
    "f13_uuid5",
    """SELECT doc_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), lower(to_hex((('0x' || substr(h, 17, 1))::INT & 3) | 8)) || substr(h, 18, 3), substr(h, 21, 12)) AS uuid
        FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(lower(regexp_replace(text, '\\s+', '', 'g')))) AS h FROM documents)""",
)
def _(t):
    return t.documents.select("doc_id", X.uuid5(F.col("text")).alias("uuid"))


@query("f14_text_sha256", "SELECT doc_id, sha256(lower(regexp_replace(text, '\\s+', '', 'g'))) AS sha FROM documents")
def _(t):
    return t.documents.select("doc_id", X.text_sha256(F.col("text")).alias("sha"))


@query("f15_overlap_concat", "SELECT page_id, url AS joined FROM pages")
def _(t):
    left, right = F.left("url", F.length("url") - 4), F.right("url", F.lit(12))
    return t.pages.select("page_id", X.overlap_concat(left, right).alias("joined"))


@query(
    "f16_last_delimiter",
    """SELECT doc_id, CAST(p - CASE WHEN k > 0 AND k % 2 = 0 THEN 1 ELSE 0 END AS INT) AS place FROM
       (SELECT doc_id, p, p + 1 - length(rtrim(substr(s, 1, p + 1), chr(10))) AS k FROM
         (SELECT doc_id, text AS s, list_max(list_transform([chr(10), '!', '.', ';'], lambda m: CASE WHEN contains(text, m) THEN length(text) - strpos(reverse(text), m) ELSE -1 END)) AS p FROM documents))""",
)
def _(t):
    return t.documents.select("doc_id", X.last_delimiter(F.col("text")).alias("place"))


@query(
    "f17_keyword_sections",
    """SELECT doc_id, lang AS titulo, source AS autor, CAST(doc_id AS VARCHAR) AS resumo FROM documents""",
)
def _(t):
    made = F.concat(F.lit("Titulo: "), "lang", F.lit(" -\nAutor: {"), "source", F.lit("}\nResumo: "), F.col("doc_id").cast("string"))
    m = t.documents.select("doc_id", X.keyword_sections(made, ["titulo", "autor", "resumo"]).alias("m"))
    return m.select("doc_id", *[F.col("m")[k].alias(k) for k in ("titulo", "autor", "resumo")])


@query("f18_metadata_line", "SELECT doc_id, lang, source || ':x' AS fonte FROM documents")
def _(t):
    line = F.concat(F.lit("lang: zz | fonte: "), "source", F.lit(":x | lang :"), "lang", F.lit(" | nada"))
    m = t.documents.select("doc_id", X.metadata_line(line).alias("m"))
    return m.select("doc_id", F.col("m")["lang"].alias("lang"), F.col("m")["fonte"].alias("fonte"))


@query("f19_question_answers", "SELECT doc_id, 'O que ' || lang || '?' AS question, source || ' e mais' AS answer FROM documents")
def _(t):
    made = F.concat(F.lit("x\nQ: O que "), "lang", F.lit("?\nA: "), "source", F.lit("\n  e mais\n\nQ: sem resposta"))
    return t.documents.select("doc_id", F.explode(X.question_answers(made)).alias("p")).select("doc_id", "p.question", "p.answer")


@query("f20_format_detection", "SELECT page_id, 'text/html' AS mime, 'text' AS family, CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/json' WHEN 2 THEN 'application/xml' ELSE 'text/plain' END AS made FROM pages")
def _(t):
    k = F.col("page_id") % 4
    made = F.when(k == 0, "%PDF-1.7 x").when(k == 1, '{"a": 1}').when(k == 2, "<?xml version='1.0'?><a/>").otherwise("words only")
    rows = t.pages.select("page_id", X.detect_format(F.encode("html", "UTF-8")).alias("mime"), X.detect_format(F.encode(made, "UTF-8")).alias("made"))
    return rows.select("page_id", "mime", X.format_family(F.col("mime")).alias("family"), "made")


@query("f21_enum_decode", "SELECT doc_id, CASE lang WHEN 'en' THEN 'inglês' WHEN 'de' THEN 'alemão' WHEN 'fr' THEN 'francês' END AS lingua FROM documents")
def _(t):
    return t.documents.select("doc_id", X.decode_enum(F.upper("lang"), {"en": "inglês", "dé": "alemão", "fr": "francês"}).alias("lingua"))


@query("f22_hex", "SELECT doc_id, hex(encode(text)) AS hexed, text AS back FROM documents")
def _(t):
    h = F.hex(F.encode("text", "UTF-8"))
    return t.documents.select("doc_id", h.alias("hexed"), F.decode(F.unhex(h), "UTF-8").alias("back"))


@query("f23_long_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS lida, strftime(o_orderdate, '%Y-%m-%d') AS escrita FROM orders")
def _(t):
    month = F.get(F.array(*map(F.lit, X.MONTHS)), F.month("o_orderdate") - 1)
    said = F.concat(F.lit("Lei de "), F.dayofmonth("o_orderdate").cast("string"), F.when(F.dayofmonth("o_orderdate") == 1, "º").otherwise(""), F.lit(" de "), month, F.lit(" de "), F.year("o_orderdate").cast("string"), F.lit("."))
    return t.orders.select("o_orderkey", X.long_date(said).alias("lida"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("escrita"))


@query("f24_junk_trimming", "SELECT doc_id, regexp_replace(regexp_replace(text, '^(\\s|[-*,{}\\[\\]:#\"]|(10|[1-9])(\\.| ))+', ''), '(\\s|[-*,{}\\[\\]:#\"])+$', '') AS clean FROM documents")
def _(t):
    return t.documents.select("doc_id", X.trim_junk(F.concat(F.lit("## 1. - "), "text", F.lit(" }]"))).alias("clean"))


@query("f25_metadata_merge", "SELECT doc_id, source AS a, 'novo' AS b, lang AS c FROM documents")
def _(t):
    m = X.merge_metadata(F.create_map(F.lit("a"), F.col("source"), F.lit("b"), F.lit("velho")), F.create_map(F.lit("b"), F.lit("novo"), F.lit("c"), F.col("lang")))
    return t.documents.select("doc_id", m.alias("m")).select("doc_id", *[F.col("m")[k].alias(k) for k in "abc"])


@query("f26_list_membership", "SELECT doc_id, contains(lower(text), 'eau') OR contains(lower(text), 'der ') AS has_any, CAST(CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 1 ELSE -1 END AS INT) AS at, CAST(strpos(text, 'the') AS INT) AS the FROM documents")
def _(t):
    return t.documents.select("doc_id", X.contains_any(F.col("text"), ["EAU", "der "]).alias("has_any"), X.index_in(F.col("lang"), ["de", "fr"]).alias("at"), F.greatest(X.least_positive(F.locate("the", F.col("text")), F.lit(0)), F.lit(0)).alias("the"))


@query("f27_json_quoting", "SELECT doc_id, CAST(to_json(text) AS VARCHAR) AS quoted FROM documents")
def _(t):
    return t.documents.select("doc_id", X.quoted(F.col("text")).alias("quoted"))


# --- jobs -----------------------------------------------------------------------------------------------------------


@query("t1_paragraphs", "SELECT doc_id, pos - 1 AS pos, p[pos] AS paragraph FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents))")
def _(t):
    return C.explode_pieces(t.documents, ["doc_id"], C.paragraphs(F.col("text"), r"\n"), "paragraph")


SENTENCES = """SELECT doc_id, pos - 1 AS pos, p[pos] AS sentence FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS pos FROM
       (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents))"""


@query("t1b_sentences", SENTENCES)
def _(t):
    return C.explode_pieces(t.documents, ["doc_id"], C.sentences(F.col("text")), "sentence")


@query("t1d_sql_sentences", SENTENCES)
def _(t):
    """OUTER, as the optimizer would make all sentences once more in a filter for rows without any."""
    sql.register(t.spark)
    return t.spark.sql("SELECT doc_id, s.n AS pos, s.sentence FROM (SELECT doc_id, sentences_in(text) AS found FROM {docs}) LATERAL VIEW OUTER inline(found) s AS n, sentence WHERE n IS NOT NULL", docs=t.documents)


@query("t1c_packed_sentences")
def _(t):
    return C.explode_pieces(t.documents, ["doc_id"], C.packed(C.sentences(F.col("text")), 400), "part")


def marked_lines(t):
    """Short lines as Markdown headings: documents with structure, derived from the table."""
    line = F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) < 16, F.concat(F.lit("## "), x)).otherwise(x))
    return t.documents.select("doc_id", line.alias("lines"))


_LINES = """SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, l[pos] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS pos FROM
   (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length(x) < 16 THEN '## ' || x ELSE x END) AS l FROM documents))"""


@query(
    "t2_heading_detection",
    f"""SELECT doc_id, pos, CASE WHEN regexp_matches(trim(line), '^#{{1,6}}\\s+') THEN '##' ELSE 'numbered' END AS tag, CASE WHEN regexp_matches(trim(line), '^#{{1,6}}\\s+') THEN 2 ELSE 1 END AS level
        FROM ({_LINES}) WHERE regexp_matches(trim(line), '^#{{1,6}}\\s+') OR regexp_matches(trim(line), '^\\d+[.)]\\s+')""",
)
def _(t):
    rows = marked_lines(t).select("doc_id", F.explode(C.headings(F.col("lines"), merge_within=0)).alias("h"))
    return rows.select("doc_id", F.col("h.pos").cast("long").alias("pos"), "h.tag", "h.level")


@query("t2b_merged_headings")
def _(t):
    rows = marked_lines(t).select("doc_id", F.explode(C.headings(F.col("lines"))).alias("h"))
    return rows.select("doc_id", F.col("h.pos").cast("long").alias("pos"), "h.title")


@query(
    "t3_split_by_headings",
    f"""WITH m AS ({_LINES}), s AS (SELECT *, regexp_matches(trim(line), '^#{{1,6}}\\s+') OR regexp_matches(trim(line), '^\\d+[.)]\\s+') AS head FROM m),
        r AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM s)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS BIGINT) AS section, text FROM
        (SELECT doc_id, section, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), '') AS text FROM r GROUP BY 1, 2) WHERE section > 0 OR trim(text) <> ''""",
)
def _(t):
    found = marked_lines(t).withColumn("found", C.headings(F.col("lines"), merge_within=0))
    parts = found.select("doc_id", F.posexplode(C.sections(F.col("lines"), F.col("found"))).alias("section", "s"))
    return parts.select("doc_id", F.col("section").cast("long").alias("section"), F.col("s.text").alias("text"))


def markdown_texts(t):
    """Documents with Markdown headings, marked or underlined, in place of their short lines."""
    short = lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("## "), x)).otherwise(F.concat(x, F.lit("\n---")))
    return t.documents.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(F.length(x) < 16, short(x, i)).otherwise(x)), "\n").alias("text"))


_MARKDOWN = """WITH d AS (SELECT doc_id, string_split(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN length(x) >= 16 THEN x WHEN i % 2 = 0 THEN '## ' || x ELSE x || chr(10) || '---' END), chr(10)), chr(10)) AS l FROM documents),
    n AS (SELECT doc_id, i, l[i] AS x, l[i + 1] AS y, l[i - 1] AS z FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
    k AS (SELECT *, regexp_matches(x, '^#{1,6}\\s+\\S') AS marked, regexp_matches(x, '^\\S') AND coalesce(regexp_matches(y, '^(={3,}|-{3,})\\s*$'), false)
          AND NOT (i > 1 AND regexp_matches(x, '^(={3,}|-{3,})\\s*$') AND regexp_matches(z, '^\\S') AND NOT regexp_matches(z, '^#{1,6}\\s+\\S')) AS under FROM n),
    h AS (SELECT *, coalesce(lag(under AND NOT marked) OVER w, false) AS line_under, sum(CASE WHEN marked OR under THEN 1 ELSE 0 END) OVER w AS section FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    s AS (SELECT doc_id, section, coalesce(trim(replace(min(x) FILTER (marked OR under), '#', '')), 'Introduction') AS title,
                 regexp_replace(string_agg(x, chr(10) ORDER BY i) FILTER (NOT (marked OR under OR line_under)), '^\\s+|\\s+$', '', 'g') AS text FROM h GROUP BY 1, 2)"""


@query("t3b_markdown_sections", f"{_MARKDOWN} SELECT doc_id, title, text FROM s WHERE text <> ''")
def _(t):
    found = markdown_texts(t).select("doc_id", F.split("text", "\n").alias("lines")).withColumn("found", C.markdown_headings(F.col("lines")))
    return found.select("doc_id", F.explode(C.markdown_sections(F.col("lines"), F.col("found"))).alias("s")).select("doc_id", "s.title", "s.text")


@query("t4c_markdown_chunks", f"{_MARKDOWN} SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS words FROM s WHERE text <> '' GROUP BY doc_id")
def _(t):
    rows = C.markdown_chunks(markdown_texts(t), ["doc_id"], "text", r"\n", least=60, ideal=100, most=150)
    return rows.groupBy("doc_id").agg(F.sum(X.word_count(F.col("texto"))).alias("words"))


@query("t4d_large_chunks", f"SELECT doc_id, {WC('text')} AS words FROM documents")
def _(t):
    return C.chunk_rows(t.documents, ["doc_id"], "text", r"\n", **C.LARGE).groupBy("doc_id").agg(F.sum(X.word_count(F.col("texto"))).alias("words"))


def chunks_sql(ideal: int = C.IDEAL, least: int = C.LEAST, most: int = C.MOST) -> str:
    """The chunks of each document, as a recursion over its paragraphs."""
    run, tokens = int(most * 0.75), f"CAST(floor({WC('p')} / 0.75) AS BIGINT)"
    return f"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p)), lambda p: p <> '') AS ps FROM documents),
      c AS (SELECT doc_id, flatten(list_transform(ps, lambda p: CASE WHEN {tokens} > {most} THEN list_transform(range(0, CAST(ceil(len(string_split_regex(p, '\\s+')) / {run}) AS BIGINT)),
              lambda k: array_to_string(string_split_regex(p, '\\s+')[k * {run} + 1:(k + 1) * {run}], ' ')) ELSE [p] END)) AS ps FROM l),
      x AS (SELECT doc_id, i, p, {tokens} AS n FROM (SELECT doc_id, ps[i] AS p, i FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM c))),
      f AS (SELECT doc_id, i, CAST(1 AS BIGINT) AS ordem, n AS cur FROM x WHERE i = 1 UNION ALL
            SELECT x.doc_id, x.i, CASE WHEN cur + n > {ideal} AND cur >= {least} THEN ordem + 1 ELSE ordem END, CASE WHEN cur + n > {ideal} AND cur >= {least} THEN n ELSE cur + n END
            FROM f JOIN x ON x.doc_id = f.doc_id AND x.i = f.i + 1)
      SELECT doc_id, ordem, string_agg(p, chr(10) ORDER BY i) AS texto, CAST(sum(n) AS BIGINT) AS tokens FROM f JOIN x USING (doc_id, i) GROUP BY 1, 2"""


@query("t4_token_budget_chunks", chunks_sql())
def t4(t):
    return C.chunk_rows(t.documents, ["doc_id"], "text", r"\n")


@query("t4e_small_chunks", chunks_sql(200, 60, 400))
def _(t):
    return C.chunk_rows(t.documents, ["doc_id"], "text", r"\n", ideal=200, least=60, most=400)


@query("t4f_sql_chunks", chunks_sql(300, 100, 1 << 30))
def _(t):
    """The same as a function for SQL users."""
    sql.register(t.spark)
    return t.spark.sql("SELECT doc_id, c.* FROM (SELECT doc_id, chunks_in(text, '\n', 300, 100) AS found FROM {docs}) LATERAL VIEW OUTER inline(found) c AS ordem, texto, tokens WHERE ordem IS NOT NULL", docs=t.documents)


@query("t4b_chunks_keep_words", f"SELECT doc_id, {WC('text')} AS words FROM documents")
def _(t):
    rows = C.chunk_rows(t.documents, ["doc_id"], "text", r"\n", ideal=200, least=60, most=400)
    return rows.groupBy("doc_id").agg(F.sum(X.word_count(F.col("texto"))).alias("words"))


@query("t5_assembled_paragraphs")
def _(t):
    return C.explode_pieces(t.documents, ["doc_id"], C.assembled_paragraphs(F.col("text"), 100), "paragraph")


_WIKI = """concat('<!-- c -->', text, ' [[a|', lang, ']] {{t}} [[', source, ']]<ref name="r"/> [http://x.y site]')"""


@query("t6_wiki_clean", "SELECT doc_id, trim(regexp_replace(concat(text, ' ', lang, '  ', source, ' site'), '[ \\t]+', ' ', 'g')) AS clean FROM documents")
def _(t):
    made = F.expr(_WIKI)
    return t.documents.select("doc_id", C.clean_wiki(made).alias("clean"))


@query("t6b_wiki_parts")
def _(t):
    return t.documents.select("doc_id", F.explode(C.numbered_parts(F.col("text"), 100)).alias("p")).select("doc_id", "p.title", "p.text")


@query(
    "t6c_wiki_chapters",
    """WITH n AS (SELECT doc_id, i, l[i] AS x FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
       h AS (SELECT *, length(x) < 16 AND regexp_matches(x, '^[A-Za-z]') AS head FROM n), s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS ordem FROM h)
       SELECT doc_id, CAST(ordem AS BIGINT) AS ordem, CAST(min(i) % 2 + 2 AS INT) AS level, trim(arg_min(x, i)) AS titulo, CAST(sum(len(regexp_extract_all(x, '\\S+'))) + 2 AS BIGINT) AS words FROM s WHERE ordem > 0 GROUP BY doc_id, ordem
       UNION ALL SELECT doc_id, 1, 0, 'T - Parte 1', len(regexp_extract_all(text, '\\S+')) FROM documents WHERE doc_id IN (SELECT doc_id FROM s GROUP BY doc_id HAVING max(ordem) = 0) AND trim(text) <> ''""",
)
def _(t):
    """Short lines that begin with a letter as wiki headings of two levels."""
    mark = lambda i: F.when(i % 2 == 0, "===").otherwise("==")
    line = lambda x, i: F.when((F.length(x) < 16) & x.rlike("^[A-Za-z]"), F.concat(mark(i), F.lit(" "), x, F.lit(" "), mark(i))).otherwise(x)
    made = t.documents.select("doc_id", F.lit("T").alias("title"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))
    return C.wiki_chapters(made, ["doc_id"], "title", "text", 1 << 30).select("doc_id", "ordem", "level", "titulo", X.word_count(F.col("texto")).alias("words"))


_ROUTE = """CASE WHEN contains(h, 'planalto.gov.br') OR contains(h, 'in.gov.br') OR contains(h, 'legislacao') THEN 'normativo' WHEN contains(h, 'wikipedia.org') OR contains(h, 'wikimedia.org') THEN 'wikipedia'
   WHEN h LIKE '%.wiki' OR h LIKE '%.wikitext' THEN 'wikipedia' WHEN h LIKE '%.md' OR h LIKE '%.markdown' THEN 'artigo'
   WHEN contains(l, 'art.') AND contains(l, 'lei') OR contains(l, 'decreto') OR contains(l, 'resolução') OR contains(l, 'portaria') OR contains(l, 'normativa') THEN 'normativo'
   WHEN contains(l, 'categoria:') OR contains(l, '{{') OR contains(l, '[[') OR contains(l, ']]') OR contains(l, '==') AND contains(l, '===') THEN 'wikipedia'
   WHEN contains(l, 'manual') OR contains(l, 'instruções') OR contains(l, 'procedimento') OR contains(l, 'tutorial') THEN 'manual'
   WHEN contains(l, 'contrato') OR contains(l, 'contratante') OR contains(l, 'cláusula') OR contains(l, 'partes') THEN 'contrato' ELSE 'generico' END"""


@query(
    "t7_document_routing",
    f"""SELECT id, tipo, coalesce(CASE WHEN biblioteca_id = 3 THEN 1200 END, CASE tipo WHEN 'normativo' THEN 1500 WHEN 'artigo' THEN 2000 WHEN 'manual' THEN 1800 END, 2000) AS chunk_size
        FROM (SELECT id, biblioteca_id, {_ROUTE} AS tipo FROM (SELECT id, biblioteca_id, lower(conteudo) AS l, CASE id % 9 WHEN 0 THEN 'a.md' WHEN 1 THEN 'https://pt.wikipedia.org/x' WHEN 2 THEN 'x.WikiText' ELSE '' END AS h0, lower(h0) AS h FROM documento))""",
)
def _(t):
    k = F.col("id") % 9
    hint = F.when(k == 0, "a.md").when(k == 1, "https://pt.wikipedia.org/x").when(k == 2, "x.WikiText").otherwise("")
    routed = t.documento.select("id", "biblioteca_id", C.document_type(F.col("conteudo"), hint).alias("tipo"))
    own = t.library.where("id = 3").select(F.col("id").alias("biblioteca_id"), F.lit(1200).alias("size"))
    return C.with_chunk_size(routed, "tipo", "biblioteca_id", own).select("id", "tipo", "chunk_size")


@query("t8_html_text")
def _(t):
    return t.pages.select("page_id", P.html_text(F.col("html")).alias("text"))


_UNESCAPE = "trim(replace(replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'))"


@query(
    "t9_html_metadata",
    f"""SELECT page_id, {_UNESCAPE.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, regexp_extract(html, '(?is)<meta\\s[^>]*charset=[\"'']?([\\w-]+)', 1) AS charset,
        regexp_extract(html, '(?is)<meta\\s[^>]*name=[\"'']?description[\"'']?[^>]*content=[\"'']([^\"'']*)', 1) AS descricao FROM pages""",
)
def _(t):
    title, about, _, _, charset = P.html_metadata(F.col("html"))
    return t.pages.select("page_id", title, charset, about)


_LINKS = f"""SELECT DISTINCT page_id, {_UNESCAPE.format("regexp_replace(regexp_replace(a, '(?s)<[^>]*>', '', 'g'), '\\s+', ' ', 'g')")} AS texto, regexp_extract(a, '(?is)href=[\"'']([^\"'']*)', 1) AS url
        FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href=[\"''][^\"'']*[\"''][^>]*>.*?</a>')) AS a FROM pages)"""


@query("t10_links", _LINKS)
def _(t):
    return P.links(t.pages, "page_id")


@query("t10b_link_search", f"SELECT * FROM ({_LINKS}) WHERE regexp_matches({FOLD('texto')}, 'de|eau|the')")
def _(t):
    return P.links_with_words(P.links(t.pages, "page_id"), ["de", "éau", "the"])


@query(
    "t11_reference_classes",
    f"""SELECT page_id, url, k || texto AS texto, kind FROM (SELECT *, (['Regulamentação ', 'Vide Decreto ', 'Lei nº ', 'Revogado ', ''])[length(url) % 5 + 1] AS k, {FOLD('k || texto')} AS f,
        CASE WHEN contains(f, 'revogad') THEN 'revoked' WHEN contains(f, 'regulament') THEN 'regulation' WHEN contains(f, 'vide dec') THEN 'vide_decree'
             WHEN contains(f, 'lei ') OR contains(f, 'lei n') OR contains(f, 'decreto') THEN 'other_law' END AS kind FROM ({_LINKS})) WHERE kind <> 'revoked'""",
)
def _(t):
    kinds = F.array(*map(F.lit, ["Regulamentação ", "Vide Decreto ", "Lei nº ", "Revogado ", ""]))
    named = P.links(t.pages, "page_id").withColumn("texto", F.concat(F.get(kinds, (F.length("url") % 5).cast("int")), "texto"))
    return P.classify_references(named)


def statute_texts(t):
    """Statutes derived from documents: lines become headings, articles, paragraphs and items in turn."""

    def line(x, i):
        n = (i / 3 + 1).cast("int").cast("string")
        roman = F.get(F.array(*map(F.lit, ["I", "II", "III", "IV", "V"])), (i % 5).cast("int"))
        return (
            F.when(i % 13 == 0, F.concat(F.lit("TÍTULO "), roman)).when(i % 7 == 1, F.concat(F.lit("CAPÍTULO "), roman)).when(i % 3 == 2, F.concat(F.lit("Art. "), n, F.lit("º "), x))
            .when(i % 3 == 0, F.concat(F.lit("§ 1º "), x, F.lit(":"))).otherwise(F.concat(roman, F.lit(" - "), x))
        )

    return t.documents.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


_STATUTE = """SELECT doc_id, CAST(i AS BIGINT) AS n, CASE WHEN i % 13 = 0 THEN 'TÍTULO ' || r WHEN i % 7 = 1 THEN 'CAPÍTULO ' || r WHEN i % 3 = 2 THEN 'Art. ' || (i // 3 + 1) || 'º ' || x
   WHEN i % 3 = 0 THEN '§ 1º ' || x || ':' ELSE r || ' - ' || x END AS line FROM (SELECT doc_id, i, l[i + 1] AS x, (['I', 'II', 'III', 'IV', 'V'])[i % 5 + 1] AS r FROM
   (SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


@query(
    "t12_statute_lines",
    f"""WITH s AS (SELECT doc_id, n, trim(line) AS line, CASE WHEN line LIKE 'TÍTULO %' THEN 'titulo' WHEN line LIKE 'CAPÍTULO %' THEN 'capitulo' WHEN line LIKE 'Art. %' THEN 'artigo' END AS tag FROM ({_STATUTE})),
        r AS (SELECT *, count(*) FILTER (tag = 'titulo') OVER (PARTITION BY doc_id ORDER BY n) AS run FROM s)
        SELECT doc_id, n, tag, last_value(CASE WHEN tag = 'titulo' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS titulo,
               last_value(CASE WHEN tag = 'capitulo' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY n) AS capitulo,
               CAST(sum(CASE WHEN tag = 'artigo' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS article_seq FROM r""",
)
def _(t):
    rows = L.classified(L.lines_of(statute_texts(t), "doc_id", "text"), "doc_id")
    return rows.select("doc_id", "n", "tag", "titulo", "capitulo", "article_seq")


@query(
    "t12b_articles",
    f"""WITH s AS (SELECT doc_id, n, trim(line) AS line FROM ({_STATUTE})), r AS (SELECT *, sum(CASE WHEN line LIKE 'Art. %' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS seq FROM s)
        SELECT doc_id, CAST(seq AS BIGINT) AS article_seq, CAST(regexp_extract(arg_min(line, n), '^Art\\. (\\d+)', 1) AS INT) AS artigo, string_agg(line, chr(10) ORDER BY n) AS conteudo FROM r
        WHERE seq > 0 AND line NOT LIKE 'TÍTULO %' AND line NOT LIKE 'CAPÍTULO %' GROUP BY doc_id, seq""",
)
def _(t):
    return L.articles(L.lines_of(statute_texts(t), "doc_id", "text"), "doc_id").select("doc_id", "article_seq", "artigo", "conteudo")


@query(
    "t12c_statute_header",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'lei' WHEN 1 THEN 'decreto' ELSE 'lei complementar' END AS tipo, CAST(doc_id + 1000 AS VARCHAR) AS numero,
              make_date(2000 + doc_id % 20, 3, 1 + doc_id % 28) AS data, doc_id % 4 = 0 AS revogado FROM documents WHERE NOT regexp_matches(text, '(?is)revogad[oa]\\s+pel')""",
)
def _(t):
    key = F.col("doc_id")
    kind = F.when(key % 3 == 0, "LEI").when(key % 3 == 1, "DECRETO").otherwise("LEI COMPLEMENTAR")
    number = F.format_number(key + 1000, 0)
    head = F.concat(kind, F.lit(" Nº "), F.translate(number, ",", "."), F.lit(", DE "), (key % 28 + 1).cast("string"), F.lit(" DE MARÇO DE "), (key % 20 + 2000).cast("string"), F.when(key % 4 == 0, "\nRevogada pela Lei 1").otherwise(""))
    plain = t.documents.where(~F.col("text").rlike(r"(?is)revogad[oa]\s+pel"))
    return plain.select("doc_id", *L.statute_header(F.concat(head, F.lit("\n"), "text")))


@query("t13_article_parts")
def _(t):
    return L.article_parts(L.articles(L.lines_of(statute_texts(t), "doc_id", "text"), "doc_id"), ["doc_id", "article_seq"])


@query(
    "t14_article_chapters",
    f"""WITH s AS (SELECT doc_id, n, trim(line) AS line, line LIKE 'Art. %' AS art, line LIKE 'TÍTULO %' AS tit, line LIKE 'CAPÍTULO %' AS cap FROM ({_STATUTE})),
        r AS (SELECT *, sum(CASE WHEN art THEN 1 ELSE 0 END) OVER w AS seq, sum(CASE WHEN tit THEN 1 ELSE 0 END) OVER w AS run, last_value(CASE WHEN tit THEN line END IGNORE NULLS) OVER w AS t FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
        c AS (SELECT *, last_value(CASE WHEN cap THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY n) AS c FROM r),
        a AS (SELECT doc_id, seq, arg_min(coalesce(t, ''), n) AS t, arg_min(coalesce(c, ''), n) AS c, string_agg(line, chr(10) ORDER BY n) AS conteudo FROM c WHERE seq > 0 AND NOT tit AND NOT cap GROUP BY 1, 2)
        SELECT doc_id, doc_id || ' - ' || array_to_string(list_filter([t, c], lambda x: x <> ''), '/') AS titulo, CAST(min(seq) AS BIGINT) AS first_article,
               string_agg(conteudo, chr(10) ORDER BY seq) AS conteudo, substr(string_agg(conteudo, chr(10) ORDER BY seq), 1, 2048) AS representativo FROM a GROUP BY doc_id, t, c""",
)
def _(t):
    return L.article_chapters(L.articles(L.lines_of(statute_texts(t), "doc_id", "text"), "doc_id"), "doc_id", "doc_id")


@query("t15_legal_headings", f"SELECT doc_id, n, CASE WHEN line LIKE 'TÍTULO %' THEN 'titulo' WHEN line LIKE 'CAPÍTULO %' THEN 'capitulo' ELSE 'artigo' END AS tag, CASE WHEN line LIKE 'TÍTULO %' THEN 2 WHEN line LIKE 'CAPÍTULO %' THEN 3 ELSE 6 END AS level FROM ({_STATUTE}) WHERE line LIKE 'TÍTULO %' OR line LIKE 'CAPÍTULO %' OR line LIKE 'Art. %'")
def _(t):
    name, level = L.level_of(F.col("line"))
    return L.lines_of(statute_texts(t), "doc_id", "text").select("doc_id", "n", name.alias("tag"), level.alias("level")).where("tag IS NOT NULL")


@query(
    "t16_embedding_plan",
    f"""SELECT id, CASE WHEN k <= 2000 THEN 'capitulo' ELSE 'trecho' END AS level, CASE WHEN k <= 2000 THEN titulo ELSE titulo || ' - Chunk 1' END AS first_title, CAST(1 AS BIGINT) AS first_order,
               trim(regexp_replace(CASE WHEN k <= 512 THEN titulo || chr(10) || conteudo ELSE conteudo END, '\\s+', ' ', 'g')) AS text
        FROM (SELECT *, floor({WC('conteudo')} / 0.75) AS k FROM chapter WHERE trim(conteudo) <> '')""",
)
def _(t):
    """All rows of the plan: the chunks of a chapter are put together again, in their order."""
    plan = C.embedding_plan(t.chapter, ["id"], "titulo", "conteudo", r"\n")
    parts = F.array_sort(F.collect_list(F.struct("order_chapter", "title", "text")))
    whole = plan.groupBy("id", "level").agg(parts.alias("p"))
    text = F.trim(F.regexp_replace(F.array_join("p.text", "\n"), r"\s+", " "))
    return whole.select("id", "level", F.get("p", F.lit(0))["title"].alias("first_title"), F.get("p", F.lit(0))["order_chapter"].alias("first_order"), text.alias("text"))


@query(
    "t16b_embedding_plan_chunks",
    f"""SELECT doc_id, CASE WHEN k <= 400 THEN 'capitulo' ELSE 'trecho' END AS level, words FROM (SELECT doc_id, {WC('text')} AS words, floor({WC('text')} / 0.75) AS k FROM documents WHERE trim(text) <> '')""",
)
def _(t):
    plan = C.embedding_plan(t.documents.withColumn("titulo", F.lit("")), ["doc_id"], "titulo", "text", r"\n", small=100, medium=400)
    return plan.groupBy("doc_id", "level").agg(F.sum(X.word_count(F.col("text"))).alias("words"))


@query(
    "t16c_embedding_modes",
    """SELECT id, m AS mode, CASE m WHEN 'metadata' THEN 'metadados' ELSE 'capitulo' END AS level, CASE m WHEN 'full' THEN titulo || chr(10) || conteudo WHEN 'metadata' THEN titulo ELSE conteudo END AS text
       FROM chapter, (VALUES ('full'), ('metadata'), ('text')) v(m) WHERE trim(conteudo) <> ''""",
)
def _(t):
    plan = lambda mode: C.embedding_plan(t.chapter, ["id"], "titulo", "conteudo", r"\n", mode=mode).select("id", F.lit(mode).alias("mode"), "level", "text")
    return plan("full").union(plan("metadata")).union(plan("text"))


@query("t16d_embedding_split", f"SELECT id, {WC('conteudo')} AS words FROM chapter WHERE trim(conteudo) <> ''")
def _(t):
    plan = C.embedding_plan(t.chapter, ["id"], "titulo", "conteudo", r"\n", mode="split")
    return plan.groupBy("id").agg(F.sum(X.word_count(F.col("text"))).alias("words"))


@query(
    "t17_hash_vectors",
    f"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex({FOLD('text')}, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) AS w FROM documents),
        c AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS dim, count(*) AS n FROM w GROUP BY ALL)
        SELECT doc_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM c""",
)
def _(t):
    return C.hash_features(t.documents, ["doc_id"], "text").select("doc_id", "dim", F.round("value", 6).alias("value"))


@query("t17b_vectors")
def _(t):
    return C.embed(t.documents, ["doc_id"], "text")


def hashing_model():
    """The same vectors by numpy, as a caller's model over folded texts."""
    import re
    from hashlib import md5

    import numpy as np

    # Letters, digits and the underscore, as the words of folded texts have them.
    word = re.compile(r"\w+")

    def vectors(texts):
        out = np.zeros((len(texts), 64), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in word.findall(str(text)):
                row[int(md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return vectors


@query(
    "t17c_model_vectors",
    f"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex({FOLD('text')}, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) AS w FROM documents),
        c AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS dim, count(*) AS n FROM w GROUP BY ALL)
        SELECT doc_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 4) AS value FROM c""",
)
def _(t):
    """A model in Python tasks, loaded once in each and given MODEL_BATCH texts at a time."""
    python_path(t.spark)
    made = C.embed(t.documents.select("doc_id", X.fold(F.col("text")).alias("text")), ["doc_id"], "text", C.model_function(hashing_model))
    cells = made.select("doc_id", F.posexplode("vector").alias("dim", "value")).where("value > 0")
    return cells.select("doc_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), 4).alias("value"))


def summary_sql(most: int) -> str:
    """summary of each text of documents, as SQL: kept is the number of leading sentences of most / 4 words together."""
    kept = f"len(list_filter(range(1, len(p) + 1), lambda i: list_sum(list_transform(p[1:i], lambda s: {WC('s')})) <= {most // 4}))"
    made = f"trim(CASE WHEN kept > 0 THEN array_to_string(p[1:kept], '. ') ELSE substr(text, 1, {most}) END)"
    return f"""SELECT doc_id, text, CASE WHEN regexp_matches(made, '[.!?]$') THEN made ELSE made || '...' END AS summary FROM (SELECT doc_id, text, {made} AS made FROM (SELECT *, {kept} AS kept FROM
      (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: trim(s)), lambda s: s <> '')[1:{most // 4 + 1}] AS p FROM documents)))"""


@query("t18_extractive_summary", f"SELECT doc_id, summary FROM ({summary_sql(400)})")
def _(t):
    return t.documents.select("doc_id", C.extractive_summary(F.col("text"), 400).alias("summary"))


@query(
    "t19_question_answers",
    """WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: trim(x)), lambda x: length(x) > 20)[1:3] AS p FROM documents)
       SELECT doc_id, n, CASE WHEN contains(l, 'é') OR contains(l, 'são') THEN 'O que ' || substr(l, 1, 50) WHEN contains(l, 'quando') THEN 'Quando ' || substr(substr(l, 1, 50), strpos(l, 'quando') + 6)
              WHEN contains(l, 'como') THEN 'Como ' || substr(substr(l, 1, 50), strpos(l, 'como') + 4) WHEN contains(l, 'onde') THEN 'Onde ' || substr(substr(l, 1, 50), strpos(l, 'onde') + 4)
              ELSE 'Sobre ' || substr(l, 1, 30) END || '?' AS question, answer
       FROM (SELECT doc_id, n, p[n] AS answer, lower(p[n]) AS l FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS n FROM s))
       UNION ALL SELECT doc_id, len(p) + 1, 'Qual é o resumo do documento?', summary FROM s JOIN (""" + summary_sql(200) + """) USING (doc_id) WHERE len(p) < 3""",
)
def _(t):
    return C.question_answer_pairs(t.documents, ["doc_id"], "text")


@query(
    "t20_summary_rows",
    f"""WITH s AS (SELECT doc_id, text AS t, summary, round(length(summary) / length(text), 6) AS ratio FROM ({summary_sql(800)}) WHERE floor({WC('text')} / 0.75) > 256)
        SELECT doc_id, 'resumo' AS kind, summary AS text, ratio FROM s
        UNION ALL SELECT doc_id, 'resumo_contexto', substr(t, 1, 40) || chr(10) || summary || chr(10) || substr(t, 1, 200), ratio FROM s WHERE length(t) > 4000""",
)
def _(t):
    return C.summary_rows(t.documents.withColumn("titulo", F.substring("text", 1, 40)), ["doc_id"], "titulo", "text", least_tokens=256)


@query(
    "t21_chapter_metadata",
    f"""SELECT c.id, d.titulo AS documento, l.nome AS biblioteca, length(c.conteudo) AS character_count, {WC('c.conteudo')} AS word_count FROM chapter c JOIN documento d ON d.id = c.documento_id
        LEFT JOIN library l ON l.id = d.biblioteca_id""",
)
def _(t):
    docs = t.documento.select(F.col("id").alias("documento_id"), F.col("titulo").alias("documento"), "biblioteca_id")
    libs = t.library.select(F.col("id").alias("biblioteca_id"), F.col("nome").alias("biblioteca"))
    rows = t.chapter.join(docs, "documento_id").join(F.broadcast(libs), "biblioteca_id", "left")
    return rows.select("id", "documento", "biblioteca", F.length("conteudo").cast("long").alias("character_count"), X.word_count(F.col("conteudo")).alias("word_count"))


@query(
    "t22_heuristic_metadata",
    f"SELECT doc_id, substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], 1, 100) AS title, {WC('text')} AS words, length(text) AS chars FROM documents",
)
def _(t):
    first = F.get(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    return t.documents.select("doc_id", F.left(first, F.lit(100)).alias("title"), X.word_count(F.col("text")).alias("words"), F.length("text").cast("long").alias("chars"))


@query("t23_checksum_dedup", f"SELECT min(doc_id) AS doc_id, md5({_NORM}) AS checksum, count(*) AS copies FROM documents GROUP BY 2")
def _(t):
    key = F.md5(F.encode(X.normal_form(F.col("text")), "UTF-8"))
    return t.documents.groupBy(key.alias("checksum")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("t24_header_tables")
def _(t):
    summary, urls = P.header_table(F.concat(F.lit("<table></table><table><tr><td>"), "html", F.lit("</td></tr></table>")))
    return t.pages.select("page_id", summary, F.size(urls).alias("n_urls"))
