"""Lookups, joins, aggregates, windows and sorts over the collection's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackroom.functions.text import token_estimate, truncate
from stackroom.operators import relational as R
from stackroom.plans.registry import query

N = lambda e="*": F.count(e)
EXPIRY = "2025-01-01"


# --- predicates -----------------------------------------------------------------------------------------------------


@query("p1_keyed_lookup", "SELECT id, nome, email FROM app_user WHERE id = 7")
def _(t):
    return t.app_user.where(F.col("id") == 7).select("id", "nome", "email")


@query("p2_equals_ignoring_case", "SELECT id, nome FROM library WHERE lower(nome) = lower('EuRoPe')")
def _(t):
    return t.library.where(R.equals_ignoring_case("nome", "EuRoPe")).select("id", "nome")


@query("p3_contains_ignoring_case", "SELECT id, titulo FROM documento WHERE lower(titulo) LIKE '%the %'")
def _(t):
    return t.documento.where(R.contains_ignoring_case("titulo", "The ")).select("id", "titulo")


@query("p4_status_filter", "SELECT id, nome FROM client WHERE ativo AND id % 13 <> 0")
def _(t):
    clients = t.client.withColumn("deleted_at", F.when(F.col("id") % 13 == 0, F.lit("2024-06-01").cast("timestamp")))
    return R.active(clients).where("ativo").select("id", "nome")


@query("p5_date_range", "SELECT id, data_publicacao FROM documento WHERE data_publicacao BETWEEN DATE '2024-03-01' AND DATE '2024-04-30'")
def _(t):
    return t.documento.where(F.col("data_publicacao").between("2024-03-01", "2024-04-30")).select("id", "data_publicacao")


@query(
    "p6_token_range",
    """SELECT id, CAST(ceil(len(regexp_extract_all(conteudo, '\\S+')) / 0.75) AS BIGINT) AS tokens FROM documento
       WHERE ceil(len(regexp_extract_all(conteudo, '\\S+')) / 0.75) BETWEEN 100 AND 400""",
)
def _(t):
    return t.documento.select("id", token_estimate(F.col("conteudo")).alias("tokens")).where(F.col("tokens").between(100, 400)).orderBy(F.desc("tokens"), "id")


@query("p7_interval_stab", "SELECT id, documento_id, ordem FROM chapter WHERE token_inicio <= 120 AND 120 < token_fim")
def _(t):
    return t.chapter.where((F.col("token_inicio") <= 120) & (F.lit(120) < F.col("token_fim"))).select("id", "documento_id", "ordem")


@query("p8_interval_containment", "SELECT id, documento_id, ordem FROM chapter WHERE token_inicio <= 100 AND token_fim >= 130")
def _(t):
    return t.chapter.where("token_inicio <= 100 AND token_fim >= 130").select("id", "documento_id", "ordem")


@query("p9_missing_response", "SELECT chat_id, turn FROM chat_message WHERE response IS NULL OR response = ''")
def _(t):
    return t.chat_message.where(R.blank("response")).select("chat_id", "turn")


@query("p10_json_containment", "SELECT id FROM documento WHERE json_extract_string(metadados, '$.lang') = 'de' AND json_extract_string(metadados, '$.source') = 'src3'")
def _(t):
    return t.documento.where(R.json_contains("metadados", {"lang": "de", "source": "src3"})).select("id")


@query("p11_json_key", "SELECT event_id, list_contains(json_keys(props), 'k') AS has_k FROM events")
def _(t):
    return t.events.select("event_id", R.json_has_key("props", "k").alias("has_k"))


@query("p12_json_path", "SELECT id, json_extract_string(metadados, '$.source') AS fonte FROM documento WHERE json_extract_string(metadados, '$.lang') = 'fr'")
def _(t):
    return t.documento.where(F.get_json_object("metadados", "$.lang") == "fr").select("id", F.get_json_object("metadados", "$.source").alias("fonte"))


@query("p13_batch_fetch", "SELECT id, titulo FROM documento WHERE id IN (SELECT item_id * 3 FROM benchmark)")
def _(t):
    wanted = t.benchmark.select((F.col("item_id") * 3).alias("id"))
    return t.documento.join(wanted, "id", "left_semi").select("id", "titulo")


@query("p14_expired_keys", f"SELECT id, api_key_expires_at FROM client WHERE api_key_expires_at < DATE '{EXPIRY}'")
def _(t):
    return t.client.where(F.col("api_key_expires_at") < F.lit(EXPIRY).cast("date")).select("id", "api_key_expires_at")


@query("p15_ordinal_range", "SELECT chat_id, ordem, mensagem FROM chat_message WHERE ordem BETWEEN 2 AND 3")
def _(t):
    return t.chat_message.where(F.col("ordem").between(2, 3)).select("chat_id", "ordem", "mensagem")


@query("p16_existence", "SELECT id, EXISTS (SELECT 1 FROM user_library ul WHERE ul.user_id = app_user.id) AS tem_biblioteca FROM app_user")
def _(t):
    linked = t.user_library.select(F.col("user_id").alias("id"))
    return R.with_exists(t.app_user.select("id"), linked, "id", "tem_biblioteca")


@query("p17_inline_image", "SELECT page_id, contains(html, 'data:image') AS tem_imagem FROM pages")
def _(t):
    return t.pages.select("page_id", F.col("html").contains("data:image").alias("tem_imagem"))


@query(
    "p18_row_rules",
    """SELECT 'weights sum to 1' AS rule, CAST(id AS VARCHAR) AS key FROM library WHERE abs(peso_semantico + peso_textual - 1) > 0.01
       UNION ALL SELECT 'token range', CAST(id AS VARCHAR) FROM chapter WHERE token_fim < token_inicio
       UNION ALL SELECT 'text of 100 characters', CAST(id AS VARCHAR) FROM documento WHERE length(conteudo) < 100
       UNION ALL SELECT 'title of 3 to 500', CAST(id AS VARCHAR) FROM documento WHERE length(titulo) NOT BETWEEN 3 AND 500
       UNION ALL SELECT 'chunk has order', CAST(id AS VARCHAR) FROM doc_embedding WHERE tipo_embedding = 'trecho' AND order_chapter IS NULL
       UNION ALL SELECT 'url', CAST(page_id AS VARCHAR) FROM pages WHERE NOT regexp_matches(url, '^https?://[^/?#]+\\.[a-z]+')""",
)
def _(t):
    rules = [
        (t.library, "weights sum to 1", "id", F.abs(F.col("peso_semantico") + F.col("peso_textual") - 1) > 0.01),
        (t.chapter, "token range", "id", F.col("token_fim") < F.col("token_inicio")),
        (t.documento, "text of 100 characters", "id", F.length("conteudo") < 100),
        (t.documento, "title of 3 to 500", "id", ~F.length("titulo").between(3, 500)),
        (t.doc_embedding, "chunk has order", "id", (F.col("tipo_embedding") == "trecho") & F.col("order_chapter").isNull()),
        (t.pages, "url", "page_id", ~F.col("url").rlike(r"^https?://[^/?#]+\.[a-z]+")),
    ]
    out = None
    for df, rule, key, wrong in rules:
        one = R.violations(df, rule, F.col(key), wrong)
        out = one if out is None else out.union(one)
    return out


@query(
    "p19_query_validation",
    """SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'blank' WHEN length(trim(text)) < 2 THEN 'too short' WHEN length(text) > 500 THEN 'too long'
              WHEN regexp_matches(text, '\\b(AND|OR|NOT)\\b') THEN 'boolean keyword' END AS reject_reason FROM conversations WHERE role = 'user'""",
)
def _(t):
    return t.conversations.where("role = 'user'").select("conv_id", "turn", R.reject_reason(F.col("text")).alias("reject_reason"))


@query(
    "p20_constraint_audit",
    """SELECT 'document and ordinal' AS rule, concat_ws('/', documento_id, ordem) AS key FROM chapter GROUP BY documento_id, ordem HAVING count(*) > 1
       UNION ALL SELECT 'email', email FROM app_user GROUP BY email HAVING count(*) > 1
       UNION ALL SELECT 'user of association', CAST(user_id AS VARCHAR) FROM (SELECT DISTINCT user_id FROM user_library WHERE user_id NOT IN (SELECT id FROM app_user WHERE id % 17 <> 0))
       UNION ALL SELECT 'document of embedding', CAST(documento_id AS VARCHAR) FROM (SELECT DISTINCT documento_id FROM doc_embedding WHERE documento_id NOT IN (SELECT id FROM documento WHERE flag_vigente))""",
)
def _(t):
    return (
        R.duplicate_keys(t.chapter, "document and ordinal", ["documento_id", "ordem"])
        .union(R.duplicate_keys(t.app_user, "email", ["email"]))
        .union(R.orphans(t.user_library, "user of association", "user_id", t.app_user.where("id % 17 <> 0")))
        .union(R.orphans(t.doc_embedding, "document of embedding", "documento_id", t.documento.where("flag_vigente")))
    )


# --- joins ----------------------------------------------------------------------------------------------------------


@query("j1_libraries_of_user", "SELECT ul.user_id, l.id AS library_id, l.nome FROM user_library ul JOIN library l ON l.id = ul.library_id")
def _(t):
    return t.user_library.join(t.library.select(F.col("id").alias("library_id"), "nome"), "library_id").select("user_id", "library_id", "nome")


@query(
    "j2_library_user_names",
    "SELECT l.nome AS biblioteca, u.nome AS usuario, ul.tipo_associacao FROM library l JOIN user_library ul ON ul.library_id = l.id JOIN app_user u ON u.id = ul.user_id",
)
def _(t):
    ul, users = t.user_library, t.app_user.select(F.col("id").alias("user_id"), F.col("nome").alias("usuario"))
    return ul.join(t.library.select(F.col("id").alias("library_id"), F.col("nome").alias("biblioteca")), "library_id").join(users, "user_id").select("biblioteca", "usuario", "tipo_associacao")


@query("j3_docs_without_vectors", "SELECT id FROM documento WHERE flag_vigente AND id NOT IN (SELECT documento_id FROM doc_embedding)")
def _(t):
    return t.documento.where("flag_vigente").select("id").join(t.doc_embedding.select(F.col("documento_id").alias("id")), "id", "left_anti")


@query(
    "j4_chapter_gaps",
    "SELECT documento_id, ordem FROM chapter c WHERE ordem > 1 AND NOT EXISTS (SELECT 1 FROM chapter p WHERE p.documento_id = c.documento_id AND p.ordem = c.ordem - 1)",
)
def _(t):
    return R.gaps(t.chapter.select("documento_id", "ordem"), "documento_id", "ordem")


@query(
    "j5_either_side_fusion",
    """SELECT coalesce(s.documento_id, c.documento_id) AS documento_id, coalesce(s.n, 0) AS vetores, coalesce(c.n, 0) AS capitulos
       FROM (SELECT documento_id, count(*) AS n FROM doc_embedding WHERE library_id = 1 GROUP BY 1) s
       FULL JOIN (SELECT documento_id, count(*) AS n FROM chapter WHERE ordem > 2 GROUP BY 1) c ON s.documento_id = c.documento_id""",
)
def _(t):
    s = t.doc_embedding.where("library_id = 1").groupBy("documento_id").agg(N().alias("vetores"))
    c = t.chapter.where("ordem > 2").groupBy("documento_id").agg(N().alias("capitulos"))
    return s.join(c, "documento_id", "full").na.fill(0, ["vetores", "capitulos"])


@query(
    "j6_title_enrichment",
    """SELECT e.id, d.titulo AS titulo_documento, c.titulo AS titulo_capitulo FROM doc_embedding e LEFT JOIN documento d ON d.id = e.documento_id
       LEFT JOIN chapter c ON c.documento_id = e.documento_id AND c.ordem = e.order_chapter""",
)
def _(t):
    from stackroom.operators.search import enrich

    return enrich(t.doc_embedding.select("id", "documento_id", "order_chapter"), t.documento, t.chapter).select("id", "titulo_documento", "titulo_capitulo")


@query(
    "j7_range_join",
    """SELECT p.documento_id, p.at, c.ordem FROM (SELECT doc_id AS documento_id, n_chars % 300 AS at FROM documents) p
       JOIN chapter c ON c.documento_id = p.documento_id AND c.token_inicio <= p.at AND p.at < c.token_fim""",
)
def _(t):
    points = t.documents.select(F.col("doc_id").alias("documento_id"), (F.col("n_chars") % 300).alias("at"))
    return R.range_join_dyadic(points, "at", t.chapter.select("documento_id", "ordem", "token_inicio", "token_fim"), "token_inicio", "token_fim", "documento_id").select("documento_id", "at", "ordem")


@query("j7b_range_join_bucketed", "SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice >= p_retailprice * 20 AND o_totalprice < p_retailprice * 20 + 40")
def _(t):
    price = F.col("p_retailprice") * 20
    intervals = t.part.select("p_partkey", price.alias("lo"), (price + 40).alias("hi"))
    return R.range_join_dyadic(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", intervals, "lo", "hi", width=40).select("o_orderkey", "p_partkey")


@query(
    "j7c_range_join_of_all_lengths",
    """SELECT o_orderkey, p_partkey FROM (SELECT o_orderkey, o_orderkey * 7919 % 1000000007 AS spot FROM orders) JOIN
       (SELECT p_partkey, p_partkey * 7907 % 1000003 AS lo, CASE WHEN p_partkey % 500 = 0 THEN 1000000000 WHEN p_partkey % 50 = 0 THEN 1000000 WHEN p_partkey % 7 = 0 THEN 1000 ELSE 1 END AS length FROM part)
       ON spot >= lo AND spot < lo + length""",
)
def _(t):
    """Intervals of 1 to 10**9 positions in one table."""
    key = F.col("p_partkey")
    length = F.when(key % 500 == 0, 1_000_000_000).when(key % 50 == 0, 1_000_000).when(key % 7 == 0, 1000).otherwise(1)
    intervals = t.part.select("p_partkey", (key * 7907 % 1_000_003).alias("lo")).withColumn("hi", F.col("lo") + length)
    points = t.orders.select("o_orderkey", (F.col("o_orderkey") * 7919 % 1_000_000_007).alias("spot"))
    return R.range_join_dyadic(points, "spot", intervals, "lo", "hi").select("o_orderkey", "p_partkey")


@query(
    "j8_chapters_of_current",
    "SELECT c.documento_id, c.ordem, c.titulo FROM chapter c JOIN documento d ON d.id = c.documento_id WHERE d.flag_vigente AND d.biblioteca_id = 2",
)
def _(t):
    docs = t.documento.where("flag_vigente AND biblioteca_id = 2").select(F.col("id").alias("documento_id"))
    return t.chapter.join(docs, "documento_id").select("documento_id", "ordem", "titulo").orderBy("documento_id", "ordem")


@query(
    "j9_associations",
    """SELECT user_id, count(*) AS bibliotecas, string_agg(library_id || ':' || tipo_associacao, ',' ORDER BY library_id) AS papeis,
              count(*) FILTER (tipo_associacao = 'proprietario') AS proprias FROM user_library GROUP BY user_id""",
)
def _(t):
    roles = F.array_sort(F.collect_list(F.struct("library_id", "tipo_associacao")))
    grouped = t.user_library.groupBy("user_id").agg(N().alias("bibliotecas"), roles.alias("r"), F.count_if(F.col("tipo_associacao") == "proprietario").alias("proprias"))
    return grouped.select("user_id", "bibliotecas", F.array_join(F.transform("r", lambda x: F.concat(x["library_id"].cast("string"), F.lit(":"), x["tipo_associacao"])), ",").alias("papeis"), "proprias")


@query(
    "j10_project_chats",
    """SELECT p.project_id, c.id AS chat_id, c.titulo FROM (SELECT user_id AS project_id, unnest(list_append(list_filter(list(id), lambda x: x % 4 <> 0), CAST(1 AS BIGINT))) AS chat_id
         FROM chat GROUP BY user_id) p JOIN chat c ON c.id = p.chat_id""",
)
def _(t):
    projects = t.chat.groupBy(F.col("user_id").alias("project_id")).agg(F.collect_list("id").alias("ids"))
    kept = projects.select("project_id", F.concat(F.filter("ids", lambda x: x % 4 != 0), F.array(F.lit(1).cast("long"))).alias("ids"))
    return kept.select("project_id", F.explode("ids").alias("chat_id")).join(t.chat.select(F.col("id").alias("chat_id"), "titulo"), "chat_id").select("project_id", "chat_id", "titulo")


@query("j11_private_library", "SELECT c.id AS chat_id, l.nome AS biblioteca FROM chat c LEFT JOIN library l ON l.id = c.user_id % 7")
def _(t):
    libs = t.library.select(F.col("id").alias("lib"), F.col("nome").alias("biblioteca"))
    return t.chat.withColumn("lib", F.col("user_id") % 7).join(libs, "lib", "left").select(F.col("id").alias("chat_id"), "biblioteca")


# --- aggregates -----------------------------------------------------------------------------------------------------


@query("a1_libraries_by_area", "SELECT area_conhecimento, count(*) AS n FROM library GROUP BY 1")
def _(t):
    return t.library.groupBy("area_conhecimento").agg(N().alias("n")).orderBy(F.desc("n"), "area_conhecimento")


_TOK = "CAST(ceil(len(regexp_extract_all(conteudo, '\\S+')) / 0.75) AS BIGINT)"


@query(
    "a2_tokens_per_library",
    f"SELECT biblioteca_id, CAST(sum(k) AS BIGINT) AS total, round(avg(k), 6) AS media, max(k) AS maximo, min(k) AS minimo FROM (SELECT biblioteca_id, {_TOK} AS k FROM documento WHERE flag_vigente) GROUP BY 1",
)
def _(t):
    k = t.documento.where("flag_vigente").select("biblioteca_id", token_estimate(F.col("conteudo")).alias("k"))
    return k.groupBy("biblioteca_id").agg(F.sum("k").alias("total"), F.round(F.avg("k"), 6).alias("media"), F.max("k").alias("maximo"), F.min("k").alias("minimo"))


@query(
    "a3_chapter_spans",
    "SELECT documento_id, CAST(sum(token_fim - token_inicio) AS BIGINT) AS total, round(avg(token_fim - token_inicio), 6) AS media, max(token_fim - token_inicio) AS maximo, min(token_fim - token_inicio) AS minimo FROM chapter GROUP BY 1",
)
def _(t):
    k = t.chapter.select("documento_id", (F.col("token_fim") - F.col("token_inicio")).alias("k"))
    return k.groupBy("documento_id").agg(F.sum("k").alias("total"), F.round(F.avg("k"), 6).alias("media"), F.max("k").alias("maximo"), F.min("k").alias("minimo"))


@query(
    "a4_counts",
    """SELECT 'vigentes' AS o_que, CAST(biblioteca_id AS VARCHAR) AS chave, count(*) AS n FROM documento WHERE flag_vigente GROUP BY 2
       UNION ALL SELECT 'chats', CAST(user_id AS VARCHAR), count(*) FROM chat GROUP BY 2
       UNION ALL SELECT 'usuarios', CAST(library_id AS VARCHAR), count(DISTINCT user_id) FROM user_library GROUP BY 2
       UNION ALL SELECT 'clientes', 'ativos', count(*) FROM client WHERE ativo""",
)
def _(t):
    one = lambda df, name, key, n: df.groupBy(F.col(key).cast("string").alias("chave")).agg(n.alias("n")).select(F.lit(name).alias("o_que"), "chave", "n")
    active = t.client.where("ativo").agg(N().alias("n")).select(F.lit("clientes").alias("o_que"), F.lit("ativos").alias("chave"), "n")
    return (
        one(t.documento.where("flag_vigente"), "vigentes", "biblioteca_id", N())
        .union(one(t.chat, "chats", "user_id", N())).union(one(t.user_library, "usuarios", "library_id", F.countDistinct("user_id"))).union(active)
    )


@query("a5_next_ordinal", "SELECT d.id, coalesce(max(c.ordem), 0) + 1 AS next_ordinal FROM documento d LEFT JOIN chapter c ON c.documento_id = d.id GROUP BY d.id")
def _(t):
    return R.next_ordinal(t.documento, "id", t.chapter, "documento_id", "ordem")


@query("a6_distinct_sorted", "SELECT DISTINCT lang, biblioteca_id FROM documento")
def _(t):
    return t.documento.select("lang", "biblioteca_id").distinct().orderBy("lang", "biblioteca_id")


@query(
    "a7_library_statistics",
    f"""SELECT l.id, coalesce(u.n, 0) AS usuarios, coalesce(d.n, 0) AS documentos, coalesce(d.k, 0) AS tokens, coalesce(e.n, 0) AS embeddings FROM library l
        LEFT JOIN (SELECT library_id, count(DISTINCT user_id) AS n FROM user_library GROUP BY 1) u ON u.library_id = l.id
        LEFT JOIN (SELECT biblioteca_id, count(*) AS n, CAST(sum({_TOK}) AS BIGINT) AS k FROM documento GROUP BY 1) d ON d.biblioteca_id = l.id
        LEFT JOIN (SELECT library_id, count(*) AS n FROM doc_embedding GROUP BY 1) e ON e.library_id = l.id""",
)
def _(t):
    users = t.user_library.groupBy(F.col("library_id").alias("id")).agg(F.countDistinct("user_id").alias("usuarios"))
    docs = t.documento.groupBy(F.col("biblioteca_id").alias("id")).agg(N().alias("documentos"), F.sum(token_estimate(F.col("conteudo"))).alias("tokens"))
    vecs = t.doc_embedding.groupBy(F.col("library_id").alias("id")).agg(N().alias("embeddings"))
    return t.library.select("id").join(users, "id", "left").join(docs, "id", "left").join(vecs, "id", "left").na.fill(0)


@query(
    "a8_conversation_summary",
    """SELECT chat_id, count(*) AS total, count(response) AS com_resposta, count(*) - count(response) AS sem_resposta, arg_min(mensagem, ordem) AS primeira,
              arg_max(mensagem, ordem) AS ultima, round(count(response) / count(*), 6) AS taxa FROM chat_message GROUP BY 1""",
)
def _(t):
    return t.chat_message.groupBy("chat_id").agg(
        N().alias("total"), N("response").alias("com_resposta"), (N() - N("response")).alias("sem_resposta"), F.min_by("mensagem", "ordem").alias("primeira"),
        F.max_by("mensagem", "ordem").alias("ultima"), F.round(N("response") / N(), 6).alias("taxa"),
    )


@query(
    "a9_auto_summary",
    """SELECT chat_id, concat(CASE WHEN length(m) > 100 THEN substr(m, 1, 100) || '...' ELSE m END, ' (', CAST(n AS VARCHAR), ' mensagens)') AS resumo
       FROM (SELECT chat_id, arg_min(mensagem, ordem) AS m, count(*) AS n FROM chat_message GROUP BY 1)""",
)
def _(t):
    g = t.chat_message.groupBy("chat_id").agg(F.min_by("mensagem", "ordem").alias("m"), N().alias("n"))
    return g.select("chat_id", F.concat(truncate(F.col("m"), 100), F.lit(" ("), F.col("n").cast("string"), F.lit(" mensagens)")).alias("resumo"))


@query(
    "a10_hierarchy_statistics",
    """SELECT d.id, coalesce(c.n, 0) AS capitulos, coalesce(e.documento, 0) AS documento, coalesce(e.trecho, 0) AS trecho, coalesce(c.chars, 0) AS caracteres FROM documento d
       LEFT JOIN (SELECT documento_id, count(*) AS n, CAST(sum(length(conteudo)) AS BIGINT) AS chars FROM chapter GROUP BY 1) c ON c.documento_id = d.id
       LEFT JOIN (SELECT documento_id, count(*) FILTER (tipo_embedding = 'documento') AS documento, count(*) FILTER (tipo_embedding = 'trecho') AS trecho FROM doc_embedding GROUP BY 1) e
         ON e.documento_id = d.id""",
)
def _(t):
    c = t.chapter.groupBy(F.col("documento_id").alias("id")).agg(N().alias("capitulos"), F.sum(F.length("conteudo")).alias("caracteres"))
    e = t.doc_embedding.groupBy(F.col("documento_id").alias("id")).pivot("tipo_embedding", ["documento", "trecho"]).count()
    return t.documento.select("id").join(c, "id", "left").join(e, "id", "left").na.fill(0)


@query("a11_document_tokens", "SELECT documento_id, CAST(sum(token_fim - token_inicio) AS BIGINT) AS tokens FROM chapter GROUP BY 1")
def _(t):
    return t.chapter.groupBy("documento_id").agg(F.sum(F.col("token_fim") - F.col("token_inicio")).alias("tokens"))


@query(
    "a12_dimension_profile",
    "SELECT library_id, tipo_embedding, count(embedding_vector) AS com_vetor, CAST(min(len(embedding_vector)) AS BIGINT) AS menor, CAST(max(len(embedding_vector)) AS BIGINT) AS maior FROM doc_embedding GROUP BY 1, 2",
)
def _(t):
    size = F.size("embedding_vector").cast("long")
    return t.doc_embedding.groupBy("library_id", "tipo_embedding").agg(N("embedding_vector").alias("com_vetor"), F.min(size).alias("menor"), F.max(size).alias("maior"))


@query(
    "a13_processing_status",
    """SELECT d.id, coalesce(c.n, 0) AS capitulos, coalesce(e.n, 0) AS trechos,
              CASE WHEN c.n IS NULL THEN 'NOT_STARTED' WHEN e.n IS NULL THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM documento d
       LEFT JOIN (SELECT documento_id, count(*) AS n FROM chapter GROUP BY 1) c ON c.documento_id = d.id
       LEFT JOIN (SELECT documento_id, count(*) AS n FROM doc_embedding WHERE tipo_embedding = 'trecho' GROUP BY 1) e ON e.documento_id = d.id""",
)
def _(t):
    c = t.chapter.groupBy(F.col("documento_id").alias("id")).agg(N().alias("c"))
    e = t.doc_embedding.where("tipo_embedding = 'trecho'").groupBy(F.col("documento_id").alias("id")).agg(N().alias("e"))
    status = F.when(F.col("c").isNull(), "NOT_STARTED").when(F.col("e").isNull(), "FAILED").otherwise("COMPLETED")
    rows = t.documento.select("id").join(c, "id", "left").join(e, "id", "left")
    return rows.select("id", F.coalesce("c", F.lit(0)).alias("capitulos"), F.coalesce("e", F.lit(0)).alias("trechos"), status.alias("status"))


# --- windows --------------------------------------------------------------------------------------------------------


@query(
    "w3_neighbour_chapters",
    "SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM chapter WINDOW w AS (PARTITION BY documento_id ORDER BY ordem)",
)
def _(t):
    return R.neighbours(t.chapter.select("documento_id", "ordem", "id"), "documento_id", "ordem", "id").select("id", "previous_id", "next_id")


@query("w4_first_last", "SELECT documento_id, arg_min(titulo, ordem) AS primeiro, arg_max(titulo, ordem) AS ultimo FROM chapter GROUP BY 1")
def _(t):
    return t.chapter.groupBy("documento_id").agg(F.min_by("titulo", "ordem").alias("primeiro"), F.max_by("titulo", "ordem").alias("ultimo"))


@query("w5_recent_per_user", "SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS n FROM chat) WHERE n <= 2")
def _(t):
    return R.latest_per(t.chat, "user_id", [F.desc("id")], 2).select("user_id", "id")


@query(
    "w6_context_window",
    """SELECT chat_id, ordem, string_agg(m, '|') AS contexto FROM (SELECT a.chat_id, a.ordem, b.ordem AS o, b.mensagem AS m FROM chat_message a
       JOIN chat_message b ON a.chat_id = b.chat_id AND b.ordem BETWEEN a.ordem - 1 AND a.ordem + 1 ORDER BY 1, 2, 3) GROUP BY ALL""".replace("string_agg(m, '|')", "string_agg(m, '|' ORDER BY o)"),
)
def _(t):
    rows = t.chat_message.select("chat_id", "ordem", F.col("mensagem").alias("m"))
    near = R.context_window(rows.withColumn("row", F.struct("ordem", "m")), "chat_id", "ordem", "row", 1)
    return near.select("chat_id", "ordem", F.array_join(F.transform(F.array_sort("context"), lambda r: r["m"]), "|").alias("contexto"))


@query(
    "w7_reassign_ordinals",
    "SELECT c.id, coalesce(m.n, c.ordem) AS ordem FROM chapter c LEFT JOIN (SELECT id, ordem + 100 AS n FROM chapter WHERE ordem % 2 = 0) m ON m.id = c.id",
)
def _(t):
    mapping = t.chapter.where("ordem % 2 = 0").select("id", (F.col("ordem") + 100).alias("new_ordinal"))
    return R.reassign(t.chapter.select("id", "ordem"), "id", "ordem", mapping)


@query(
    "w8_carry_forward",
    """SELECT o_custkey, o_orderkey, last_value(a IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a_now,
              last_value(b IGNORE NULLS) OVER (PARTITION BY o_custkey, ra ORDER BY o_orderkey) AS b_now
       FROM (SELECT *, count(a) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ra FROM
             (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS b FROM orders))""",
)
def _(t):
    key = F.col("o_orderkey")
    rows = t.orders.select("o_custkey", "o_orderkey", F.when(key % 5 == 0, F.col("o_orderstatus")).alias("a"), F.when(key % 3 == 0, F.col("o_orderpriority")).alias("b"))
    return R.carry_forward(rows, "o_custkey", "o_orderkey", ["a", "b"]).select("o_custkey", "o_orderkey", "a_now", "b_now")


# --- sorts ----------------------------------------------------------------------------------------------------------


@query("k1_global_sort", "SELECT id, data_publicacao, titulo FROM documento")
def _(t):
    return t.documento.select("id", "data_publicacao", "titulo").orderBy(F.desc("data_publicacao"), "id")


@query("k2_top_k", "SELECT id, length(conteudo) AS n FROM documento ORDER BY n DESC, id LIMIT 10")
def _(t):
    return t.documento.select("id", F.length("conteudo").cast("long").alias("n")).orderBy(F.desc("n"), "id").limit(10)


@query("k3_nulls_last", "SELECT id, order_chapter FROM doc_embedding")
def _(t):
    return t.doc_embedding.select("id", "order_chapter").orderBy(F.asc_nulls_last("order_chapter"), "id")


@query("s1_full_scan", "SELECT id, library_id, documento_id, tipo_embedding FROM doc_embedding")
def _(t):
    return t.doc_embedding.select("id", "library_id", "documento_id", "tipo_embedding").orderBy("id")


