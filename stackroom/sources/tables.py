"""The collection's tables as DataFrames over the star-schema, document and conversation files.

Every view is a function (spark, folder) -> DataFrame; VIEW_SQL has the same views for the engine that checks results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lines of a document that make one chapter.
LINES_A_CHAPTER = 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def library(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("r_regionkey")
    return table(spark, folder, "region").select(
        key.cast("long").alias("id"),
        F.col("r_name").alias("nome"),
        F.when(key % 2 == 0, "Tecnologia").otherwise("Direito").alias("area_conhecimento"),
        ((key + 4) / 10).alias("peso_semantico"),
        ((-key + 6) / 10).alias("peso_textual"),
    )


def documento(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        (F.substring("source", 4, 10).cast("long") % 5).alias("biblioteca_id"),
        F.substring("text", 1, 60).alias("titulo"),
        F.col("text").alias("conteudo"),
        (F.col("doc_id") % 7 != 0).alias("flag_vigente"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("data_publicacao"),
        "lang",
        F.concat(F.lit('{"lang":"'), "lang", F.lit('","source":"'), "source", F.lit('"}')).alias("metadados"),
    )


def doc_embedding(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        key.alias("id"),
        (F.col("label") % 5).cast("long").alias("library_id"),
        (key % 200).alias("documento_id"),
        F.when(key % 4 != 0, key % 3 + 1).alias("order_chapter"),
        F.when(key % 4 == 0, "documento").otherwise("trecho").alias("tipo_embedding"),
        F.col("embedding").alias("embedding_vector"),
    )


def chat_message(spark: SparkSession, folder: str) -> DataFrame:
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, folder, "conversations").withColumn("response", F.lead(F.when(F.col("role") == "assistant", F.col("text"))).over(by_turn))
    asked = rows.where(F.col("role") == "user")
    return asked.select(
        F.col("conv_id").alias("chat_id"), "turn", F.col("text").alias("mensagem"), "response", F.row_number().over(by_turn).cast("long").alias("ordem")
    )


def chat(spark: SparkSession, folder: str) -> DataFrame:
    counted = table(spark, folder, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    key = F.col("conv_id")
    return counted.select(key.alias("id"), (key % 50).alias("user_id"), F.concat(F.lit("Chat "), key.cast("string")).alias("titulo"), "turns")


def app_user(spark: SparkSession, folder: str) -> DataFrame:
    email = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("@example.org"))
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("nome"), email.alias("email"), (F.col("c_acctbal") > 0).alias("ativo")
    )


def user_library(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 5).alias("library_id"), "o_orderpriority")
    best = orders.groupBy("user_id", "library_id").agg(F.min("o_orderpriority").alias("best"))
    role = F.when(F.col("best").startswith("1"), "proprietario").when(F.col("best").startswith("2"), "colaborador").otherwise("leitor")
    return best.select("user_id", "library_id", role.alias("tipo_associacao"))


def client(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.alias("id"), F.col("s_name").alias("nome"), (F.col("s_acctbal") > 0).alias("ativo"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key * 30).cast("int")).alias("api_key_expires_at"),
    )


def word_count(text: Column) -> Column:
    """Runs of non-space characters."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def chapter(spark: SparkSession, folder: str, lines: int = LINES_A_CHAPTER) -> DataFrame:
    """Every `lines` lines of a document are a chapter; a few are left out, so that numbering has gaps.

    The cut is an array expression on the row: no line leaves its document's task.
    """
    split = table(spark, folder, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    parts = F.transform(F.sequence(F.lit(0), ((F.size("lines") - 1) / lines).cast("int")), lambda c: F.array_join(F.slice("lines", c * lines + 1, lines), "\n"))
    counted = F.transform(parts, lambda p: F.struct(p.alias("conteudo"), word_count(p).alias("n")))
    started = split.select("doc_id", counted.alias("parts")).select(
        "doc_id",
        F.posexplode(F.transform("parts", lambda p, i: F.struct(p["conteudo"].alias("conteudo"), p["n"].alias("n"), i.alias("i")))).alias("pos", "part"),
        F.col("parts.n").alias("counts"),
    )
    ahead = F.aggregate(F.slice("counts", 1, F.col("pos")), F.lit(0).cast("long"), lambda acc, n: acc + n)
    ordem = (F.col("pos") + 1).cast("long")
    rows = started.select(
        F.col("doc_id").alias("documento_id"), ordem.alias("ordem"), F.col("part.conteudo").alias("conteudo"),
        ahead.alias("token_inicio"), (ahead + F.col("part.n")).alias("token_fim"),
    ).where((F.col("documento_id") + F.col("ordem")) % 11 != 0)
    key = F.col("documento_id") * 10000 + F.col("ordem")
    title = F.concat(F.lit("Capitulo "), F.col("ordem").cast("string"))
    return rows.select(key.alias("id"), "documento_id", title.alias("titulo"), "conteudo", "ordem", "token_inicio", "token_fim")


#: The views for the checking engine, each over the raw tables or earlier views.
VIEW_SQL = {
    "library": """SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS nome,
        CASE WHEN r_regionkey % 2 = 0 THEN 'Tecnologia' ELSE 'Direito' END AS area_conhecimento,
        CAST((4 + r_regionkey) / 10.0 AS DOUBLE) AS peso_semantico, CAST((6 - r_regionkey) / 10.0 AS DOUBLE) AS peso_textual FROM region""",
    "documento": """SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) % 5 AS biblioteca_id, substr(text, 1, 60) AS titulo,
        text AS conteudo, doc_id % 7 <> 0 AS flag_vigente, DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS data_publicacao, lang,
        concat('{"lang":"', lang, '","source":"', source, '"}') AS metadados FROM documents""",
    "doc_embedding": """SELECT vec_id AS id, CAST(label % 5 AS BIGINT) AS library_id, vec_id % 200 AS documento_id,
        CASE WHEN vec_id % 4 = 0 THEN NULL ELSE vec_id % 3 + 1 END AS order_chapter,
        CASE WHEN vec_id % 4 = 0 THEN 'documento' ELSE 'trecho' END AS tipo_embedding, embedding AS embedding_vector FROM embeddings""",
    "chat_message": """SELECT conv_id AS chat_id, turn, mensagem, response, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS ordem
        FROM (SELECT conv_id, turn, role, text AS mensagem, lead(CASE WHEN role = 'assistant' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn) AS response
              FROM conversations) q WHERE role = 'user'""",
    "chat": "SELECT conv_id AS id, conv_id % 50 AS user_id, concat('Chat ', CAST(conv_id AS VARCHAR)) AS titulo, count(*) AS turns FROM conversations GROUP BY conv_id",
    "app_user": "SELECT c_custkey AS id, c_name AS nome, concat(lower(replace(c_name, '#', '')), '@example.org') AS email, c_acctbal > 0 AS ativo FROM customer",
    "user_library": """SELECT o_custkey AS user_id, o_orderkey % 5 AS library_id,
        CASE WHEN min(o_orderpriority) LIKE '1%' THEN 'proprietario' WHEN min(o_orderpriority) LIKE '2%' THEN 'colaborador' ELSE 'leitor' END AS tipo_associacao
        FROM orders GROUP BY o_custkey, o_orderkey % 5""",
    "client": "SELECT s_suppkey AS id, s_name AS nome, s_acctbal > 0 AS ativo, DATE '2024-01-01' + CAST(s_suppkey * 30 AS INT) AS api_key_expires_at FROM supplier",
    "chapter": """SELECT documento_id * 10000 + ordem AS id, documento_id, 'Capitulo ' || ordem AS titulo, conteudo, ordem, token_fim - n AS token_inicio, token_fim
        FROM (SELECT documento_id, ordem, conteudo, n, CAST(sum(n) OVER (PARTITION BY documento_id ORDER BY ordem) AS BIGINT) AS token_fim
              FROM (SELECT documento_id, ordem, conteudo, CAST(len(regexp_extract_all(conteudo, '\\S+')) AS BIGINT) AS n
                    FROM (SELECT doc_id AS documento_id, c + 1 AS ordem, array_to_string(l[c * 8 + 1:c * 8 + 8], chr(10)) AS conteudo
                          FROM (SELECT doc_id, l, unnest(range((len(l) - 1) // 8 + 1)) AS c FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))))
        WHERE (documento_id + ordem) % 11 <> 0""",
}

VIEWS = {
    "library": library, "documento": documento, "doc_embedding": doc_embedding, "chat_message": chat_message, "chat": chat,
    "app_user": app_user, "user_library": user_library, "client": client, "chapter": chapter,
}
