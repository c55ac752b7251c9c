"""Streams over arriving documents and conversations. Every batch is idempotent: keys come from the data, not the run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from stackroom.functions import analyze
from stackroom.operators.chunking import document_type, embed, embedding_plan, split_by_type
from stackroom.sources import ledger, segments

FILES_PER_BATCH = 100


def arriving(spark: SparkSession, path: str, schema, files: int = FILES_PER_BATCH) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def per_batch(rows: DataFrame, make: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """make(batch) is written under the batch's number: a batch that is run again overwrites what it wrote."""

    def save(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embedding_rows(docs: DataFrame, separator: str = r"\n\s*\n", model=None, splitters: dict | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, tipo, ordem, level, order_chapter, title, text, vector: routed, cut by the splitter of
    the type, planned by the size of each part, and embedded."""
    typed = docs.withColumn("tipo", document_type(F.col("text")))
    parts = split_by_type(typed, ["doc_id"], "text", "tipo", separator, splitters).withColumn("titulo", F.concat(F.lit("Parte "), F.col("ordem").cast("string")))
    planned = embedding_plan(parts, ["doc_id", "tipo", "ordem"], "titulo", "texto", separator)
    columns = planned.columns
    return embed(planned.withColumn("_text", F.col("text")), columns, "_text", model)


def ingest(docs: DataFrame, path: str, checkpoint: str, separator: str = r"\n\s*\n", model=None, splitters: dict | None = None) -> StreamingQuery:
    """A stored table of embedding rows, kept up with a stream of documents (doc_id, text): a document that comes again
    replaces its rows, and one with a null text deletes them. Of a document's versions in a batch the greatest text counts.
    A batch that is run again, or once more after it was stopped, changes nothing more."""

    def apply(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("doc_id").agg(F.max("text").alias("text")).persist()
        rows = embedding_rows(newest.where(F.col("text").isNotNull()), separator, model, splitters)
        ledger.upsert(batch.sparkSession, path, rows, ["doc_id"], newest, number)
        newest.unpersist()

    return docs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_index(changes: DataFrame, path: str, checkpoint: str, fields: list[tuple[str, str]] = (("text", "C"),), key: str = "doc_id", deleted: str = "deleted", order: str | None = None) -> StreamingQuery:
    """A stored index kept up with a stream of changes (key, fields, deleted): each batch replaces or deletes the documents
    that it names and is one version. Of a key's rows in a batch the greatest by `order` counts, else the greatest row."""

    def apply(batch: DataFrame, number: int) -> None:
        spark, names = batch.sparkSession, [name for name, _ in fields]
        row = F.struct(*([order] if order else []), deleted, *names)
        newest = batch.groupBy(key).agg(F.max(row).alias("_row")).select(key, "_row.*").persist()
        size = sum((F.coalesce(F.length(name), F.lit(0)) for name in names), F.lit(0))
        rows = newest.where(~F.col(deleted)).select(key, size.alias("size"), *names)
        segments.update(segments.latest(spark, path), rows, number, newest.where(deleted).select(key), analyze.placed_words(list(fields)))
        newest.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, key: str) -> DataFrame:
    """What the batches under `out` have brought, of each key only its latest batch."""
    rows = spark.read.parquet(out)
    latest = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(latest, [key, "batch"], "left_semi").drop("batch")


def conversation_counters(turns: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running counts of each conversation. Ordinals, not times, define the order, so that late turns are as good as
    any and no watermark drops them: state holds one row a conversation."""
    counted = turns.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("asked"), F.count_if(F.col("role") == "assistant").alias("answered"),
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
    )

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return counted.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Ordinals of a conversation whose turns one row holds: a conversation of any length is many rows.
TURNS_A_PIECE = 4096
_ASKED, _ANSWERED = 1, 2


def _latest_turns(turns: Column) -> Column:
    """turns (turn, age, role) by ordinal, of equal ones only the last by age and role. The array of one binds the sorted
    turns, so that they are made once."""
    last = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["turn"] != x["turn"], F.lit(True)))
    return F.get(F.transform(F.array(F.sort_array(turns)), last), F.lit(0))


def _merged_pieces(said: DataFrame, held: DataFrame | None) -> DataFrame:
    """Pieces with more turns, from what a batch said of them and what was held: a turn that comes again takes the place of
    the former."""
    aged = lambda turns, age: F.transform(turns, lambda x: F.struct(x["turn"].alias("turn"), F.lit(age).alias("age"), x["role"].alias("role")))
    turns, first, last = aged(F.col("n.turns"), 1), F.col("n.first"), F.col("n.last")
    rows = said.alias("n")
    if held is not None:
        rows = rows.join(held.alias("h"), F.col("n.conv_id").eqNullSafe(F.col("h.conv_id")) & (F.col("n.piece") == F.col("h.piece")), "left")
        turns = F.concat(turns, F.coalesce(aged(F.col("h.turns"), 0), F.array()))
        former = lambda end: F.when(F.col(f"h.{end}_turn").isNotNull(), F.struct(F.col(f"h.{end}_turn").alias("turn"), F.col(f"h.{end}_message").alias("text")))
        first = F.when(former("first")["turn"] < F.coalesce(first["turn"], F.lit((1 << 63) - 1)), former("first")).otherwise(first)
        last = F.when(former("last")["turn"] > F.coalesce(last["turn"], F.lit(-(1 << 63))), former("last")).otherwise(last)
    rows = rows.select(F.col("n.conv_id").alias("conv_id"), F.col("n.piece").alias("piece"), _latest_turns(turns).alias("_turns"), first.alias("_first"), last.alias("_last"))
    roles = F.col("_turns.role")
    answered = F.zip_with(roles, F.slice(roles, 2, F.size(roles)), lambda a, b: F.coalesce((a == _ASKED) & (b == _ANSWERED), F.lit(False)))
    return rows.select(
        "conv_id", "piece", F.size(F.filter(roles, lambda r: r == _ASKED)).cast("long").alias("asked"), F.size(F.filter(answered, lambda x: x)).cast("long").alias("answered"),
        F.element_at(roles, 1).alias("first_role"), F.element_at(roles, -1).alias("last_role"),
        F.col("_first.turn").alias("first_turn"), F.col("_first.text").alias("first_message"), F.col("_last.turn").alias("last_turn"), F.col("_last.text").alias("last_message"),
        F.transform("_turns", lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"))).alias("turns"),
    )


def conversation_summaries(turns: DataFrame, path: str, checkpoint: str, piece: int = TURNS_A_PIECE) -> StreamingQuery:
    """A stored table of what pieces of conversations say, kept up with a stream of turns (conv_id, turn, role, text) in any
    order: ordinals, not times, order them, so that no watermark drops a late one. The table is the state: a batch's turns
    are put together for each piece and merged with its row. See summaries_of."""
    role = F.when(F.col("role") == "user", _ASKED).when((F.col("role") == "assistant") & F.col("text").isNotNull(), _ANSWERED).otherwise(0)
    held = turns.where(F.col("turn").isNotNull()).select("conv_id", F.floor(F.col("turn") / piece).cast("long").alias("piece"), F.col("turn").cast("long").alias("turn"), role.alias("role"), "text")

    def apply(batch: DataFrame, number: int) -> None:
        spark, keys = batch.sparkSession, ["conv_id", "piece"]
        ask = F.when(F.col("role") == _ASKED, F.struct("turn", "text"))
        # Of a turn that comes twice in a batch the greatest text counts.
        said = batch.groupBy(*keys).agg(
            F.collect_list(F.struct("turn", "role")).alias("turns"),
            F.max_by(ask, F.when(F.col("role") == _ASKED, F.struct(-F.col("turn"), "text"))).alias("first"), F.max(ask).alias("last"),
        ).persist()
        ledger.upsert(spark, path, _merged_pieces(said, ledger.read_slices(spark, path, said, keys)), keys, said, number)
        said.unpersist()

    return held.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summaries_of(pieces: DataFrame) -> DataFrame:
    """conv_id, total, with_response, without_response, first, last, rate of the conversations that asked something. An
    answer at the beginning of a piece is one to the question at the end of the piece before."""
    following = F.lead("first_role").over(Window.partitionBy("conv_id").orderBy("piece"))
    across = F.when((F.col("last_role") == _ASKED) & (following == _ANSWERED), 1).otherwise(0)
    counted = pieces.withColumn("_across", across).groupBy("conv_id").agg(
        F.sum("asked").alias("total"), F.sum(F.col("answered") + F.col("_across")).alias("with_response"),
        F.min_by("first_message", "first_turn").alias("first"), F.max_by("last_message", "last_turn").alias("last"),
    ).where("total > 0")
    return counted.select(
        "conv_id", "total", "with_response", (F.col("total") - F.col("with_response")).alias("without_response"), "first", "last",
        F.round(F.col("with_response") / F.col("total"), 6).alias("rate"),
    )
