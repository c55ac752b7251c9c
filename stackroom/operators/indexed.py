"""Top-k text search over a stored index of segments: by bounds of blocks, in two rounds.

First the blocks of the greatest bounds are scored. What the k-th document then has is a threshold: blocks whose bound is
below it can't hold a document of the first k, and are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.functions.analyze import analyzed, parse_query
from stackroom.operators.relational import if_small
from stackroom.operators.search import DIGITS, cover_scores, exclude, hybrid_search, phrase_matches, top_k_per_query
from stackroom.sources.segments import Snapshot

#: Blocks that the first round takes at least, and those that the driver chooses among; beyond these Spark joins them.
FIRST_BLOCKS, MOST_BLOCKS = 4, 5000
#: Bounds are sums of numbers that scores round.
SLACK = 10.0**-DIGITS


def block_bounds(index: Snapshot, words: list[str], mode: str = "broad", needed: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """segment, groups, block, bound, n: blocks that may hold a match, and what its score is at most.

    Broad: the sum of the terms' best weights. Strict: a cover is worth 1 at most, and no two begin at one occurrence, so
    that the occurrences bound them; all words must be there. Needed words (of phrases) must be, too."""
    must = sorted({*needed, *(words if mode == "strict" else [])})
    rows = index.of_terms("bounds", sorted({*words, *must}))
    rows = rows if where is None else rows.where(where)
    scored = F.col("term").isin(words)
    per = rows.groupBy("segment", *index.groups, "block").agg(
        F.sum(F.when(scored, F.col("most" if mode == "strict" else "best")).otherwise(0)).cast("double").alias("bound"), F.max("n").alias("n"),
        F.count_if(F.col("term").isin(must)).alias("_held") if must else F.lit(0).alias("_held"),
    )
    return per.where(F.col("_held") == len(must)).drop("_held")


def _scores(index: Snapshot, blocks_of: Callable[[list[str]], DataFrame], words: list[str], phrases: list[list], excluded: list[str], mode: str) -> DataFrame:
    """key, text_rank of the documents that match, among those of the blocks that blocks_of gives for words."""
    if mode == "strict":
        terms = index.spark.createDataFrame([(w,) for w in words], "term string")
        scored = cover_scores(index.postings(blocks_of(words)), terms, [index.key])
    else:
        scored = index.exploded(blocks_of(words)).groupBy(index.key).agg(F.round(F.sum("weight"), DIGITS).alias("text_rank"))
    for phrase in phrases:
        held = index.postings(blocks_of([w for w in phrase if w is not None]))
        scored = scored.join(phrase_matches(held, phrase, index.key).select(index.key).distinct(), index.key, "left_semi")
    return exclude(scored, index.exploded(blocks_of(excluded)), excluded, index.key) if excluded else scored


def indexed_search(
    index: Snapshot, words: list[str], k: int, mode: str = "broad", phrases: list[list] = (), excluded: list[str] = (), where: Column | None = None,
    allowed: DataFrame | None = None, first_blocks: int = FIRST_BLOCKS, most_blocks: int = MOST_BLOCKS,
) -> DataFrame:
    """key, text_rank: all documents of the first k ranks, ties included, and some others. where: a condition on the index's
    groups; allowed: keys that may be found. Strict search and phrases need an index with positions."""
    words = list(dict.fromkeys(words))
    if not words or not index.segments:
        return index.spark.createDataFrame([], f"{index.key} {index.key_type}, text_rank double")
    needed = tuple(w for p in phrases for w in p if w is not None)
    bounds = block_bounds(index, words, mode, needed, where)

    def scores(chosen: Callable[[DataFrame], DataFrame]) -> DataFrame:
        def blocks_of(terms: list[str]) -> DataFrame:
            rows = index.of_terms("blocks", terms)
            return chosen(rows if where is None else rows.where(where))

        found = _scores(index, blocks_of, words, list(phrases), list(excluded), mode)
        return found if allowed is None else found.join(allowed, index.key, "left_semi")

    known = bounds.orderBy(F.desc("bound"), "block").limit(most_blocks + 1).collect()
    first, held = [], 0
    for row in known:
        if len(first) >= first_blocks and held >= 2 * k:
            break
        first.append(row.block)
        held += row.n
    best = [r[0] for r in scores(lambda rows: rows.where(F.col("block").isin(first))).select("text_rank").orderBy(F.desc("text_rank")).limit(k).collect()]
    least = best[-1] - SLACK if len(best) == k else 0.0
    if len(known) <= most_blocks:
        kept = [r.block for r in known if r.bound >= least]
        return scores(lambda rows: rows.where(F.col("block").isin(kept)))
    # So many blocks that their numbers don't fit into a filter: a join leaves out those below the threshold.
    above = bounds.where(F.col("bound") >= least).select("segment", "block").distinct()
    return scores(lambda rows: rows.join(above, ["segment", "block"], "left_semi"))


def search_text(index: Snapshot, text: str, k: int, mode: str = "broad", where: Column | None = None, allowed: DataFrame | None = None, stop_words: tuple[str, ...] = (), stemmed: bool = False) -> DataFrame:
    """indexed_search of a query text: its terms and the words of its phrases are scored, documents must hold every phrase
    and no excluded word. The text is analysed as the index was (stop_words, stemmed)."""
    asked = index.spark.range(1).select(analyzed(parse_query(F.lit(text)), stop_words, stemmed).alias("q")).first().q
    words = [*asked.terms, *(w for p in asked.phrases for w in p if w is not None)]
    return indexed_search(index, words, k, mode, asked.phrases, asked.excluded, where, allowed)


def prepared_search(
    index: Snapshot, vectors: DataFrame, text: str, distance: Column, k: int = 10, w_sem: float = 0.6, w_txt: float = 0.4, mode: str = "broad", where: Column | None = None, allowed: DataFrame | None = None, **analysis
) -> DataFrame:
    """Hybrid search in one call: a query text over the index, and distances over vectors (key, groups, ...), both under the
    same condition and among the allowed keys, fused by weighted reciprocal ranks."""
    rows = vectors if where is None else vectors.where(where)
    rows = rows if allowed is None else rows.join(allowed, index.key, "left_semi")
    textual = search_text(index, text, 2 * k, mode, where, allowed, **analysis)
    return hybrid_search(rows.select(index.key, distance.alias("distance")), textual, k, w_sem, w_txt, index.key)


def indexed_batch(index: Snapshot, terms: DataFrame, k: int) -> DataFrame:
    """terms (query_id, term), distinct -> query_id, key, text_rank, rank: broad search of many queries, each with a
    threshold of its own, in the same two rounds."""
    known = [r[0] for r in terms.select("term").distinct().limit(MOST_BLOCKS + 1).collect()]
    words = known if len(known) <= MOST_BLOCKS else None
    if not known or not index.segments:
        return index.spark.createDataFrame([], f"query_id {terms.schema['query_id'].dataType.simpleString()}, {index.key} {index.key_type}, text_rank double, rank long")
    asked, queries = if_small(terms), terms.select("query_id").distinct().count()
    places = ["segment", *index.groups, "block"]
    bounds = index.of_terms("bounds", words).join(asked, "term").groupBy("query_id", *places).agg(F.sum("best").alias("bound"))
    order = [F.col("text_rank").desc(), F.col(index.key)]

    def scored(chosen: DataFrame) -> DataFrame:
        wanted = chosen.join(asked, "query_id").alias("w")
        blocks = index.of_terms("blocks", words).alias("b")
        same = [F.col("b.term") == F.col("w.term"), *[F.col(f"b.{c}").eqNullSafe(F.col(f"w.{c}")) for c in places]]
        rows = blocks.join(wanted, same).select("query_id", "b.segment", F.explode(F.arrays_zip("ids", "weights")).alias("p"))
        alive = index.alive(rows.select("query_id", "segment", F.col("p.ids").alias(index.key), F.col("p.weights").alias("weight")))
        summed = alive.groupBy("query_id", index.key).agg(F.round(F.sum("weight"), DIGITS).alias("text_rank"))
        return top_k_per_query(summed, "query_id", order, k)

    # A block has a document at least, so that k of them give k.
    first = top_k_per_query(bounds, "query_id", [F.col("bound").desc(), *map(F.col, places)], k).select("query_id", *places)
    least = scored(first).where(F.col("rank") == k).select("query_id", (F.col("text_rank") - SLACK).alias("_least"))
    kept = bounds.join(if_small(least, queries), "query_id", "left").where(F.col("bound") >= F.coalesce("_least", F.lit(0.0)))
    return scored(kept.select("query_id", *places))
