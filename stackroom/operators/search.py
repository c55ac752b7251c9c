"""Semantic, full-text and hybrid top-k search, for one query or a table of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stackroom.functions import vectors
from stackroom.functions.analyze import analyzed, label_weight, parse_query
from stackroom.operators.relational import if_small
from stackroom.sources import lists
from stackroom.sources.lists import unit
from stackroom.sources.stored import python_path, written

DIGITS = 6
#: Vectors of queries that one pass over the rows holds; a larger set is searched in blocks. Queries of one product.
BLOCK_BYTES, QUERY_STEP = 32 << 20, 256
#: Rows of codes that a task holds, and candidates of one step of queries before it cuts them.
HELD_CODES, HELD_ROWS = 1 << 19, 500_000


def distance(a: Column, b: Column, metric: str) -> Column:
    """Rounded, so that float noise doesn't split ties."""
    made = vectors.euclidean(a, b) if metric == "l2" else F.lit(1.0) - vectors.cosine(a, b)
    return F.round(made, DIGITS)


def nearest(rows: DataFrame, vector: str, query: Column, k: int, key: str = "id", metric: str = "l2") -> DataFrame:
    """rows with distance, the k nearest: a take-ordered, nothing is sorted as a whole."""
    return rows.withColumn("distance", distance(F.col(vector), query, metric)).where(F.col("distance").isNotNull()).orderBy("distance", key).limit(k)


def semantic_search(rows: DataFrame, vector: str, query: Column, k: int, key: str = "id", metric: str = "l2") -> DataFrame:
    """score = 1 / (1 + distance) for L2, the cosine for cosine distance."""
    near = nearest(rows, vector, query, k, key, metric)
    score = 1 / (1 + F.col("distance")) if metric == "l2" else 1 - F.col("distance")
    return near.withColumn("score", F.round(score, DIGITS))


def text_scores(postings: DataFrame, terms: DataFrame, keys: list[str], mode: str = "broad") -> DataFrame:
    """keys, (query columns of terms), text_rank. terms: term and any query columns.

    Broad: every occurrence of a term counts with its label's weight. Strict: only rows with all terms of the query, ranked
    by their covers. A row's occurrences of a term are summed before they meet the queries that ask for it; terms are
    distinct for each.
    """
    if mode == "strict":
        return cover_scores(postings, terms, keys)
    per = [c for c in terms.columns if c != "term"]
    once = postings.groupBy(*keys, "term").agg(F.sum(label_weight(F.col("label"))).alias("weight"))
    summed = once.join(terms, "term").groupBy(*keys, *per).agg(F.sum("weight").alias("text_rank"))
    return summed.withColumn("text_rank", F.round("text_rank", DIGITS))


def cover_scores(postings: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, (query columns of terms), text_rank of rows that hold all terms of a query, by cover density: a cover is a
    shortest stretch with all terms; it counts with the harmonic mean of its occurrences' weights, divided by one more than
    the other words in it.

    A fold over a row's occurrences keeps the last place of each term. The earliest of these begins the shortest stretch
    that ends here; it is a cover if no earlier stretch began there.
    """
    per = [c for c in terms.columns if c != "term"]
    grouped = terms.groupBy(*per).agg(F.array_sort(F.collect_set("term")).alias("all"))
    placed = grouped.select(*per, F.size("all").alias("wanted"), F.posexplode("all").alias("i", "term"))
    here = postings.join(placed, "term").groupBy(*keys, *per, "wanted").agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col("i"), (1 / label_weight(F.col("label"))).alias("inverse")))).alias("found"), F.countDistinct("i").alias("held")
    )
    spot = "struct<pos:bigint,nth:int,before:double>"
    start = F.struct(
        F.array_repeat(F.lit(None).cast(spot), F.col("wanted")).alias("last"), F.lit(0).alias("nth"), F.lit(0.0).alias("sum"), F.lit(0).alias("begun"), F.lit(0.0).alias("score")
    )

    def step(acc, x):
        nth, total = acc["nth"] + 1, acc["sum"] + x["inverse"]
        moved = F.transform(acc["last"], lambda l, j: F.when(j == x["i"], F.struct(x["pos"].alias("pos"), nth.alias("nth"), acc["sum"].alias("before"))).otherwise(l))

        def with_first(last):
            first = F.when(F.forall(last, lambda l: l.isNotNull()), F.array_min(last))
            is_cover = F.coalesce(first["nth"] > acc["begun"], F.lit(False))
            others = (x["pos"] - first["pos"]) - (nth - first["nth"])
            worth = (nth - first["nth"] + 1) / (total - first["before"]) / (1 + others)
            return F.struct(
                last.alias("last"), nth.alias("nth"), total.alias("sum"), F.when(is_cover, first["nth"]).otherwise(acc["begun"]).alias("begun"),
                (acc["score"] + F.when(is_cover, worth).otherwise(0.0)).alias("score"),
            )

        return F.get(F.transform(F.array(moved), with_first), F.lit(0))

    score = F.aggregate("found", start, step, lambda acc: acc["score"])
    return here.where("held = wanted").select(*keys, *per, F.round(score, DIGITS).alias("text_rank"))


def exclude(scored: DataFrame, postings: DataFrame, excluded: list[str], key: str) -> DataFrame:
    """scored without the rows that have an excluded term."""
    return scored.join(postings.where(F.col("term").isin(excluded)).select(key).distinct(), key, "left_anti") if excluded else scored


def phrase_matches(postings: DataFrame, phrase: list[str], key: str) -> DataFrame:
    """key, start of every place where the words stand side by side: shifted positions that all words agree on. None in a
    phrase stands for any one word."""
    words = [w for w in phrase if w is not None]
    spots = F.array(*[F.struct(F.lit(w).alias("term"), F.lit(i).cast("long").alias("i")) for i, w in enumerate(phrase) if w is not None])
    rows = postings.where(F.col("term").isin(words)).select(key, "term", "pos", F.explode(F.filter(spots, lambda s: s["term"] == F.col("term"))).alias("s"))
    shift = F.col("pos") - F.col("s.i")
    return rows.groupBy(key, shift.alias("start")).agg(F.countDistinct("s.i").alias("n")).where(F.col("n") == len(words)).select(key, "start")


def text_search(postings_of, query_text: str, spark, keys: list[str], mode: str = "broad", stop_words: tuple[str, ...] = (), stemmed: bool = False) -> DataFrame:
    """keys, text_rank for one query text: its terms and the words of its phrases are scored, rows must hold every phrase
    and none of the excluded words. postings_of(words) gives the postings of these words only; key columns: keys. The
    query's words are analysed as the postings were (stop_words, stemmed)."""
    asked = spark.range(1).select(analyzed(parse_query(F.lit(query_text)), stop_words, stemmed).alias("q")).first().q
    words = list(dict.fromkeys([*asked.terms, *(w for p in asked.phrases for w in p if w is not None)]))
    index = postings_of([*words, *asked.excluded])
    scored = text_scores(index, spark.createDataFrame([(w,) for w in words], "term string"), keys, mode)
    for phrase in asked.phrases:
        scored = scored.join(phrase_matches(index, phrase, keys[0]).select(keys[0]).distinct(), keys[0], "left_semi")
    return exclude(scored, index, asked.excluded, keys[0])


def cut_with_ties(rows: DataFrame, by: str, most: int, ascending: bool) -> DataFrame:
    """Rows whose rank by `by` is at most `most`, ties included, with `rank`. Ranks are made of the first `most` distinct
    values and their counts, so that tied rows, however many, stay where they are."""
    order = F.col(by).asc() if ascending else F.col(by).desc()
    values = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).orderBy(order).limit(most)
    before = F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    ranked = values.select(by, (F.coalesce(before, F.lit(0)) + 1).alias("rank")).where(F.col("rank") <= most)
    return rows.join(F.broadcast(ranked), by)


def hybrid_search(semantic: DataFrame, textual: DataFrame, k: int = 10, w_sem: float | Column = 0.6, w_txt: float | Column = 0.4, key: str = "id") -> DataFrame:
    """Weighted reciprocal-rank fusion of (key, distance) and (key, text_rank): each side gives ranks up to 2k, a rank r
    scores 1 / (k + r), a missing side 0."""
    sem = cut_with_ties(semantic, "distance", 2 * k, True).select(key, (1 / (F.lit(k) + F.col("rank"))).alias("score_sem"))
    txt = cut_with_ties(textual, "text_rank", 2 * k, False).select(key, (1 / (F.lit(k) + F.col("rank"))).alias("score_txt"))
    both = sem.join(txt, key, "full").na.fill(0.0, ["score_sem", "score_txt"])
    weight = lambda w: w if isinstance(w, Column) else F.lit(float(w))
    scored = both.withColumn("score", F.round(F.col("score_sem") * weight(w_sem) + F.col("score_txt") * weight(w_txt), DIGITS))
    return scored.orderBy(F.col("score").desc(), key).limit(k)


def linear_hybrid(semantic: DataFrame, textual: DataFrame, k: int, w_sem: float = 0.6, w_txt: float = 0.4, key: str = "id") -> DataFrame:
    """w_sem * (1 - cosine distance) + w_txt * text_rank over all rows of the semantic side."""
    both = semantic.join(textual, key, "left")
    score = F.round((1 - F.col("distance")) * w_sem + F.coalesce("text_rank", F.lit(0.0)) * w_txt, DIGITS)
    return both.withColumn("score", score).orderBy(F.col("score").desc(), key).limit(k)


def top_k_per_query(scored: DataFrame, query: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each query: hot queries are cut within tasks first, by a hash of the row."""
    row = F.struct(*[c for c in scored.columns if c != query])
    part = F.pmod(F.xxhash64(row), F.lit(64))
    inside = Window.partitionBy(query, "_part").orderBy(*order)
    cut = scored.withColumn("_part", part).withColumn("_n", F.row_number().over(inside)).where(F.col("_n") <= k).drop("_part", "_n")
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def _cut(query: np.ndarray, row: np.ndarray, keys: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (query, row) pairs with their distances, the first k of each query."""
    order = np.lexsort((keys[row], d, query))
    query, row = query[order], row[order]
    near = np.arange(len(query)) - np.searchsorted(query, query) < k
    return order[near], np.stack([query[near], row[near]])


def _nearest_in_batches(block, vector: str, key: str, k: int, metric: str):
    """A function of Arrow batches: each batch's k nearest rows for every query, by one matrix product a step of queries."""
    digits, step = DIGITS, QUERY_STEP

    def run(batches):
        ids, all_queries = block.value
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            x = batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), all_queries.shape[1])
            for start in range(0, len(all_queries) if len(keys) else 0, step):
                queries = all_queries[start : start + step]
                norms, products = np.linalg.norm(queries, axis=1), x @ queries.T
                if metric == "l2":
                    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (norms**2)[None, :] - 2 * products, 0))
                else:
                    lengths = np.linalg.norm(x, axis=1)[:, None] * norms[None, :]
                    d = 1 - np.divide(products, lengths, out=np.zeros_like(products), where=lengths > 0)
                d = np.round(d, digits)
                edge = np.partition(d, min(k, len(keys)) - 1, axis=0)[min(k, len(keys)) - 1]
                row, query = np.nonzero(d <= edge[None, :])
                _, (query, row) = _cut(query, row, keys, d[row, query], k)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(start + query)), pa.array(keys[row]), pa.array(d[row, query])], ["query_id", key, "distance"])

    return run


def query_blocks(queries: DataFrame):
    """Broadcast blocks (ids, matrix) of queries (query_id, query_vector), of at most about BLOCK_BYTES and of one dimension,
    one after the other: only one is in the driver at a time."""
    python_path(queries.sparkSession)
    held = F.col("query_vector").isNotNull() & F.col("query_id").isNotNull() & (F.size("query_vector") > 0) & ~F.exists("query_vector", lambda x: x.isNull())
    kept = queries.where(held).withColumn("_size", F.size("query_vector"))
    for size, n in sorted((r["_size"], r.n) for r in kept.groupBy("_size").agg(F.count("*").alias("n")).collect()):
        blocks = -(-n * size * 8 // BLOCK_BYTES)
        for block in range(blocks):
            part = kept.where((F.col("_size") == size) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).select("query_id", "query_vector").toArrow()
            if part.num_rows:
                matrix = part["query_vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                yield size, queries.sparkSession.sparkContext.broadcast((part["query_id"].combine_chunks(), matrix))


def of_blocks(found: DataFrame, empty: DataFrame | None, label: str) -> DataFrame:
    """What one block of queries finds, beside what earlier ones have found: with more than one block each is written, so
    that its broadcast is not needed any more."""
    return found if empty is None else empty.unionByName(written(found, label))


def batch_semantic(rows: DataFrame, vector: str, queries: DataFrame, k: int, key: str = "id", metric: str = "cosine") -> DataFrame:
    """queries (query_id, query_vector), a stated set, against all rows: by blocks of queries, for each of which the rows are
    read once. Vectors of other dimensions than the query's never match."""
    types = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *rows.schema.fields]}
    schema, out = f"query_id {types['query_id']}, {key} {types[key]}, distance double", None
    for size, block in query_blocks(queries):
        fit = rows.where((F.size(vector) == size) & F.col(key).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(key, vector)
        out = of_blocks(fit.mapInArrow(_nearest_in_batches(block, vector, key, k, metric), schema), out, "nearest")
    out = rows.sparkSession.createDataFrame([], schema) if out is None else out
    return top_k_per_query(out, "query_id", [F.col("distance"), F.col(key)], k)


def _nearest_by_codes(block, model, key: str, probed: np.ndarray, keep: int):
    """A function of Arrow batches of codes (key, home, list, code): each query's `keep` best rows among its lists. A task
    holds some rows at a time and meets them with one step of queries after the other, so that it never holds more
    candidates than those of a step, however many queries there are."""
    query_step, row_step, most, most_rows = lists.QUERY_STEP, lists.ROW_STEP, HELD_ROWS, HELD_CODES

    def best(parts: list[tuple]) -> tuple:
        query, place, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((-score, query))
        kept = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < keep]
        return query[kept], place[kept], score[kept]

    def of_step(queries: np.ndarray, asked: np.ndarray, m, codes: np.ndarray, of_list: np.ndarray) -> tuple | None:
        # A cosine is about the sum, over the slices, of the query's products with the code's centres.
        parts = m.padded(unit(queries))
        products = np.einsum("qsd,scd->sqc", parts, m.codebooks)
        asks = np.zeros((len(parts), len(m.centres)), bool)
        np.put_along_axis(asks, asked, True, axis=1)
        held: list[tuple] = []
        for begin in range(0, len(codes), row_step):
            rows = slice(begin, begin + row_step)
            row = np.flatnonzero(asks[:, of_list[rows]].any(0))
            if not len(row):
                continue
            score = sum(products[s][:, codes[rows][row, s]] for s in range(codes.shape[1]))
            score[~asks[:, of_list[rows][row]]] = -np.inf
            n = min(keep, len(row))
            edge = np.partition(score, len(row) - n, axis=1)[:, len(row) - n]
            query, at = np.nonzero((score >= edge[:, None]) & (score > -np.inf))
            held.append((query, begin + row[at], score[query, at]))
            if sum(len(part[0]) for part in held) > most:
                held = [best(held)]
        return best(held) if held else None

    def of_rows(parts: list[tuple]):
        (ids, queries), m = block.value, model.value
        keys = pa.concat_arrays([part[0] for part in parts])
        homes, of_list, codes = (np.concatenate([part[i] for part in parts]) for i in (1, 2, 3))
        for start in range(0, len(queries), query_step):
            steps = slice(start, start + query_step)
            found = of_step(queries[steps], probed[steps], m, codes, of_list)
            if found is not None:
                query, place, score = found
                columns = [ids.take(pa.array(start + query)), keys.take(pa.array(place)), pa.array(homes[place], pa.int32()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", key, "home", "score"])

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            homes, of_list = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("home", "list"))
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            parts.append((batch.column(key), homes, of_list, codes))
            n += batch.num_rows
            if n >= most_rows:
                yield from of_rows(parts)
                parts, n = [], 0
        if parts:
            yield from of_rows(parts)

    return run


def ann_search(spark, path: str, queries: DataFrame, k: int, probes: int = lists.PROBES, key: str = "id", keep: int | None = None) -> DataFrame:
    """Approximate nearest rows by cosine from a stored index: of the `probes` lists nearest to a query, the `keep` rows that
    are best by their codes are ranked by their vectors. Partitions of other lists are not read."""
    model, keep = lists.load_model(spark, path), keep or max(100, 20 * k)
    shared, out = spark.sparkContext.broadcast(model), None
    codes = spark.read.parquet(f"{path}/codes")
    types = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *codes.schema.fields]}
    for size, block in query_blocks(queries):
        if size != model.dimension:
            continue
        probed = model.nearest_lists(unit(block.value[1]), min(probes, len(model.centres)))
        asked = codes.where(F.col("list").isin(np.unique(probed).tolist())).select(key, "home", "list", "code")
        found = asked.mapInArrow(_nearest_by_codes(block, shared, key, probed, keep), f"query_id {types['query_id']}, {key} {types[key]}, home int, score double")
        # A row that is in several of the lists comes once.
        best = top_k_per_query(found.groupBy("query_id", key, "home").agg(F.max("score").alias("score")), "query_id", [F.col("score").desc(), F.col(key)], keep)
        out = of_blocks(best, out, "by-codes")
    if out is None:
        return spark.createDataFrame([], f"query_id {types['query_id']}, {key} {types[key]}, distance double, rank long")
    rows = spark.read.parquet(f"{path}/vectors").select(key, F.col("list").alias("home"), "vector")
    named = out.drop("score", "rank").join(queries.select("query_id", "query_vector"), "query_id").join(rows, ["home", key])
    near = named.select("query_id", key, distance(F.col("vector"), F.col("query_vector"), "cosine").alias("distance"))
    return top_k_per_query(near, "query_id", [F.col("distance"), F.col(key)], k)


def batch_textual(postings: DataFrame, terms: DataFrame, k: int, key: str = "id") -> DataFrame:
    """terms (query_id, term) -> query_id, key, text_rank, rank."""
    return top_k_per_query(text_scores(postings, terms, [key]), "query_id", [F.col("text_rank").desc(), F.col(key)], k)


def batch_hybrid(semantic: DataFrame, textual: DataFrame, k: int, w_sem: float = 0.6, w_txt: float = 0.4, key: str = "id") -> DataFrame:
    """Fusion per query of the two batch results (each cut at 2k), whose rank columns are used."""
    sem = semantic.select("query_id", key, (1 / (F.lit(k) + F.col("rank"))).alias("score_sem"))
    txt = textual.select("query_id", key, (1 / (F.lit(k) + F.col("rank"))).alias("score_txt"))
    both = sem.join(txt, ["query_id", key], "full").na.fill(0.0, ["score_sem", "score_txt"])
    scored = both.withColumn("score", F.round(F.col("score_sem") * w_sem + F.col("score_txt") * w_txt, DIGITS))
    return top_k_per_query(scored, "query_id", [F.col("score").desc(), F.col(key)], k)


def enrich(results: DataFrame, documents: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """results (documento_id, order_chapter, ...) with the titles of document and chapter; missing ones are null."""
    out = results.join(documents.select(F.col("id").alias("documento_id"), F.col("titulo").alias("titulo_documento")), "documento_id", "left")
    if chapters is not None:
        titles = chapters.select("documento_id", F.col("ordem").alias("order_chapter"), F.col("titulo").alias("titulo_capitulo"))
        out = out.join(titles, ["documento_id", "order_chapter"], "left")
    return out


def fit_to_libraries(rows: DataFrame, vector: str, libraries: DataFrame) -> DataFrame:
    """Vectors at their library's dimension (libraries: library_id, dimension): cut or padded, then normalised if changed."""
    joined = rows.join(if_small(libraries.select("library_id", "dimension")), "library_id")
    return joined.withColumn(vector, vectors.to_dimension(F.col(vector), F.col("dimension"))).drop("dimension")


def paired_check(a: DataFrame, b: DataFrame, key: str, vector: str, least: float = 0.8) -> DataFrame:
    """Cosine of two models' vectors for the same key, with a warning below `least` or on different dimensions."""
    both = a.select(key, F.col(vector).alias("a")).join(b.select(key, F.col(vector).alias("b")), key)
    made = both.select(key, F.round(vectors.cosine(F.col("a"), F.col("b")), DIGITS).alias("cosine"), (F.size("a") == F.size("b")).alias("same_dimension"))
    return made.withColumn("warn", ~F.col("same_dimension") | (F.coalesce("cosine", F.lit(0.0)) < least))
