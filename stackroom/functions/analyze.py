"""Analyzer, postings and query parsing for full-text search."""

from __future__ import annotations

from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.functions.text import fold

#: Weight of each field label.
LABEL_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}

# Frequent Portuguese words that carry no topic.
STOP_WORDS = ("a", "o", "as", "os", "de", "da", "do", "das", "dos", "e", "em", "no", "na", "nos", "nas", "um", "uma", "para", "por", "com", "que", "se", "ao")

#: Suffix rules of a light Portuguese stemmer, each with the least length of what it leaves, in three stages: plural,
#: suffix, final vowel. In each stage the first rule that fits is applied.
STEM_STAGES = [
    [(r"^(\w{2,})ns$", "$1m"), (r"^(\w{2,})oes$", "$1ao"), (r"^(\w{2,})aes$", "$1ao"), (r"^(\w{2,})ais$", "$1al"), (r"^(\w{2,})eis$", "$1el"), (r"^(\w{3,})res$", "$1r"), (r"^(\w{3,})s$", "$1")],
    [(r"^(\w{3,})amente$", "$1"), (r"^(\w{4,})mente$", "$1"), (r"^(\w{3,})(?:acao|icao|izacao)$", "$1"), (r"^(\w{3,})(?:ando|endo|indo|aria|eria|iria)$", "$1"), (r"^(\w{3,})(?:ar|er|ir|ou|ei|am)$", "$1")],
    [(r"^(\w{3,})[aeo]$", "$1")],
]

#: How words end that some rule of a stage fits: few words meet a pattern.
STEM_ENDS = [("s",), ("mente", "cao", "ndo", "ria", "ar", "er", "ir", "ou", "ei", "am"), ("a", "e", "o")]


def label_weight(label: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in LABEL_WEIGHTS.items():
        out = F.when(label == name, F.lit(weight)).otherwise(out)
    return out


def tokens(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Folded words in order; stop words leave a gap of null, so that positions stay."""
    words = F.filter(F.split(fold(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.when(~w.isin(*stop_words), w)) if stop_words else words


def _stage(rules: list[tuple[str, str]], ends: tuple[str, ...], word: Column) -> Column:
    out = word
    for pattern, into in reversed(rules):
        out = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, into)).otherwise(out)
    return F.when(reduce(or_, [word.endswith(end) for end in ends]), out).otherwise(word)


def stem(word: Column) -> Column:
    """Each stage is bound by a lambda over an array of one, so that it is made once for the next."""
    words = F.array(word)
    for rules, ends in zip(STEM_STAGES, STEM_ENDS, strict=True):
        words = F.transform(words, partial(_stage, rules, ends))
    return F.get(words, F.lit(0))


def postings(docs: DataFrame, fields: list[tuple[str, str]], keys: list[str], stop_words: tuple[str, ...] = (), stemmed: bool = False, only: list[str] | None = None) -> DataFrame:
    """keys, term, pos (from 0, over all fields in order), label. fields: (column, label). With `only`, the postings of
    these words: others are left out within the row, before anything is exploded. Outer, as for an inner explode the
    optimizer would make all words once more in a filter for rows without any."""

    def labelled(column: str, label: str) -> Column:
        words = tokens(F.coalesce(F.col(column), F.lit("")), stop_words)
        return F.transform(words, lambda w: F.struct((stem(w) if stemmed else w).alias("term"), F.lit(label).alias("label")))

    if only is not None:
        placed = F.transform(F.concat(*[labelled(*field) for field in fields]), lambda p, i: F.struct(i.alias("pos"), p.alias("p")))
        rows = docs.select(*keys, F.explode_outer(F.filter(placed, lambda x: x["p"]["term"].isin(only))).alias("x"))
        return rows.where(F.col("x.p.term").isNotNull()).select(*keys, F.col("x.p.term").alias("term"), F.col("x.pos").cast("long").alias("pos"), F.col("x.p.label").alias("label"))
    # Stop words go and stems are made after words are rows, by compiled expressions instead of lambdas.
    words = [F.transform(tokens(F.coalesce(F.col(column), F.lit(""))), lambda w: F.struct(w.alias("term"), F.lit(label).alias("label"))) for column, label in fields]  # noqa: B023
    rows = docs.select(*keys, F.posexplode_outer(F.concat(*words)).alias("pos", "p")).where(F.col("p.term").isNotNull())
    rows = rows.where(~F.col("p.term").isin(*stop_words)) if stop_words else rows
    rows = rows.select(*keys, F.col("p.term").alias("term"), F.col("pos").cast("long").alias("pos"), F.col("p.label").alias("label"))
    for rules, ends in zip(STEM_STAGES, STEM_ENDS, strict=True) if stemmed else ():
        rows = rows.withColumn("term", _stage(rules, ends, F.col("term")))
    return rows


def placed_words(fields: list[tuple[str | Column, str]], stop_words: tuple[str, ...] = (), stemmed: bool = False, positions: bool = True) -> Column:
    """The words of a row's fields (column, label) in order: array of (term, pos, label), pos from 0 over all fields; or of
    (term, label) for what needs no positions."""

    def labelled(column: str | Column, label: str) -> Column:
        words = tokens(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")), stop_words)
        return F.transform(words, lambda w: F.struct((stem(w) if stemmed else w).alias("term"), F.lit(label).alias("label")))

    both = F.concat(*[labelled(*field) for field in fields])
    placed = F.transform(both, lambda p, i: F.struct(p["term"].alias("term"), i.cast("long").alias("pos"), p["label"].alias("label"))) if positions else both
    return F.filter(placed, lambda x: x["term"].isNotNull()) if stop_words else placed


def parse_query(text: Column) -> Column:
    """struct (terms, phrases, excluded) of a query text.

    Folded; quoted runs are phrases, -x and NOT x exclude x, AND is a space, OR separates terms; broad search takes any
    term, and exclusions hold in both modes.
    """
    plain = F.regexp_replace(F.regexp_replace(text, r"\bNOT\s+", "-"), r"\b(AND|OR)\b", " ")
    folded = fold(plain)
    phrase_texts = F.regexp_extract_all(folded, F.lit(r'"([^"]*)"'), 1)
    rest = F.regexp_replace(folded, r'"[^"]*"', " ")
    words = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    excluded = F.flatten(F.transform(F.regexp_extract_all(rest, F.lit(r"(?:^|\s)-([^\s]+)"), 1), words))
    positive = F.regexp_replace(rest, r"(^|\s)-[^\s]+", " ")
    return F.struct(F.array_distinct(words(positive)).alias("terms"), F.filter(F.transform(phrase_texts, words), lambda p: F.size(p) > 0).alias("phrases"), F.array_distinct(excluded).alias("excluded"))


def analyzed(query: Column, stop_words: tuple[str, ...] = (), stemmed: bool = False) -> Column:
    """A parsed query with its words as postings of the same settings have them: without stop words, which leave a gap of
    null in phrases, and stemmed."""
    made = lambda w: stem(w) if stemmed else w
    words = lambda ws: F.array_distinct(F.transform(F.filter(ws, lambda w: ~w.isin(*stop_words)), made))
    phrase = lambda ws: F.transform(ws, lambda w: F.when(~w.isin(*stop_words), made(w)))
    phrases = F.filter(F.transform(query["phrases"], phrase), lambda p: F.exists(p, lambda w: w.isNotNull()))
    return F.struct(words(query["terms"]).alias("terms"), phrases.alias("phrases"), words(query["excluded"]).alias("excluded"))
