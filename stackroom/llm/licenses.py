"""License scanning with a positional index of rare tokens, by DataFrame functions only.

Templates are short license notices. Each is indexed under the ANCHORS words of highest IDF of its key phrase, counted over
the documents that are scanned, with their positions in it. The whole phrase must stand for a match, so that its words
miss none. A document's anchor words look up the postings; what they say about where a
template would start is intersected, and starts that enough anchors agree on are verified: the template's mandatory key
phrase must stand at its place, and the share of the template's words found at theirs is the score.

Base phrases are templates that are their own key phrase. Words are runs of digits, letters a-z and characters beyond
ASCII, after lower-casing A-Z.

Defined cases: a null text counts as empty, has no words and no labels; repeated rows are scanned each; a place where
phrases overlap counts for each of them; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.llm.common import ascii_lower, table, text_of


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False


# Phrases that the scan must find, and the wording of common license notices.
BASE = [
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
]
NOTICES = [
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template("apache-2.0", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "terms of the gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc0", "to the extent possible under law has waived all copyright and related or neighboring rights", "waived all copyright"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
]

#: Anchors of a template, those of them that must agree on a start, and the least score of a notice.
ANCHORS, AGREE, LEAST_SCORE = 3, 2, 0.6


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def _key_place(t: Template) -> int:
    text, key = t.text.split(), t.key.split()
    return next(i for i in range(len(text)) if text[i : i + len(key)] == key)


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each word of the templates: as many numbers as the templates have words."""
    listed = F.array(*map(F.lit, vocabulary))
    found = docs.select(F.explode(F.array_intersect("w", listed)).alias("word"))
    return {r.word: r.n for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def anchor_postings(templates: list[Template], df: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """word -> (template, place) for the words of highest IDF of each template's key phrase."""
    out: dict[str, list[tuple[int, int]]] = {}
    for number, t in enumerate(templates):
        words = t.key.split()
        rarest = sorted(dict.fromkeys(words), key=lambda w: (df.get(w, 0), w))[:ANCHORS]
        for place, word in enumerate(words, _key_place(t)):
            if word in rarest:
                out.setdefault(word, []).append((number, place))
    return out


def scan(docs: DataFrame, keys: list[str], templates: list[Template] = BASE + NOTICES) -> DataFrame:
    """docs (keys, text) -> keys, n_words, places: array of (label, base, start, score), one row for every row of docs."""
    spark = docs.sparkSession
    split = docs.select(*keys, words_of(text_of()).alias("w"))
    df = document_frequencies(split, sorted({w for t in templates for w in t.text.split()}))
    postings = anchor_postings(templates, df)
    index = F.create_map(*[x for word, rows in postings.items() for x in (F.lit(word), F.array(*[F.struct(F.lit(n).alias("t"), F.lit(p).alias("p")) for n, p in rows]))])
    details = F.array(*[
        F.struct(
            F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.array(*map(F.lit, t.text.split())).alias("words"),
            F.lit(_key_place(t)).alias("key_place"), F.array(*map(F.lit, t.key.split())).alias("key"),
            F.lit(min(AGREE, len(set(t.key.split())))).alias("agree"),
        ) for t in templates
    ])
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).isin(list(postings)))
    rows = split.select(*keys, "w", F.size("w").cast("long").alias("n_words"), F.when(F.size("w") > 0, at).otherwise(F.array().cast("array<int>")).alias("at"))
    # The places of one document's anchors are few: looking up and intersecting them needs no shuffle.
    starts = F.flatten(F.transform("at", lambda i: F.transform(F.element_at(index, F.get("w", i)), lambda x: F.struct(x["t"].alias("t"), (i - x["p"]).alias("start")))))
    return _verified(rows.withColumn("starts", F.array_sort(starts)), keys, details)


def _verified(rows: DataFrame, keys: list[str], details: Column) -> DataFrame:
    """starts is sorted: anchors that agree lie beside each other, so that one look ahead counts them."""

    def agreed(s: Column, i: Column) -> Column:
        first = (i == 0) | (F.get("starts", i - 1) != s)
        return first & (F.get("starts", i + F.get(details, s["t"])["agree"] - 1) == s)

    def place(s: Column) -> Column:
        d = F.get(details, s["t"])
        key_stands = (s["start"] >= -d["key_place"]) & (F.slice("w", F.greatest(s["start"] + d["key_place"], F.lit(0)) + 1, F.size(d["key"])) == d["key"])
        hit = F.size(F.filter(F.sequence(F.lit(0), F.size(d["words"]) - 1), lambda k: F.coalesce(F.get("w", s["start"] + k) == F.get(d["words"], k), F.lit(False))))
        return F.when(key_stands, F.struct(d["label"].alias("label"), d["base"].alias("base"), s["start"].alias("start"), (hit / F.size(d["words"])).alias("score")))

    found = F.filter(F.transform(F.filter("starts", agreed), place), lambda x: x.isNotNull() & (x["score"] >= LEAST_SCORE))
    return rows.select(*keys, "n_words", found.alias("places"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    base = F.filter("places", lambda p: p["base"])
    named = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["start"])).cast("long").alias("last_word"),
        named(base).alias("base_labels"), named(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )


def _sql_list(text: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"


#: Every place of every key phrase, without an index.
OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), t(label, base, words, key_place, key) AS (
  VALUES {", ".join(f"('{t.label}', {str(t.base).lower()}, {_sql_list(t.text)}, {_key_place(t)}, {_sql_list(t.key)})" for t in BASE + NOTICES)}
), c AS (
  SELECT doc_id, label, base, words, w,
         unnest(list_filter(range(len(w)), lambda i: w[i + 1] = key[1] AND w[i + 1:i + len(key)] = key)) - key_place AS start FROM d, t
), s AS (
  SELECT doc_id, label, base, start, len(list_filter(range(len(words)), lambda k: start + k >= 0 AND w[start + k + 1] = words[k + 1])) / len(words) AS score FROM c
), g AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM s WHERE score >= {LEAST_SCORE} GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN g USING (doc_id)
"""
