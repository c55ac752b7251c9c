import re

from stackroom.llm import licenses as L

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def base_places(text):
    w = words(text)
    return sorted((i, t.label) for t in L.BASE for i in range(len(w)) if w[i : i + len(t.text.split())] == t.text.split())


TEXTS = [
    None, "", "nothing here", "CC BY", "cc by cc-by CC.BY", "all rights reserved all rights reserved.", "GNU General Public License", "general public\nlicense general public",
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Kcc by", "by cc by", "ﬁn ccé by",
    "word " * 50_000 + "all rights reserved", "cc by " * 3000,
]


def test_base_places_and_labels(spark, docs_of):
    rows = {r.doc_id: r for r in L.scan(docs_of(list(enumerate(TEXTS))), ["doc_id"]).collect()}
    for i, text in enumerate(TEXTS):
        assert rows[i].n_words == len(words(text))
        assert sorted((p.start, p.label) for p in rows[i].places if p.base) == base_places(text)
    named = {i: {p.label for p in rows[i].places} for i in rows}
    assert named[8] == {"apache-2.0"} and named[9] == {"mit"} and named[10] == {"cc-by", "cc-by-nc"}


def test_key_phrase_is_mandatory(spark, docs_of):
    docs = docs_of([(1, "released under the mit licence"), (2, "xx released under a mit license")])
    rows = {r.doc_id: [(p.label, round(p.score, 2)) for p in r.places] for r in L.scan(docs, ["doc_id"]).collect()}
    assert rows == {1: [], 2: [("mit", 0.8)]}


def test_abbreviated_notices_are_found(spark, docs_of):
    """Words that notices leave out are the rarest of their templates."""
    texts = ["CC BY-NC 4.0", "cc by sa 4 0", "x CC BY-ND 4.0", "xx xx xx mit license", "released and the mit license"]
    rows = {r.doc_id: {p.label for p in r.places} for r in L.scan(docs_of(list(enumerate(texts))), ["doc_id"]).collect()}
    assert rows == {0: {"cc-by", "cc-by-nc"}, 1: {"cc-by", "cc-by-sa"}, 2: {"cc-by", "cc-by-nd"}, 3: set(), 4: {"mit"}}


def test_abbreviated_notices_equal_sql(spark, docs_of):
    import duckdb

    con = duckdb.connect()
    texts = ["CC BY-NC 4.0", "CC BY-SA 4.0, twice: CC BY-SA 4.0", "and the MIT license", "GNU General Public License version 3", "no license"]
    docs = docs_of(list(enumerate(texts)))
    con.register("documents", docs.toArrow())
    wanted = con.sql(f"SELECT doc_id, labels FROM ({L.OP9_SQL.strip()})").fetchall()
    got = L.scan(docs, ["doc_id"]).collect()
    assert {r.doc_id: ",".join(sorted({p.label for p in r.places})) for r in got} == dict(wanted)


def test_query_equals_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in L.op9_license_scan(spark, small).collect():
        places = base_places(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (len(words(texts[r.doc_id])), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_empty_table(spark, docs_of):
    assert L.scan(docs_of([]), ["doc_id"]).isEmpty()
