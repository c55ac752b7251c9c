import itertools
import random

import pytest
from pyspark.sql import functions as F

from stackroom.functions import analyze
from stackroom.operators import chunking as C
from stackroom.operators import pages as P
from stackroom.operators import relational as R
from stackroom.operators import search as S
from stackroom.operators import statutes as L
from stackroom.sources import index
from stackroom.sources import writes as W
from stackroom.sources.stored import settings


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (1, 1, "Ação civil", "a ação civil pública e a carta magna"), (2, 1, "Outra", "ação penal de magna carta"), (3, 1, "Carta", "carta magna do estado"),
        (4, 2, "Nada", "texto sem relação"), (5, 2, "Civil", "código civil e ação"), (6, 2, "Vazio", ""),
    ]
    docs = spark.createDataFrame(rows, "id long, library_id long, title string, text string")
    return analyze.postings(docs, [("title", "A"), ("text", "C")], ["id"])


def test_text_search(spark, corpus):
    terms = spark.createDataFrame([("acao",), ("civil",)], "term string")
    got = {r.id: r.text_rank for r in S.text_scores(corpus, terms, ["id"]).collect()}
    assert got == {1: 2.4, 2: 0.2, 5: 1.4}
    strict = {r.id for r in S.text_scores(corpus, terms, ["id"], "strict").collect()}
    assert strict == {1, 5}


def test_phrase_and_exclusion(spark, corpus):
    assert {r.id for r in S.phrase_matches(corpus, ["carta", "magna"], "id").collect()} == {1, 3}
    scored = S.text_scores(corpus, spark.createDataFrame([("acao",)], "term string"), ["id"])
    assert {r.id for r in S.exclude(scored, corpus, ["penal"], "id").collect()} == {1, 5}


def test_phrase_with_repeated_word(spark):
    rows = spark.createDataFrame([(1, "a a b"), (2, "a b a")], "id long, text string")
    index = analyze.postings(rows, [("text", "C")], ["id"])
    assert {(r.id, r.start) for r in S.phrase_matches(index, ["a", "a"], "id").collect()} == {(1, 0)}


def test_ranks_with_ties(spark):
    sem = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.2), (4, 0.9)], "id long, distance double")
    txt = spark.createDataFrame([(3, 5.0), (9, 4.0)], "id long, text_rank double")
    got = [(r.id, r.score) for r in S.hybrid_search(sem, txt, 2).collect()]
    # ranks 1, 2, 2 (4 lies beyond 2k = 4 only by rank), text ranks 1 and 2; k = 2
    assert got == [(3, round(0.6 / 4 + 0.4 / 3, 6)), (1, round(0.6 / 3, 6))]


def test_chunks_keep_all_words_and_budget(spark):
    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(120)) for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, ""), (4, "word " * 9000), (5, None)], "id long, text string")
    rows = C.chunk_rows(docs, ["id"], "text").collect()
    by = {i: [r for r in rows if r.id == i] for i in range(1, 6)}
    assert sum(len(r.texto.split()) for r in by[1]) == 40 * 120 and [r.ordem for r in by[1]] == list(range(1, len(by[1]) + 1))
    assert all(C.LEAST <= r.tokens <= C.MOST for r in by[1])
    assert [r.texto for r in by[2]] == ["short"] and by[3] == [] and by[5] == []
    assert sum(len(r.texto.split()) for r in by[4]) == 9000 and len(by[4]) > 1


def test_headings_and_sections(spark):
    text = "intro\n# One\nbody\nx\ny\nz\n1. Two\nend\n\nTHREE\n\nlast"
    row = spark.createDataFrame([(text,)], "text string").select(F.split("text", "\n").alias("lines"))
    found = row.withColumn("found", C.headings(F.col("lines"), merge_within=0))
    assert [(h.pos, h.level, h.title) for h in found.first().found] == [(1, 1, "One"), (6, 1, "1. Two"), (9, 1, "THREE")]
    parts = found.select(C.sections(F.col("lines"), F.col("found")).alias("s")).first().s
    assert [(p.title, p.text) for p in parts] == [("", "intro"), ("One", "body\nx\ny\nz"), ("1. Two", "end\n"), ("THREE", "\nlast")]
    merged = row.select(C.headings(F.col("lines")).alias("h")).first().h
    assert [h.title for h in merged] == ["One", "1. Two\nTHREE"]


def test_wiki(spark):
    text = "{{box|a}}Some [[Page|name]] and [[Other]]<ref>x</ref> <!-- c -->[http://a.b link]"
    assert spark.range(1).select(C.clean_wiki(F.lit(text))).first()[0] == "Some name and Other link"
    level = lambda s: spark.range(1).select(C.wiki_heading(F.lit(s)).alias("h")).first().h
    assert level("=== deep ===").level == 3 and level("== high ==").level == 2 and level("'''bold'''").level == 4 and level("text") is None


def test_pages(spark):
    html = '<html><head><title>T &amp; U</title><meta name="author" content="Ann"><meta charset="utf-8"></head><body><h1>H</h1><p>a<br>b</p><script>x()</script><a href="/u">Decreto <b>nº 1</b></a></body></html>'
    df = spark.createDataFrame([(1, html)], "id long, html string")
    row = df.select(P.html_text(F.col("html")).alias("text"), *P.html_metadata(F.col("html"))).first()
    assert row.text == "H\n\na\nb\n\nDecreto nº 1" or row.text.split() == ["H", "a", "b", "Decreto", "nº", "1"]
    assert (row.title, row.autor, row.charset) == ("T & U", "Ann", "utf-8")
    links = P.links(df, "id")
    assert [(r.texto, r.url) for r in links.collect()] == [("Decreto nº 1", "/u")]
    assert [r.kind for r in P.classify_references(links).collect()] == ["other_law"]


STATUTE = """LEI Nº 1.234, DE 5 DE MARÇO DE 2020
TÍTULO I
CAPÍTULO I
Art. 1º Primeiro:
I - um;
II - dois (Incluído).
§ 1º Vale:
a) isto
CAPÍTULO II
Art. 2º Segundo.
§ 1º (VETADO)
TÍTULO II
Art. 3º Terceiro."""


def test_statute(spark):
    lines = L.lines_of(spark.createDataFrame([(1, STATUTE)], "id long, text string"), "id", "text")
    arts = L.articles(lines, "id")
    got = {r.artigo: r for r in arts.collect()}
    assert sorted(got) == [1, 2, 3] and all(r.in_order for r in got.values())
    assert got[1].titulo == "TÍTULO I" and got[1].capitulo == "CAPÍTULO I" and got[2].capitulo == "CAPÍTULO II"
    assert got[3].titulo == "TÍTULO II" and got[3].capitulo is None
    parts = [r.part for r in L.article_parts(arts.where("artigo = 1"), ["id", "article_seq"]).orderBy("part_no").collect()]
    assert parts[2] == "TÍTULO I CAPÍTULO I Art. 1º Primeiro:"
    assert parts[3:] == ["TÍTULO I CAPÍTULO I Art. 1º Primeiro: I - um;", "TÍTULO I CAPÍTULO I Art. 1º Primeiro: II - dois (Incluído).", "TÍTULO I CAPÍTULO I § 1º Vale: a) isto"]
    void = [r.part for r in L.article_parts(arts.where("artigo = 2"), ["id", "article_seq"]).collect()]
    assert not any(p.endswith("(VETADO)") and p.startswith("TÍTULO I CAPÍTULO II §") for p in void)
    head = spark.range(1).select(*L.statute_header(F.lit(STATUTE))).first()
    assert (head.tipo, head.numero, str(head.data)) == ("lei", "1234", "2020-03-05")


def test_gaps_and_ordinals(spark):
    df = spark.createDataFrame([(1, 1), (1, 3), (2, 2), (3, 1)], "doc long, ordem long")
    assert {(r.doc, r.ordem) for r in R.gaps(df, "doc", "ordem").collect()} == {(1, 3), (2, 2)}
    groups = spark.createDataFrame([(1,), (9,)], "id long")
    assert {(r.id, r.next_ordinal) for r in R.next_ordinal(groups, "id", df, "doc", "ordem").collect()} == {(1, 4), (9, 1)}


def test_range_join_over_an_edge(spark):
    points = spark.createDataFrame([(5,), (99,), (100,)], "at long")
    spans = spark.createDataFrame([("a", 0, 100), ("b", 90, 101)], "name string, lo long, hi long")
    got = {(r.at, r.name) for r in R.range_join_dyadic(points, "at", spans, "lo", "hi", width=10).collect()}
    assert got == {(5, "a"), (99, "a"), (99, "b"), (100, "b")}


def test_upsert_and_soft_delete(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id long, v string, updated_at int")
    new = spark.createDataFrame([(1, "A", 1), (2, "B", 4), (3, "c", 0)], "id long, v string, updated_at int")
    assert {(r.id, r.v) for r in W.upsert(old, new).collect()} == {(1, "A"), (2, "b"), (3, "c")}
    gone = W.soft_delete(old, old.where("id = 1"), F.lit("2024-01-01").cast("timestamp"))
    assert {r.id for r in R.active(gone).collect()} == {2}
    assert W.restore(gone, old).where("deleted_at IS NOT NULL").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a-b.md").write_text("# head\ntext")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 \xff\xfe")
    got = {r.file_name: r for r in W.read_files(spark, str(tmp_path)).collect()}
    assert got["a-b.md"].texto == "# head\ntext" and got["a-b.md"].titulo == "a b" and got["c.pdf"].texto is None and got["c.pdf"].file_size_bytes == 11


def test_files_named_txt_are_plain_text(spark, tmp_path):
    for i, text in enumerate(["# head\ntext", "<html>", '{"a": 1}', "plain"]):
        (tmp_path / f"{i}.txt").write_text(text)
    (tmp_path / "5.txt").write_bytes(b"%PDF-1.4")
    assert [r.detected_format for r in W.read_files(spark, str(tmp_path)).orderBy("path").collect()] == ["text/plain"] * 4 + ["application/pdf"]


@pytest.mark.parametrize("broadcast", [1 << 23, 0])
def test_closure_shuffles_links_only(spark, monkeypatch, broadcast):
    """Least depths equal a search by hand; what is reached is told apart without another shuffle."""
    monkeypatch.setattr(W, "BROADCAST_LINKS", broadcast)
    rng = random.Random(4)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(1, 1), (2, 3), (2, 3)]
    links = spark.createDataFrame([*pairs, (None, 1), (1, None)], "src long, dst long")
    starts = spark.createDataFrame([(i,) for i in range(0, 44, 2)] + [(2,)], "id long")
    for depth in range(4):
        want = {(i, i): 0 for i in range(0, 44, 2)}
        for n in range(1, depth + 1):
            for (root, at), d in list(want.items()):
                if d == n - 1:
                    for src, dst in pairs:
                        if src == at:
                            want.setdefault((root, dst), n)
        made = W.reference_closure(starts, links, depth)
        assert {(r.root, r.id): r.depth for r in made.collect()} == want and made.count() == len(want)
    if broadcast:
        assert "hashpartitioning(root" not in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("depth", [2, 3])
def test_closure_without_broadcast_tells_apart_at_the_root(spark, monkeypatch, depth):
    """What is reached is not shuffled once it is made, only the arrays that it is made from."""
    monkeypatch.setattr(W, "BROADCAST_LINKS", 0)
    links = spark.range(500).selectExpr("id % 50 AS src", "id % 7 AS dst")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = W.reference_closure(spark.range(50), links, depth)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Generate")[0].split("\n", 1)[1]


def test_words_of_postings_are_made_once(spark, small):
    """No filter makes all words before the rows of words are made."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    for only in (None, ["the"]):
        plan = analyze.postings(docs, [("text", "C")], ["doc_id"], only=only)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("[^\\p{L}\\p{N}_]+") == 1


def test_every_stem_rule_has_its_ending():
    """The endings that let a word meet a stage's patterns let every word through that one of them fits."""
    for rules, ends in zip(analyze.STEM_STAGES, analyze.STEM_ENDS, strict=True):
        for pattern, _ in rules:
            tail = pattern.rsplit("})", 1)[1].rstrip("$").removeprefix("(?:").rstrip(")")
            found = list(tail.strip("[]")) if tail.startswith("[") else tail.split("|")
            assert found and all(tail.endswith(ends) for tail in found)


def test_postings_stream_equals_rebuild(spark, small):
    from stackroom.plans.registry import QUERIES

    import __spark_entry__  # noqa: F401

    streamed = QUERIES["st2_stream_postings"](spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rebuilt = analyze.postings(docs, [("text", "C")], ["doc_id"])
    assert streamed.exceptAll(rebuilt).isEmpty() and rebuilt.exceptAll(streamed).isEmpty()


def test_cover_ranks_against_all_stretches(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("a b c x y".split()) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("first", F.substring_index("text", " ", 1)).withColumn("rest", F.expr("substr(text, length(first) + 1)"))
    index_ = analyze.postings(docs, [("first", "A"), ("rest", "C")], ["id"])
    got = {r.id: r.text_rank for r in S.text_scores(index_, spark.createDataFrame([("a",), ("b",), ("c",)], "term string"), ["id"], "strict").collect()}
    for i, text in enumerate(texts):
        words = text.split()
        full = {(s, e) for s, e in itertools.combinations_with_replacement(range(len(words)), 2) if {"a", "b", "c"} <= set(words[s : e + 1])}
        shortest = [(s, e) for s, e in full if (s + 1, e) not in full and (s, e - 1) not in full]
        score = 0.0
        for s, e in shortest:
            inside = [p for p in range(s, e + 1) if words[p] in "abc"]
            score += len(inside) / sum(1.0 if p == 0 else 5.0 for p in inside) / (1 + (e - s + 1 - len(inside)))
        assert (i in got) == bool(shortest) and (not shortest or got[i] == pytest.approx(score, abs=2e-6))


def test_strict_ranks_of_a_table_of_queries(spark, corpus):
    terms = spark.createDataFrame([(1, "acao"), (1, "civil"), (2, "carta")], "query_id long, term string")
    got = {(r.query_id, r.id) for r in S.text_scores(corpus, terms, ["id"], "strict").collect()}
    assert got == {(1, 1), (1, 5), (2, 1), (2, 2), (2, 3)}


def test_analysed_search(spark):
    docs = spark.createDataFrame([(1, "as casas do rei"), (2, "casa de rei"), (3, "rei sem casa"), (4, "nada")], "id long, text string")
    found = lambda words: analyze.postings(docs, [("text", "C")], ["id"], analyze.STOP_WORDS, True, words)
    search = lambda q: {r.id for r in S.text_search(found, q, spark, ["id"], "broad", analyze.STOP_WORDS, True).collect()}
    assert search("a CASA") == {1, 2, 3} and search('"casas do rei"') == {1, 2} and search("casas -sem") == {1, 2} and search("de") == set()


def test_stored_index(spark, corpus, tmp_path):
    path = str(tmp_path / "index")
    index.write_index(corpus, path, "id", buckets=4)
    got = index.indexed_postings(spark, path, ["carta", "civil"], 4)
    wanted = corpus.where("term IN ('carta', 'civil')")
    assert got.select(*wanted.columns).exceptAll(wanted).isEmpty() and wanted.exceptAll(got.select(*wanted.columns)).isEmpty()
    assert {(r.term, r.df) for r in index.term_statistics(spark, path, 6, ["carta", "civil"], 4).collect()} == {("carta", 3), ("civil", 2)}
    assert index.indexed_postings(spark, path, ["missing"], 4).isEmpty() and index.indexed_postings(spark, path, [], 4).isEmpty()


def test_ties_at_the_edge_keep_their_rank(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 2.0, 2.0, 3.0, None])], "id long, v double")
    assert sorted((r.id, r["rank"]) for r in S.cut_with_ties(rows, "v", 2, True).collect()) == [(0, 1), (1, 2), (2, 2), (3, 2)]
    assert sorted((r.id, r["rank"]) for r in S.cut_with_ties(rows, "v", 3, False).collect()) == [(1, 2), (2, 2), (3, 2), (4, 1)]


def test_markdown_sections(spark):
    text = "lead\n# One #\nbody\n\nTwo\n===\n text \n---\nmore\n## Empty\n### Last\nend"
    lines = spark.createDataFrame([(text,), ("",), (None,)], "text string").select(F.split("text", "\n").alias("lines"))
    got = [r.s for r in lines.withColumn("found", C.markdown_headings(F.col("lines"))).select(C.markdown_sections(F.col("lines"), F.col("found")).alias("s")).collect()]
    assert [(s.title, s.text) for s in got[0]] == [("Introduction", "lead"), ("One", "body"), ("Two", "text \n---\nmore"), ("Last", "end")] and got[1] == [] and got[2] is None


def test_markdown_chunks(spark):
    words = lambda n, w="w": " ".join([w] * n)
    text = f"# a\n{words(3)}\n# b\n{words(30)}\n# c\n" + "\n\n".join([words(30, f"p{i}") for i in range(5)]) + f"\n# d\n{words(2)}"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")
    got = [(r.section, r.part, r.titulo, len(r.texto.split())) for r in C.markdown_chunks(docs, ["id"], "text", least=20, ideal=90, most=100).orderBy("section", "part").collect()]
    assert got == [(1, 1, "a", 33), (2, 1, "c (Part 1)", 60), (2, 2, "c (Part 2)", 60), (2, 3, "c (Part 3)", 30), (3, 1, "d", 2)]


def test_wiki_chapters(spark):
    docs = spark.createDataFrame([(1, "T", "lead\n== A ==\nx [[p|q]]\n=== B ===\ny\n'''C'''\nz"), (2, "U", "one two\nthree"), (3, "V", ""), (4, "W", None)], "id long, t string, text string")
    got = {(r.id, r.ordem): (r.level, r.titulo, r.texto) for r in C.wiki_chapters(docs, ["id"], "t", "text", 2).collect()}
    assert got == {
        (1, 1): (2, "A", "== A ==\nx q"), (1, 2): (3, "B", "=== B ===\ny"), (1, 3): (4, "C", "'''C'''\nz"), (2, 1): (0, "U - Parte 1", "one two"), (2, 2): (0, "U - Parte 2", "three"),
    }


def test_lettered_articles(spark):
    text = "Art. 76. a\nArt. 76-A. b\nArt. 76-B c\nArt. 77 d\nArt. 76-C e"
    got = [(r.artigo, r.letra, r.in_order) for r in L.articles(L.lines_of(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text"), "id").orderBy("article_seq").collect()]
    assert got == [(76, "", True), (76, "A", True), (76, "B", True), (77, "", True), (76, "C", False)]


def test_splitters_by_type(spark):
    docs = spark.createDataFrame([(1, "normativo", "Art. 1 a\nArt. 2 b"), (2, "wikipedia", "x [[p|q]]"), (3, "outro", "z"), (4, None, "n")], "id long, tipo string, text string")
    got = {(r.id, r.tipo, r.texto) for r in C.split_by_type(docs, ["id"], "text", "tipo").collect()}
    assert got == {(1, "normativo", "Art. 1 a\nArt. 2 b"), (2, "wikipedia", "x q"), (3, "outro", "z"), (4, None, "n")}


def test_article_parts_of_derived_statutes(spark, small):
    """Decomposition of every article against a loop over its lines."""
    import re

    from stackroom.plans.registry import Tables
    from stackroom.plans.texts import statute_texts

    arts = L.articles(L.lines_of(statute_texts(Tables(spark, small)), "doc_id", "text"), "doc_id")
    got = {}
    for r in L.article_parts(arts, ["doc_id", "article_seq"]).orderBy("part_no").collect():
        got.setdefault((r.doc_id, r.article_seq), []).append(r.part)
    for a in arts.collect():
        context = " ".join(x for x in (a.livro, a.titulo, a.capitulo, a.secao, a.subsecao) if x)
        whole = a.conteudo.replace("\n", " ")
        lines = [re.sub(r"(?:\s*\([^()]*\))+$", "", x.strip()).strip() for x in a.conteudo.split("\n")]
        out, art, par, inc = [whole, f"{context} {whole}".strip(), f"{context} {lines[0]}".strip()], lines[0] if lines[0].endswith(":") else "", "", ""
        for x in lines[1:]:
            if re.search(r"(?i)\((?:vetado|revogad[oa])\b[^)]*\)|^\s*(?:§\s*\d+[ºo]?\s*)?\(?(?:vetado|revogad[oa])\)?\.?\s*$", x):
                continue
            is_par, is_inc = bool(re.match(L.PARAGRAPH, x)), bool(re.match(L.INCISO, x))
            if is_par:
                art, par, inc = "", "", ""
            if not (x.endswith(":") and (is_par or is_inc)):
                out.append(" ".join(y for y in (context, art, par, "" if is_par else inc, x) if y))
            if x.endswith(":") and is_par:
                par = x
            elif x.endswith(":") and is_inc:
                inc = x
        assert got[a.doc_id, a.article_seq] == out


def test_a_line_of_an_article_does_not_carry_the_whole_article(spark):
    """Lines are sorted within their article: only its first one has its text."""
    import re

    arts = spark.createDataFrame([(1, 1, "Art. 1 Um:\nI - dois;\nIII - tres.")], "id long, article_seq long, conteudo string").withColumns({x: F.lit("") for x in L.OUTER})
    made = L.article_parts(arts, ["id", "article_seq"])
    below = made._jdf.queryExecution().optimizedPlan().toString().split("Window ")[-1]
    assert re.search(r"CASE WHEN \(i#\d+ = 0\) THEN conteudo#\d+ END", below)
    assert [r.part for r in made.orderBy("part_no").collect()][3:] == ["Art. 1 Um: I - dois;", "Art. 1 Um: III - tres."]


def test_hash_vectors_make_a_text_s_counts_once(spark):
    """Neither the map of counts nor their length is made for each dimension, nor a lower-cased text for each word."""
    docs = spark.createDataFrame([(1, "Uma casa, a Casa")], "id long, text string")
    plan = C.embed(docs, ["id"], "text", dimension=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" in plan and "element_at(map_from_entries" not in plan
    vector = C.embed(docs, ["id"], "text", dimension=8).first().vector
    assert len(vector) == 8 and abs(sum(x * x for x in vector) - 1) < 1e-6
    routed = docs.select(C.document_type(F.col("text")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert routed.count("lower(") == 1


def shuffled_rows(spark) -> int:
    """Rows that all stages of the session have shuffled so far."""
    gateway = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    none = spark._jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(spark._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_stored_index_shuffles_no_postings(spark, tmp_path):
    from stackroom.sources import index

    texts = [(i % 40, f"w{i} the the of\nw{i} the rest é{i}" if i % 9 else None) for i in range(400)]
    docs = spark.createDataFrame(texts, "id long, text string").select("id", F.substring_index("text", "\n", 1).alias("first"), F.substring_index("text", "\n", -1).alias("rest"))
    fields, path, other = [("first", "A"), ("rest", "C")], str(tmp_path / "texts"), str(tmp_path / "postings")
    before = shuffled_rows(spark)
    index.write_texts(docs, path, "id", fields, buckets=4)
    # A row for each document, and the counts of each task's terms, for df and for their buckets.
    held = analyze.postings(docs, fields, ["id"])
    assert shuffled_rows(spark) - before < 400 + 3 * held.select("term").distinct().count() + 40 < held.count()
    index.write_index(held, other, "id", buckets=4)
    columns = ["id", "term", "pos", "label"]
    for made in (path, other):
        saved = spark.read.parquet(f"{made}/postings").select(*columns)
        assert sorted(map(tuple, saved.collect())) == sorted(map(tuple, held.select(*columns).collect()))
        # Several rows of one id are one document.
        df = {r.term: r.df for r in index.term_statistics(spark, made, 40, buckets=4).collect()}
        assert df == {r.term: r.df for r in held.groupBy("term").agg(F.countDistinct("id").alias("df")).collect()}
