import uuid

import pytest
from pyspark.sql import functions as F

from stackroom.functions import analyze, vectors
from stackroom.functions import text as X


@pytest.fixture(scope="module")
def one(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first().v

    return value


def vec(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_vectors(one):
    a, b = vec(3, 4), vec(0, 0)
    assert one(vectors.norm(a)) == 5
    assert one(vectors.normalize(a)) == pytest.approx([0.6, 0.8])
    assert one(vectors.normalize(b)) == [0, 0]
    assert one(vectors.cosine(a, b)) == 0
    assert one(vectors.euclidean(a, b)) == 5
    assert one(vectors.dot(a, vec(1, 2, 3))) is None
    with pytest.raises(Exception, match="differ in length"):
        one(vectors.dot(a, vec(1, 2, 3), strict=True))
    assert one(vectors.resize(a, 3)) == [3, 4, 0]
    assert one(vectors.resize(a, 1)) == [3]
    assert one(vectors.to_dimension(vec(3, 4, 9), 2)) == pytest.approx([0.6, 0.8])
    assert one(vectors.equal_within(a, vec(3, 4.0000001))) is True
    assert one(vectors.equal_within(a, vec(3))) is False


def test_repeats(one):
    assert one(X.collapse_repeated_words(F.lit("a a b B\nb b c"))) == "a b B\nb c"
    assert one(X.collapse_repeated_phrases(F.lit("one two One two x x y"))) == "one two x y"


def test_strikethrough(one):
    assert one(X.remove_strikethrough(F.lit("<html><s>a</s><del>b</del></html>"))) == "<html>ab</html>"
    assert one(X.remove_strikethrough(F.lit("# t\n~~x~~"))) == "# t\nx"
    assert one(X.remove_strikethrough(F.lit("~x~ y"))) == "x y"


def test_ids_and_checksums(one):
    text = "Some  Text"
    assert one(X.uuid5(F.lit(text))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "sometext"))
    assert one(X.uuid5(F.lit("  "))) == str(uuid.UUID(int=0))
    assert one(X.verify_checksum(F.lit(text), F.md5(F.lit(text)))) is True
    assert one(X.verify_checksum(F.lit(text), F.lit("0"))) is False


def test_pieces_of_text(one):
    assert one(X.overlap_concat(F.lit("abcd"), F.lit("cdef"))) == "abcdef"
    assert one(X.overlap_concat(F.lit("ab"), F.lit("xy"))) == "abxy"
    marks = {"a. b\nc": 4, "a. b\nc. d": 6, "a!\n\nb": 2, "a\n\n\nb": 3, "a\n\n\n\n": 3, "a;b": 1, "a.": 1}
    assert {s: one(X.last_delimiter(F.lit(s))) for s in marks} == marks
    assert one(X.last_delimiter(F.lit("none"))) == -1
    assert one(X.title_from_text(F.lit("\n## Title \nx"))) == "Title"
    assert one(X.title_from_name(F.lit("C:\\in\\a-b_c.md"))) == "a b c"
    assert one(X.metadata_line(F.lit("a: 1 | b: x:y | a: 2"))) == {"a": "2", "b": "x:y"}
    assert [tuple(p) for p in one(X.question_answers(F.lit("Q: one?\nA: yes\n more\nQ: two?\nA: no")))] == [("one?", "yes more"), ("two?", "no")]


def test_dates(one):
    assert str(one(X.long_date(F.lit("Lei de 1º de abril de 2021")))) == "2021-04-01"
    assert str(one(X.long_date(F.lit("3 DE MARÇO DE 1999")))) == "1999-03-03"
    assert one(X.long_date(F.lit("3 de nada de 1999"))) is None
    assert one(X.long_date(F.lit("no date"))) is None


def test_formats(one):
    mime = lambda s: one(X.detect_format(F.encode(F.lit(s), "UTF-8")))
    assert mime("%PDF-1.4") == "application/pdf"
    assert mime("<!DOCTYPE html><html>") == "text/html"
    assert mime("# head\ntext") == "text/markdown"
    assert mime("plain words") == "text/plain"


def test_query_parsing(one):
    q = one(analyze.parse_query(F.lit('Ação AND "Carta Magna" -velho NOT antigo norma')))
    assert q.terms == ["acao", "norma"] and q.phrases == [["carta", "magna"]] and q.excluded == ["velho", "antigo"]


def test_stems(one):
    stem = lambda w: one(analyze.stem(F.lit(w)))
    assert stem("documentos") == stem("documento") == "document" and stem("casas") == stem("casa") and stem("rapidamente") == "rapid" and stem("normais") == "normal" and stem("homens") == "homem"


def test_sql_functions(spark):
    from stackroom.functions import sql

    sql.register(spark)
    row = spark.sql(
        "SELECT cosine_similarity_of(array(3, 4), array(4, 3)) AS c, cosine_similarity_of(array(0), array(1)) AS z, euclidean_distance(array(0, 0), array(3, 4)) AS e, token_estimate('a b  c d') AS t, fold_accents('AÇÃO') AS f"
    ).first()
    assert (round(row.c, 6), row.z, row.e, row.t, row.f) == (0.96, 0, 5, 6, "acao")


def test_sql_rows_need_no_join(spark, small):
    """A text's sentences, words and chunks are made where it is read: no join back by the text, no shuffle."""
    from stackroom.plans.registry import QUERIES

    import __spark_entry__  # noqa: F401  registers the queries

    for name in ("t1d_sql_sentences", "t4f_sql_chunks"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
    rows = spark.sql("SELECT w.* FROM (SELECT words_in('Água e  Pão') AS found) LATERAL VIEW inline(found) w AS pos, word").collect()
    assert [tuple(r) for r in rows] == [(0, "agua"), (1, "e"), (2, "pao")]


def collapsed_by_hand(text):
    """The repeat that ends first, of these the shortest, until there is none."""
    words = text.split()
    while True:
        found = next(((end, n) for end in range(2, len(words) + 1) for n in range(1, end // 2 + 1) if [w.lower() for w in words[end - n : end]] == [w.lower() for w in words[end - 2 * n : end - n]]), None)
        if found is None:
            return " ".join(words)
        del words[found[0] - found[1] : found[0]]


def test_repeats_go_to_the_fixpoint(spark):
    import random

    pick = random.Random(3)
    texts = [" ".join(pick.choice("abAB"[: pick.randint(1, 4)] + "c") for _ in range(pick.randint(0, 40))) for _ in range(300)]
    phrase = "one two three four five six seven"
    texts += ["abelha abelha abelha rainha rainha abelha rainha", f"{phrase} {phrase.upper()} end", f"x {phrase} y x {phrase} y"]
    assert [X.without_repeats(t) for t in texts] == [collapsed_by_hand(t) for t in texts]
    assert X.without_repeats("  a\n b  A\tB c \n") == "  a\n b c \n" and X.without_repeats(" \n") == " \n" and X.without_repeats("") == ""
    rows = spark.createDataFrame([("a a",), (None,), ("",)], "t string").select(X.collapse_repeated_phrases(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == ["a", None, ""]


def test_repeats_in_long_texts_take_little_time():
    import time

    lines = " ".join(f"the same line again number {i} and more of it" for i in range(1000))
    began = time.time()
    assert X.without_repeats(lines) == lines and X.without_repeats("a " * 50_000) == "a "
    assert time.time() - began < 60


def test_fold_of_letters_and_marks(spark):
    row = spark.range(1).select(X.fold(F.lit("ŐŰ șț Ǎ e\u0301 ø ẞ Ñandú İ")).alias("f")).first()
    assert row.f == "ou st a e ø ß nandu i"


def test_last_delimiter_of_long_texts_takes_little_time(spark):
    import time

    texts = ["x" * 400_000, "." + "y" * 400_000, "a\n\n\n\n" + "z" * 400_000, "a\n\n\nb", ""]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(X.last_delimiter(F.col("t")).alias("at"))
    began = time.time()
    assert [r["at"] for r in rows.collect()] == [-1, 0, 3, 3, -1, None]
    assert time.time() - began < 30
