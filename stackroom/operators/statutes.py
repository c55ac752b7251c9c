"""Legal texts as tables of lines: heading classes, articles with their place in the hierarchy, and article parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stackroom.functions.text import long_date
from stackroom.operators.relational import carry_forward, running_total

# What begins each level of a Brazilian statute.
LEVELS = [
    ("livro", 1, r"(?i)^\s*LIVRO\s+[IVX\d]+"), ("titulo", 2, r"(?i)^\s*T[ÍI]TULO\s+[IVX\d]+"), ("capitulo", 3, r"(?i)^\s*CAP[ÍI]TULO\s+[IVX\d]+"),
    ("secao", 4, r"(?i)^\s*SE[ÇC][ÃA]O\s+[IVX\d]+"), ("subsecao", 5, r"(?i)^\s*SUBSE[ÇC][ÃA]O\s+[IVX\d]+"), ("artigo", 6, r"(?i)^\s*Art(?:igo)?\.?\s+\d+"),
]
OUTER = [name for name, _, _ in LEVELS[:-1]]
PARAGRAPH, INCISO = r"^\s*(?:§|Parágrafo único)", r"^\s*(?:[IVXL]+\s*[-–]|[a-z]\))"
VOID = r"(?i)\((?:vetado|revogad[oa])\b[^)]*\)|^\s*(?:§\s*\d+[ºo]?\s*)?\(?(?:vetado|revogad[oa])\)?\.?\s*$"
END_MARK = r"(?i)este texto não substitui|\bbrasília,"


def level_of(line: Column) -> tuple[Column, Column]:
    """(name, number) of the level that a line begins; null for other lines."""
    name, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    for tag, level, pattern in reversed(LEVELS):
        name, number = F.when(line.rlike(pattern), F.lit(tag)).otherwise(name), F.when(line.rlike(pattern), F.lit(level)).otherwise(number)
    return name, number


def article_number(line: Column) -> Column:
    return F.regexp_extract(line, r"(?i)^\s*Art(?:igo)?\.?\s+(\d+)", 1).try_cast("int")


def article_letter(line: Column) -> Column:
    """The letter of a lettered article, as in "Art. 76-A"; else empty."""
    return F.upper(F.regexp_extract(line, r"(?i)^\s*Art(?:igo)?\.?\s+\d+[ºo°]?-([A-Z]{1,2})\b", 1))


def statute_header(text: Column) -> list[Column]:
    """type, number and date from the first lines."""
    head = F.regexp_extract(text, r"(?is)\b(lei complementar|lei|decreto-lei|decreto|medida provis[óo]ria|constitui[çc][ãa]o)\b", 1)
    number = F.regexp_extract(text, r"(?i)N[ºo°.]*\s*(\d[\d.]*)", 1)
    return [F.lower(head).alias("tipo"), F.replace(number, F.lit("."), F.lit("")).alias("numero"), long_date(text).alias("data"), text.rlike(r"(?i)revogad[oa]\s+pel").alias("revogado")]


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    return rows.select(key, F.col("n").cast("long").alias("n"), F.trim("line").alias("line")).where("line <> ''")


def classified(lines: DataFrame, key: str) -> DataFrame:
    """lines with tag, and, carried forward, the outer levels, the article's number and its order in the text.

    Lines after the end mark are dropped, but not where more than ten follow: there an annex begins.
    """
    name, _ = level_of(F.col("line"))
    rows = lines.withColumn("tag", name)
    ends = F.when(F.col("line").rlike(END_MARK), F.col("n"))
    marks = rows.groupBy(key).agg(F.min(ends).alias("_end"), F.max("n").alias("_last")).where("_end IS NOT NULL")
    rows = rows.join(marks, key, "left").where(F.col("_end").isNull() | (F.col("n") < F.col("_end")) | (F.col("_last") - F.col("_end") > 10)).drop("_end", "_last")
    rows = rows.withColumns({level: F.when(F.col("tag") == level, F.col("line")) for level in OUTER})
    carried = carry_forward(rows, key, "n", OUTER)
    starts = F.when(F.col("tag") == "artigo", 1).otherwise(0)
    named = carried.drop(*OUTER).withColumns({level: F.col(f"{level}_now") for level in OUTER}).drop(*[f"{level}_now" for level in OUTER])
    return running_total(named, key, "n", starts, "article_seq")


def articles(lines: DataFrame, key: str) -> DataFrame:
    """key, article_seq, artigo (number), letra, the outer levels, conteudo; in_order says whether numbers, and the letters
    of one number, only rise."""
    own = classified(lines, key).where("article_seq > 0 AND (tag IS NULL OR tag = 'artigo')")
    grouped = own.groupBy(key, "article_seq").agg(
        F.array_sort(F.collect_list(F.struct("n", "line"))).alias("rows"), *[F.min_by(level, "n").alias(level) for level in OUTER]
    )
    made = grouped.select(key, F.col("article_seq").cast("long").alias("article_seq"), article_number(F.get("rows.line", F.lit(0))).alias("artigo"), article_letter(F.get("rows.line", F.lit(0))).alias("letra"), *OUTER, F.array_join("rows.line", "\n").alias("conteudo"))
    place = F.struct("artigo", F.length("letra"), "letra")
    before = F.lag(place).over(Window.partitionBy(key).orderBy("article_seq"))
    return made.withColumn("in_order", F.coalesce(place > before, F.lit(True)))


def without_comment(line: Column) -> Column:
    """Without parenthesised remarks at the end."""
    return F.trim(F.regexp_replace(F.trim(line), r"(?:\s*\([^()]*\))+$", ""))


def article_parts(arts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part_no, part: the whole article, with context, its caput with context, then every line with context and
    the lines ending in ":" that introduce it. Void lines are dropped."""
    context = F.trim(F.concat_ws(" ", *OUTER))
    lines = F.transform(F.split("conteudo", "\n"), without_comment)
    rows = arts.select(*keys, "conteudo", context.alias("context"), F.posexplode(lines).alias("i", "line"))
    # Only the first line needs the whole article, which would be sorted as often as the article has lines.
    rows = rows.withColumn("conteudo", F.when(F.col("i") == 0, F.col("conteudo")))
    rows = rows.where((F.col("i") == 0) | ~F.col("line").rlike(VOID))
    opens = F.col("line").endswith(":")
    is_par, is_inc = F.col("line").rlike(PARAGRAPH), F.col("line").rlike(INCISO)
    upto = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("par_run", F.sum(F.when(is_par, 1).otherwise(0)).over(upto))
    inside = Window.partitionBy(*keys, "par_run").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    from_par = F.last(F.when(is_par & opens, F.col("line")), ignorenulls=True).over(inside)
    from_inc = F.last(F.when(is_inc & opens, F.col("line")), ignorenulls=True).over(inside)
    from_art = F.when(F.col("par_run") == 0, F.last(F.when((F.col("i") == 0) & opens, F.col("line")), ignorenulls=True).over(inside))
    rows = rows.withColumns({"from_art": from_art, "from_par": from_par, "from_inc": F.when(~is_par, from_inc)})
    emitted = rows.where((F.col("i") == 0) | ~(opens & (is_par | is_inc)))
    whole = F.replace("conteudo", F.lit("\n"), F.lit(" "))
    text = F.concat_ws(" ", F.when(F.col("context") != "", F.col("context")), "from_art", "from_par", "from_inc", "line")
    pieces = F.when(F.col("i") == 0, F.array(whole, F.trim(F.concat_ws(" ", "context", whole)), F.trim(F.concat_ws(" ", "context", "line")))).otherwise(F.array(text))
    return emitted.select(*keys, "i", F.posexplode(pieces).alias("p", "part")).select(*keys, (F.col("i") * 3 + F.col("p")).cast("long").alias("part_no"), "part")


def article_chapters(arts: DataFrame, key: str, name: str, most: int = 512 * 4) -> DataFrame:
    """Articles of the same place grouped to chapters: titulo, conteudo, and a representative beginning."""
    title = F.concat(F.col(name).cast("string"), F.lit(" - "), F.concat_ws("/", *OUTER[1:]))
    grouped = arts.groupBy(key, title.alias("titulo")).agg(F.min("article_seq").alias("first_article"), F.array_sort(F.collect_list(F.struct("article_seq", "conteudo"))).alias("rows"))
    text = F.array_join("rows.conteudo", "\n")
    return grouped.select(key, "titulo", "first_article", text.alias("conteudo"), F.left(text, F.lit(most)).alias("representativo"))
