"""Splitting, routing, summarising and embedding plans of documents. Folds over a row's array; no text leaves its row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.functions.text import chunk_tokens, fold, word_count
from stackroom.operators.relational import if_small

# --- pieces ---------------------------------------------------------------------------------------------------------


def paragraphs(text: Column, separator: str = r"\n\s*\n") -> Column:
    return F.filter(F.transform(F.split(text, separator), lambda p: F.trim(p)), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Cut after . ! ? and at line ends; the tail stays."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def explode_pieces(df: DataFrame, keys: list[str], pieces: Column, name: str) -> DataFrame:
    """keys, position (from 0), piece."""
    return df.select(*keys, F.posexplode(pieces).alias("pos", name)).withColumn("pos", F.col("pos").cast("long"))


def packed(pieces: Column, most: int, size: Callable[[Column], Column] = F.length, joiner: str = " ") -> Column:
    """Pieces joined, in order, as long as a pack stays within `most`; a larger piece is a pack of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        fits = (acc["cur"] == "") | (size(acc["cur"]) + size(p) + len(joiner) <= most)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))).alias("done"),
            F.when(acc["cur"] == "", p).when(fits, F.concat(acc["cur"], F.lit(joiner), p)).otherwise(p).alias("cur"),
        )

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


# --- headings -------------------------------------------------------------------------------------------------------


# Patterns of heading lines, their tag (None: the mark is the tag, its length the level), and whether they
# count only between blank lines.
HEADING_LINES = [(r"^(#{1,6})\s+", None, False), (r"^[A-Z][A-Z\s]*$", "h1", True), (r"^\d+[.)]\s+", "numbered", False)]


def line_headings(line: Column, before: Column, after: Column) -> Column:
    """struct (tag, level, title) of a heading line, else null."""
    bare = F.trim(line)
    alone = (F.trim(F.coalesce(before, F.lit("x"))) == "") & (F.trim(F.coalesce(after, F.lit("x"))) == "")
    found = F.lit(None).cast("struct<tag:string,level:int,title:string>")
    for pattern, name, between_blanks in reversed(HEADING_LINES):
        mark = F.lit(name) if name else F.regexp_extract(bare, pattern, 1)
        level = F.lit(1) if name else F.length(mark)
        title = bare if name else F.trim(F.regexp_replace(bare, pattern, ""))
        fits = bare.rlike(pattern) & (alone if between_blanks else F.lit(True))
        found = F.when(fits, F.struct(mark.alias("tag"), level.cast("int").alias("level"), title.alias("title"))).otherwise(found)
    return found


def wiki_heading(line: Column) -> Column:
    """The deeper levels are tried first."""
    bare = F.trim(line)
    heading = lambda tag, level, title: F.struct(F.lit(tag).alias("tag"), F.lit(level).cast("int").alias("level"), title.alias("title"))
    named = F.trim(F.regexp_replace(bare, "=", ""))
    return (
        F.when(bare.rlike(r"^===\s*[^=].*===$"), heading("wiki-subsection", 3, named))
        .when(bare.rlike(r"^==\s*[^=].*==$"), heading("wiki-section", 2, named))
        .when(bare.rlike(r"^'''.+'''$"), heading("bold-title", 4, F.replace(bare, F.lit("'''"), F.lit(""))))
    )


def headings(lines: Column, merge_within: int = 3) -> Column:
    """array of (pos, tag, level, title); headings at most merge_within lines after the first of a run are joined to it."""
    found = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("pos"), line_headings(x, F.get(lines, i - 1), F.get(lines, i + 1)).alias("h"))), lambda r: r["h"].isNotNull()
    )
    flat = F.transform(found, lambda r: F.struct(r["pos"].alias("pos"), r["h"]["tag"].alias("tag"), r["h"]["level"].alias("level"), r["h"]["title"].alias("title")))
    kind = "array<struct<pos:int,tag:string,level:int,title:string>>"

    def step(acc: Column, h: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["pos"].alias("pos"), last["tag"].alias("tag"), last["level"].alias("level"), F.concat(last["title"], F.lit("\n"), h["title"]).alias("title"))
        near = F.coalesce(h["pos"] - last["pos"] <= merge_within, F.lit(False))
        return F.when(near, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(h)))

    return F.aggregate(flat, F.array().cast(kind), step)


def sections(lines: Column, found: Column) -> Column:
    """array of (title, level, text): what stands before the first heading ("" and 0), then each heading's lines."""
    first = F.coalesce(F.get(found, F.lit(0))["pos"], F.size(lines))
    part = lambda title, level, start, end: F.struct(title.alias("title"), level.alias("level"), F.array_join(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))), "\n").alias("text"))
    lead = F.array(part(F.lit(""), F.lit(0), F.lit(0), first))
    rest = F.transform(found, lambda h, i: part(h["title"], h["level"], h["pos"] + 1, F.coalesce(F.get(found, i + 1)["pos"], F.size(lines))))
    return F.filter(F.concat(lead, rest), lambda s: (s["level"] > 0) | (F.trim(s["text"]) != ""))


# --- token-budget chunks --------------------------------------------------------------------------------------------

#: Tokens of a chunk: closed beyond `ideal` once it has `least`; a paragraph above `most` is cut.
IDEAL, LEAST, MOST = 2000, 512, 8192
#: The budget of large chapters: chunk_rows(..., **LARGE).
LARGE = {"ideal": 8192, "least": 2048, "most": 32768}


def _cut_long(paragraph: Column, most: int) -> Column:
    """A paragraph above `most` tokens in runs of words; others as they are."""
    run = int(most * 0.75)
    starts = lambda words: F.sequence(F.lit(0), F.floor((F.size(words) - 1) / run).cast("int"))
    # The words are bound by a lambda over an array of one, so that they are split once, not for every run.
    cut = F.transform(F.array(F.split(F.trim(paragraph), r"\s+")), lambda words: F.transform(starts(words), lambda i: F.array_join(F.slice(words, i * run + 1, run), " ")))
    runs = F.get(cut, F.lit(0))
    return F.when(chunk_tokens(paragraph) > most, runs).otherwise(F.array(paragraph))


def with_chunks(df: DataFrame, text: Column, out: str = "chunks", separator: str = r"\n\s*\n", ideal: int = IDEAL, least: int = LEAST, most: int = MOST) -> DataFrame:
    """df with an array of (text, tokens). The fold collects where chunks start, not their texts; only the last chunk can
    be under `least`. Parts and starts are columns of their own, so that each is made once a row."""
    parts = F.flatten(F.transform(paragraphs(text, separator), lambda p: _cut_long(p, most)))
    rows = df.withColumn("_parts", F.transform(parts, lambda p: F.struct(p.alias("text"), chunk_tokens(p).alias("tokens"))))
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("cur"), F.lit(0).alias("i"))

    def step(acc: Column, tokens: Column) -> Column:
        closes = (acc["i"] == 0) | ((acc["cur"] + tokens > ideal) & (acc["cur"] >= least))
        return F.struct(
            F.when(closes, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(closes, tokens).otherwise(acc["cur"] + tokens).alias("cur"), (acc["i"] + 1).alias("i"),
        )

    rows = rows.withColumn("_starts", F.aggregate("_parts.tokens", start, step, lambda acc: acc["starts"]))

    def chunk(s: Column, i: Column) -> Column:
        own = F.slice("_parts", s + 1, F.coalesce(F.get("_starts", i + 1), F.size("_parts")) - s)
        joined = F.array_join(F.transform(own, lambda p: p["text"]), "\n")
        return F.struct(joined.alias("text"), F.aggregate(own, F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("tokens"))

    return rows.withColumn(out, F.transform("_starts", chunk)).drop("_parts", "_starts")


def chunk_rows(docs: DataFrame, keys: list[str], text: str, separator: str = r"\n\s*\n", **budget) -> DataFrame:
    """keys, ordem (from 1), texto, tokens. The outer explode keeps the optimizer from testing the chunks' number below
    the projections, which would make all of them several times."""
    made = with_chunks(docs, F.col(text), "_chunks", separator, **budget).select(*keys, F.posexplode_outer("_chunks").alias("pos", "c")).where("pos IS NOT NULL")
    return made.select(*keys, (F.col("pos") + 1).cast("long").alias("ordem"), F.col("c.text").alias("texto"), F.col("c.tokens").alias("tokens"))


def assembled_paragraphs(text: Column, most_words: int = 200) -> Column:
    """Lines joined to paragraphs at blank lines, long ones cut, short ones joined up to most_words."""
    joined = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " ")))
    cut = F.flatten(F.transform(F.filter(joined, lambda p: p != ""), lambda p: _cut_long(p, int(most_words / 0.75))))
    return packed(cut, most_words, lambda x: word_count(x).cast("int"), "\n")


# --- Markdown sections ----------------------------------------------------------------------------------------------

# A line with heading marks, a line that can be underlined, and the line under it.
MARKED, UNDERLINED, UNDER = r"^#{1,6}\s+\S", r"^\S", r"^(?:={3,}|-{3,})\s*$"
LEAD_TITLE = "Introduction"


def markdown_headings(lines: Column) -> Column:
    """array of (pos, next, title): lines with # marks, and lines underlined by === or ---; next is where text begins."""

    def at(line: Column, i: Column) -> Column:
        before, after = F.get(lines, i - 1), F.get(lines, i + 1)
        marked = line.rlike(MARKED)
        is_under = line.rlike(UNDER) & F.coalesce(before.rlike(UNDERLINED) & ~before.rlike(MARKED), F.lit(False))
        under = line.rlike(UNDERLINED) & F.coalesce(after.rlike(UNDER), F.lit(False)) & ~is_under
        title = F.trim(F.replace(line, F.lit("#"), F.lit("")))
        return F.when(marked | under, F.struct(i.alias("pos"), (i + F.when(marked, 1).otherwise(2)).alias("next"), title.alias("title")))

    return F.filter(F.transform(lines, at), lambda h: h.isNotNull())


def markdown_sections(lines: Column, found: Column) -> Column:
    """array of (title, text) between the headings, what comes first under LEAD_TITLE. Sections without text go."""
    part = lambda title, start, end: F.struct(title.alias("title"), F.regexp_replace(F.array_join(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))), "\n"), r"^\s+|\s+\z", "").alias("text"))
    lead = F.array(part(F.lit(LEAD_TITLE), F.lit(0), F.coalesce(F.get(found, F.lit(0))["pos"], F.size(lines))))
    rest = F.transform(found, lambda h, i: part(h["title"], h["next"], F.coalesce(F.get(found, i + 1)["pos"], F.size(lines))))
    return F.filter(F.concat(lead, rest), lambda s: s["text"] != "")


def merged_small(sections: Column, least: int = LEAST) -> Column:
    """array of (title, text, merged): a section under `least` tokens takes in the next one, which is then passed over."""
    kind = "array<struct<title:string,text:string,merged:boolean>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.lit(False).alias("open"), F.lit(1).alias("i"))

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc["done"], F.lit(-1))
        joined = F.struct(last["title"].alias("title"), F.concat(last["text"], F.lit("\n\n"), s["text"]).alias("text"), F.lit(True).alias("merged"))
        alone = F.struct(s["title"].alias("title"), s["text"].alias("text"), F.lit(False).alias("merged"))
        done = F.when(acc["open"], F.concat(F.slice(acc["done"], F.lit(1), F.greatest(F.size(acc["done"]) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc["done"], F.array(alone)))
        return F.struct(done.alias("done"), (~acc["open"] & (chunk_tokens(s["text"]) < least)).alias("open"), (acc["i"] + 1).alias("i"))

    return F.aggregate(sections, start, step, lambda acc: acc["done"])


def markdown_chunks(docs: DataFrame, keys: list[str], text: str, separator: str = r"\n\s*\n", least: int = LEAST, ideal: int = IDEAL, most: int = MOST) -> DataFrame:
    """keys, section, part (both from 1), titulo, texto, tokens. Texts are cut at Markdown headings, small sections joined
    to the next, and sections above `most` tokens cut at paragraphs; sections that were joined stay whole."""
    lines = docs.select(*keys, F.split(F.col(text), "\n").alias("_lines"))
    found = lines.withColumn("_found", markdown_headings(F.col("_lines")))
    cut = found.select(*keys, markdown_sections(F.col("_lines"), F.col("_found")).alias("_sections"))
    rows = cut.select(*keys, F.posexplode_outer(merged_small(F.col("_sections"), least)).alias("_pos", "_s")).where("_pos IS NOT NULL")
    sized = rows.withColumn("_tokens", chunk_tokens(F.col("_s.text")))
    chunked = with_chunks(sized, F.when((F.col("_tokens") > most) & ~F.col("_s.merged"), F.col("_s.text")), "_chunks", separator, ideal, least, most)
    whole = F.array(F.struct(F.col("_s.text").alias("text"), F.col("_tokens").alias("tokens")))
    pieces = chunked.select(*keys, "_pos", "_s.title", F.size("_chunks").alias("_n"), F.posexplode(F.when(F.size("_chunks") > 0, F.col("_chunks")).otherwise(whole)).alias("_part", "_c"))
    named = F.when(F.col("_n") > 1, F.concat("title", F.lit(" (Part "), (F.col("_part") + 1).cast("string"), F.lit(")"))).otherwise(F.col("title"))
    number = lambda c: (F.col(c) + 1).cast("long")
    return pieces.select(*keys, number("_pos").alias("section"), number("_part").alias("part"), named.alias("titulo"), F.col("_c.text").alias("texto"), F.col("_c.tokens").alias("tokens"))


# --- wiki text ------------------------------------------------------------------------------------------------------


def clean_wiki(text: Column) -> Column:
    """Comments, references and templates go; links and bold marks leave their text."""
    for pattern, into in [
        (r"(?s)<!--.*?-->", ""), (r"(?s)<ref[^>/]*/>|<ref[^>]*>.*?</ref>", ""), (r"\{\{[^{}]*\}\}", ""), (r"\{\{[^{}]*\}\}", ""),
        (r"(?i)\[\[(?:categoria|category|ficheiro|file|image)[^\]]*\]\]", ""), (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), (r"\[\[([^\]]*)\]\]", "$1"),
        (r"\[https?://\S+\s+([^\]]*)\]", "$1"), (r"'{2,3}([^'\n]+)'{2,3}(?!\s*$)", "$1"), (r"[ \t]+", " "),
    ]:
        text = F.regexp_replace(text, pattern, into)
    return F.trim(text)


def numbered_parts(text: Column, words: int = 2000) -> Column:
    """array of (title, text): parts of at most `words` words, named "Parte n"."""
    return F.transform(packed(paragraphs(text, r"\n+"), words, lambda x: word_count(x).cast("int"), "\n"), lambda p, i: F.struct(F.concat(F.lit("Parte "), (i + 1).cast("string")).alias("title"), p.alias("text")))


def wiki_chapters(docs: DataFrame, keys: list[str], title: str, text: str, words: int = 2000) -> DataFrame:
    """keys, ordem (from 1), level, titulo, texto: a chapter for each wiki or Markdown heading, with its line; a text
    without headings in parts of at most `words` words, called "title - Parte n" (level 0). As in the surveyed system, what
    stands before a text's first heading is in no chapter."""
    lines = docs.select(*keys, F.col(title).alias("_title"), F.col(text).alias("_text"), F.split(F.col(text), "\n").alias("_lines"))
    marked = lambda line: F.when(line.rlike(MARKED), F.struct(F.lit("#").alias("tag"), F.length(F.regexp_extract(line, "^#+", 0)).alias("level"), F.trim(F.regexp_replace(line, "^#+", "")).alias("title")))
    heading = lambda line, i: F.struct(i.alias("pos"), F.coalesce(marked(F.trim(line)), wiki_heading(line)).alias("h"))
    found = lines.withColumn("_found", F.filter(F.transform("_lines", heading), lambda x: x["h"].isNotNull()))
    after = lambda h, i: F.slice("_lines", h["pos"] + 2, F.coalesce(F.get("_found", i + 1)["pos"], F.size("_lines")) - h["pos"] - 1)
    body = lambda h, i: F.trim(F.concat(F.trim(F.get("_lines", h["pos"])), F.lit("\n"), clean_wiki(F.array_join(after(h, i), "\n"))))
    chapter = lambda h, i: F.struct(h["h"]["level"].alias("level"), h["h"]["title"].alias("titulo"), F.regexp_replace(body(h, i), r"\s+\z", "").alias("texto"))
    part = lambda p: F.struct(F.lit(0).alias("level"), F.concat("_title", F.lit(" - "), p["title"]).alias("titulo"), p["text"].alias("texto"))
    parts = F.transform(numbered_parts(clean_wiki(F.col("_text")), words), part)
    made = found.withColumn("_chapters", F.when(F.size("_found") > 0, F.transform("_found", chapter)).otherwise(parts))
    rows = made.select(*keys, F.posexplode_outer("_chapters").alias("_pos", "_c")).where("_pos IS NOT NULL")
    return rows.select(*keys, (F.col("_pos") + 1).cast("long").alias("ordem"), "_c.level", "_c.titulo", "_c.texto")


# --- routing --------------------------------------------------------------------------------------------------------

# Hosts, endings and words that tell a document's type.
HINT_HOSTS = {"normativo": ["planalto.gov.br", "in.gov.br", "legislacao"], "wikipedia": ["wikipedia.org", "wikimedia.org"]}
HINT_ENDINGS = {"wikipedia": [".wiki", ".wikitext"], "artigo": [".md", ".markdown"]}
NORM_WORDS = ["decreto", "resolução", "portaria", "normativa"]
WIKI_MARKS = ["categoria:", "{{", "[[", "]]"]
MANUAL_WORDS = ["manual", "instruções", "procedimento", "tutorial"]
CONTRACT_WORDS = ["contrato", "contratante", "cláusula", "partes"]
#: Words a chunk should have, by type of content.
CHUNK_SIZES = {"normativo": 1500, "livro": 2500, "artigo": 2000, "manual": 1800}
DEFAULT_CHUNK_SIZE = 2000


def _any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return out


def document_type(text: Column, hint: Column | None = None) -> Column:
    """A hint (url or file name) decides first, then words of the text. The lower-cased text is bound by a lambda over an
    array of one, so that it is made once, not for every word."""

    def told(low: Column) -> Column:
        return (
            F.when((low.contains("art.") & low.contains("lei")) | _any(low, NORM_WORDS), "normativo")
            .when(_any(low, WIKI_MARKS) | (low.contains("==") & low.contains("===")), "wikipedia")
            .when(_any(low, MANUAL_WORDS), "manual").when(_any(low, CONTRACT_WORDS), "contrato").otherwise("generico")
        )

    by_text = F.get(F.transform(F.array(F.lower(text)), told), F.lit(0))
    if hint is None:
        return by_text
    h, out = F.lower(hint), F.lit(None).cast("string")
    for kind, ends in reversed(HINT_ENDINGS.items()):
        for end in ends:
            out = F.when(h.endswith(end), F.lit(kind)).otherwise(out)
    for kind, hosts in reversed(HINT_HOSTS.items()):
        out = F.when(_any(h, hosts), F.lit(kind)).otherwise(out)
    return F.coalesce(out, by_text)


def with_chunk_size(docs: DataFrame, kind: str, library: str, overrides: DataFrame) -> DataFrame:
    """chunk_size: of the library (overrides: library, size), else of the type, else the default."""
    by_kind = F.lit(None).cast("int")
    for name, size in CHUNK_SIZES.items():
        by_kind = F.when(F.col(kind) == name, F.lit(size)).otherwise(by_kind)
    joined = docs.join(if_small(overrides.select(library, F.col("size").alias("_own"))), library, "left")
    return joined.withColumn("chunk_size", F.coalesce("_own", by_kind, F.lit(DEFAULT_CHUNK_SIZE))).drop("_own")


#: Splitters by document type, each a function of (docs, keys, text, separator) that gives keys, ordem, texto, tokens;
#: types that are not named are cut as "generico". Callers may add their own.
SPLITTERS: dict[str, Callable[[DataFrame, list[str], str, str], DataFrame]] = {
    "generico": lambda docs, keys, text, separator: chunk_rows(docs, keys, text, separator),
    "normativo": lambda docs, keys, text, separator: chunk_rows(docs, keys, text, r"\n(?=\s*Art\.)"),
    "wikipedia": lambda docs, keys, text, separator: chunk_rows(docs.withColumn(text, clean_wiki(F.col(text))), keys, text, separator),
}


def split_by_type(docs: DataFrame, keys: list[str], text: str, kind: str, separator: str = r"\n\s*\n", splitters: dict | None = None) -> DataFrame:
    """keys, kind, ordem, texto, tokens: each row of docs by the splitter of its type, column `kind`."""
    known = SPLITTERS if splitters is None else splitters
    others = [name for name in known if name != "generico"]
    out = None
    for name, split in known.items():
        # A filter names the type once, for what makes it may be put in its place.
        own = F.col(kind) == name if name != "generico" else ~F.coalesce(F.col(kind).isin(*others), F.lit(False))
        part = split(docs.where(own), [*keys, kind], text, separator)
        out = part if out is None else out.unionByName(part)
    return out


# --- embedding plans, vectors, summaries ----------------------------------------------------------------------------


#: What is embedded of a chapter: all with its title, the title only, the text only, chunks, or by its size.
MODES = ("full", "metadata", "text", "split", "auto")


def embedding_plan(chapters: DataFrame, keys: list[str], title: str, text: str, separator: str = r"\n\s*\n", small: int = LEAST, medium: int = IDEAL, mode: str = "auto") -> DataFrame:
    """keys, level, order_chapter, title, text of what is to be embedded. By size: small chapters with their title, medium
    ones as they are, larger ones in chunks. Chapters without text give nothing."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    chapters = chapters.where(F.trim(F.col(text)) != "")
    if mode in ("full", "metadata", "text"):
        whole = {"full": F.concat(title, F.lit("\n"), text), "metadata": F.col(title), "text": F.col(text)}[mode]
        level = "metadados" if mode == "metadata" else "capitulo"
        return chapters.select(*keys, F.lit(level).alias("level"), F.lit(1).cast("long").alias("order_chapter"), F.col(title).alias("title"), whole.alias("text"))
    if mode == "split":
        small = medium = -1
    counted = chapters.withColumn("_tokens", chunk_tokens(F.col(text)))
    sized = with_chunks(counted, F.when(F.col("_tokens") > medium, F.col(text)), "_chunks", separator)
    one = lambda t: F.array(F.struct(t.alias("text"), F.col("_tokens").alias("tokens")))
    pieces = F.when(F.col("_tokens") <= small, one(F.concat(title, F.lit("\n"), text))).when(F.col("_tokens") <= medium, one(F.col(text))).otherwise(F.col("_chunks"))
    rows = sized.withColumn("_cut", F.col("_tokens") > medium).select(*keys, title, "_cut", F.posexplode(pieces).alias("pos", "p"))
    name = F.when(F.col("_cut"), F.concat(title, F.lit(" - Chunk "), (F.col("pos") + 1).cast("string"))).otherwise(F.col(title))
    return rows.select(*keys, F.when(F.col("_cut"), "trecho").otherwise("capitulo").alias("level"), (F.col("pos") + 1).cast("long").alias("order_chapter"), name.alias("title"), F.col("p.text").alias("text"))


def _with_cells(docs: DataFrame, keep: list[str], text: str, dimension: int) -> DataFrame:
    """keep, _cells: array of (dim, n), a row's words counted by the first 32 bits of their MD5. The words' dimensions are
    sorted and cut where they change: nothing leaves the row."""
    words = F.filter(F.split(fold(F.col(text)), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    dims = F.transform(words, lambda w: F.conv(F.substring(F.md5(F.encode(w, "UTF-8")), 1, 8), 16, 10).cast("long") % dimension)
    ordered = docs.select(*keep, F.sort_array(F.coalesce(dims, F.array().cast("array<bigint>"))).alias("_dims"))
    places = F.when(F.size("_dims") > 0, F.sequence(F.lit(0), F.size("_dims") - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get("_dims", i) != F.get("_dims", i - 1)))
    cut = ordered.select(*keep, "_dims", starts.alias("_starts"))
    cell = lambda s, i: F.struct(F.get("_dims", s).alias("dim"), (F.coalesce(F.get("_starts", i + 1), F.size("_dims")) - s).cast("long").alias("n"))
    return cut.select(*keep, F.transform("_starts", cell).alias("_cells"))


_LENGTH = lambda: F.sqrt(F.aggregate("_cells", F.lit(0).cast("long"), lambda acc, c: acc + c["n"] * c["n"]))


def hash_features(docs: DataFrame, keys: list[str], text: str, dimension: int = 64) -> DataFrame:
    """keys, dim, value: term counts by the first 32 bits of a word's MD5, of length 1 for each row of docs."""
    counted = _with_cells(docs, keys, text, dimension).withColumn("_length", _LENGTH())
    # Not by explode: it has rows filtered by the size of the array first, for which all of it would be made within that filter.
    each = counted.select(*keys, "_length", F.explode_outer("_cells").alias("c")).where("c IS NOT NULL")
    return each.select(*keys, F.col("c.dim").alias("dim"), (F.col("c.n") / F.col("_length")).alias("value"))


def embed(docs: DataFrame, keys: list[str], text: str, model=None, dimension: int = 64) -> DataFrame:
    """keys, vector, one row for each of docs. model: a function of the text column (see model_function); the default hashes
    words into a vector, of zeros for a text without words."""
    if model is not None:
        return docs.select(*keys, model(F.col(text)).alias("vector"))
    counted = _with_cells(docs, keys, text, dimension).withColumn("_length", _LENGTH())
    # Bound by a lambda over an array of one: within the lambda of the dimensions the map and the length would be made for each.
    bound = F.array(F.struct(F.map_from_entries("_cells").alias("held"), F.col("_length").alias("length")))
    value = lambda b, i: F.coalesce(F.try_element_at(b["held"], i) / b["length"], F.lit(0.0)).cast("float")
    dims = F.sequence(F.lit(0).cast("long"), F.lit(dimension - 1).cast("long"))
    return counted.select(*keys, F.get(F.transform(bound, lambda b: F.transform(dims, lambda i: value(b, i))), F.lit(0)).alias("vector"))


#: Texts that a model is given at once.
MODEL_BATCH = 100


def model_function(load: Callable[[], Callable], batch: int = MODEL_BATCH):
    """A caller's model as a function of a text column. load() is called once in a worker and gives a function from an array
    of texts to a matrix of as many rows; it gets `batch` texts at most, and an empty text for a null."""
    from pyspark.ml.functions import predict_batch_udf

    made = predict_batch_udf(load, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    return lambda text: made(F.coalesce(text, F.lit("")))


def extractive_summary(text: Column, most: int = 800) -> Column:
    """Leading sentences, without their marks, of together at most most / 4 words, joined by ". "; else the beginning of
    the text. "..." follows unless it ends in a mark. A sentence has a word at least, so that no more than most / 4 count."""
    said = F.slice(F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.trim(s)), lambda s: s != ""), 1, most // 4 + 1)
    fold_words = lambda acc, s: F.struct((acc["words"] + word_count(s)).alias("words"), (acc["kept"] + F.when(acc["words"] + word_count(s) <= most // 4, 1).otherwise(0)).alias("kept"))
    kept = F.aggregate(said, F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("kept")), fold_words, lambda acc: acc["kept"])
    summary = F.trim(F.when(kept > 0, F.array_join(F.slice(said, F.lit(1), kept), ". ")).otherwise(F.left(text, F.lit(most))))
    return F.when(summary.rlike(r"[.!?]\z"), summary).otherwise(F.concat(summary, F.lit("...")))


# Telling words of a sentence, in the order in which they count; the question's beginning; the characters
# of the sentence that it takes; and whether only those after the word.
QUESTIONS = [("é", "O que ", 50, False), ("são", "O que ", 50, False), ("quando", "Quando ", 50, True), ("como", "Como ", 50, True), ("onde", "Onde ", 50, True)]
OTHER_QUESTION, OTHER_TAKEN, SUMMARY_QUESTION = "Sobre ", 30, "Qual é o resumo do documento?"


def simple_question(sentence: Column) -> Column:
    """A question about a sentence, by the first telling word of the table that it holds."""
    s = F.lower(F.trim(sentence))
    asked = lambda begin, said: F.concat(F.lit(begin), said, F.lit("?"))
    out = asked(OTHER_QUESTION, F.left(s, F.lit(OTHER_TAKEN)))
    for word, begin, taken, after in reversed(QUESTIONS):
        said = F.left(s, F.lit(taken))
        out = F.when(s.contains(word), asked(begin, F.substr(said, F.locate(word, s) + len(word)) if after else said)).otherwise(out)
    return out


def question_answer_pairs(docs: DataFrame, keys: list[str], text: str, k: int = 3) -> DataFrame:
    """keys, n, question, answer from the first k sentences of over 20 characters; fewer are padded with a short summary."""
    good = F.slice(F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 20), 1, k)
    pairs = F.transform(good, lambda s: F.struct(simple_question(s).alias("question"), s.alias("answer")))
    padded = F.when(F.size(pairs) < k, F.concat(pairs, F.array(F.struct(F.lit(SUMMARY_QUESTION).alias("question"), extractive_summary(F.col(text), 200).alias("answer"))))).otherwise(pairs)
    return docs.select(*keys, F.posexplode(padded).alias("pos", "p")).select(*keys, (F.col("pos") + 1).cast("long").alias("n"), "p.question", "p.answer")


def summary_rows(chapters: DataFrame, keys: list[str], title: str, text: str, least_tokens: int = LEAST, contextual: int = 4000) -> DataFrame:
    """A summary row for each chapter above least_tokens, and one with its title and beginning for texts above `contextual`."""
    rows = chapters.where(chunk_tokens(F.col(text)) > least_tokens).select(*keys, F.col(title).alias("title"), F.col(text).alias("_text"), extractive_summary(F.col(text)).alias("summary"))
    ratio = F.round(F.length("summary") / F.length("_text"), 6).alias("ratio")
    plain = rows.select(*keys, F.lit("resumo").alias("kind"), F.col("summary").alias("text"), ratio)
    hybrid = rows.where(F.length("_text") > contextual).select(*keys, F.lit("resumo_contexto").alias("kind"), F.concat("title", F.lit("\n"), "summary", F.lit("\n"), F.left("_text", F.lit(200))).alias("text"), ratio)
    return plain.union(hybrid)
