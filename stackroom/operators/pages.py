"""Text, metadata and links of HTML pages, by regular expressions on the column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.functions.text import contains_folded

# Named entities that occur in plain text.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def decode_entities(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def html_text(html: Column) -> Column:
    """Blocks become lines, headings stand apart; scripts, styles and navigation go."""
    body = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|head|noscript)\b.*?</\1\s*>", " ")
    body = F.regexp_replace(body, r"(?i)<h[1-6]\b[^>]*>|</h[1-6]\s*>", "\n\n")
    body = F.regexp_replace(body, r"(?i)<br\s*/?>|</?(p|div|li|tr|ul|ol|table|article|section|header|footer|main)\b[^>]*>", "\n")
    body = decode_entities(F.regexp_replace(body, r"(?s)<[^>]*>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"[ \t\r\f]+", " "), r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def html_title(html: Column) -> Column:
    return F.trim(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def meta_content(html: Column, name: str) -> Column:
    """content of <meta name=...>, whichever attribute comes first; empty if there is none."""
    ahead = F.regexp_extract(html, rf"""(?is)<meta\s[^>]*name=["']?{name}["']?[^>]*content=["']([^"']*)""", 1)
    behind = F.regexp_extract(html, rf"""(?is)<meta\s[^>]*content=["']([^"']*)["'][^>]*name=["']?{name}["']?""", 1)
    return F.when(ahead != "", ahead).otherwise(behind)


def html_charset(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?is)<meta\s[^>]*charset=["']?([\w-]+)""", 1)


def html_metadata(html: Column) -> list[Column]:
    return [
        html_title(html).alias("title"), meta_content(html, "description").alias("descricao"), meta_content(html, "keywords").alias("palavras_chave"),
        meta_content(html, "author").alias("autor"), html_charset(html).alias("charset"),
    ]


def links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, texto, url of the distinct anchors of each page."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)(<a\s[^>]*href=["'][^"']*["'][^>]*>.*?</a>)"""), 1)
    rows = pages.select(key, F.explode(found).alias("a"))
    text = F.trim(F.regexp_replace(decode_entities(F.regexp_replace("a", r"(?s)<[^>]*>", "")), r"\s+", " "))
    return rows.select(key, text.alias("texto"), F.regexp_extract("a", r"""(?is)href=["']([^"']*)""", 1).alias("url")).distinct()


def links_with_words(found: DataFrame, words: list[str]) -> DataFrame:
    """Links whose text has any of the words, without regard to case and accents."""
    wanted = F.lit(False)
    for word in words:
        wanted = wanted | contains_folded(F.col("texto"), word)
    return found.where(wanted)


#: (class, words of which the link's text has one), tried in order; links of class revoked are dropped.
REFERENCE_RULES = [("revoked", ("revogad",)), ("regulation", ("regulament",)), ("vide_decree", ("vide decreto", "vide dec")), ("other_law", ("lei ", "lei n", "decreto"))]


def classify_references(found: DataFrame, rules=REFERENCE_RULES) -> DataFrame:
    kind = F.lit(None).cast("string")
    for name, words in reversed(rules):
        hit = F.lit(False)
        for word in words:
            hit = hit | contains_folded(F.col("texto"), word)
        kind = F.when(hit, F.lit(name)).otherwise(kind)
    return found.withColumn("kind", kind).where(F.col("kind").isNotNull() & (F.col("kind") != "revoked"))


def header_table(html: Column) -> list[Column]:
    """Summary (first paragraph of text) and links of a page's second table, where legal pages have their header fields."""
    tables = F.regexp_extract_all(html, F.lit(r"(?is)(<table\b.*?</table>)"), 1)
    second = F.get(tables, F.lit(1))
    return [F.trim(F.regexp_replace(html_text(second), r"(?s)\n.*", "")).alias("summary"), F.regexp_extract_all(second, F.lit(r"""(?is)href=["']([^"']*)"""), 1).alias("urls")]
