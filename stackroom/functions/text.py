"""String, JSON, hash and date functions of the document engine, as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# --- counting -------------------------------------------------------------------------------------------------------


def word_count(text: Column) -> Column:
    """Runs of non-space characters."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def token_estimate(text: Column) -> Column:
    """Three words are about four tokens; rounded up."""
    return F.ceil(word_count(text) / F.lit(0.75)).cast("long")


def chunk_tokens(text: Column) -> Column:
    """The chunker's estimate, rounded down."""
    return F.floor(word_count(text) / F.lit(0.75)).cast("long")


def tokens_from_chars(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(3.8)).cast("long")


# --- cleaning -------------------------------------------------------------------------------------------------------


def collapse_repeated_words(text: Column) -> Column:
    """Runs of the same word within a line become one; upper and lower case differ."""
    return F.regexp_replace(text, r"(?m)(?<!\S)(\S+)(?:[ \t]+\1)+(?!\S)", "$1")


#: For sums over words, by which stretches of words are compared.
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def without_repeats(text: str) -> str:
    """A text without any phrase that follows itself, whatever its case and length: of XX the second X goes, with the white
    space before its words, until nothing changes.

    Words are taken one by one. What is kept has no repeat, so that a new word can only end one; its length is the distance
    to an earlier place of the same word, and the nearest is tried first. Sums over the words so far tell repeats at once,
    whatever their length.
    """
    pieces = re.split(r"(\s+)", text)
    kept: list[str] = []
    folded: list[str] = []
    sums, powers = [0], [1]
    places: dict[str, list[int]] = {}
    for gap, word in zip(["", *pieces[1::2]], pieces[0::2], strict=True):
        if not word:
            continue
        low, at = word.lower(), len(folded)
        kept.append(gap + word), folded.append(low), sums.append((sums[-1] * _BASE + hash(low)) % _PRIME)
        if len(powers) < len(sums):
            powers.append(powers[-1] * _BASE % _PRIME)
        earlier = places.setdefault(low, [])
        for place in reversed(earlier):
            n = at - place
            if 2 * n > at + 1:
                break
            if n > 1 and folded[at - 1] != folded[place - 1]:
                continue
            # The last n words, and the n before them.
            if (sums[at + 1] - sums[place + 1] * powers[n] - sums[place + 1] + sums[place + 1 - n] * powers[n]) % _PRIME == 0 and folded[place + 1 :] == folded[place + 1 - n : place + 1]:
                for gone in folded[place + 1 : at]:
                    places[gone].pop()
                del kept[place + 1 :], folded[place + 1 :], sums[place + 2 :]
                break
        if len(folded) == at + 1:
            earlier.append(at)
    return "".join(kept) + (pieces[-2] if len(pieces) > 1 and not pieces[-1] else "")


def collapse_repeated_phrases(text: Column) -> Column:
    """without_repeats over a column, by Arrow batches: no regular expression finds repeats of any length in bounded time."""

    @pandas_udf("string")
    def collapsed(texts: pd.Series) -> pd.Series:
        return texts.map(without_repeats, na_action="ignore")

    return collapsed(text)


# What marks a text as Markdown.
MARKDOWN_PATTERNS = [
    r"^#{1,6}\s", r"(?m)^\s*[-*+]\s", r"(?m)^\s*\d+\.\s", r"\[.+?\]\(.+?\)", r"(?m)^>\s", r"`[^`]+`", r"(?m)^```", r"\*\*[^*]+\*\*",
    r"\*[^*]+\*", r"!\[.+?\]\(.+?\)",
]


def is_markdown(text: Column) -> Column:
    found = F.lit(False)
    for pattern in MARKDOWN_PATTERNS:
        found = found | text.rlike(pattern)
    return F.coalesce(found, F.lit(False))


def is_html(text: Column) -> Column:
    return F.coalesce(F.lower(F.substring(text, 1, 256)).contains("<html"), F.lit(False))


def remove_strikethrough(text: Column) -> Column:
    """HTML strike tags are unwrapped, ~~x~~ of Markdown and ~x~ of plain text lose their marks."""
    html = F.regexp_replace(text, r"(?i)</?(s|strike|del)(\s[^>]*)?>", "")
    markdown = F.regexp_replace(text, r"~~(.*?)~~", "$1")
    plain = F.regexp_replace(text, r"~(.*?)~", "$1")
    return F.when(is_html(text), html).when(is_markdown(text), markdown).otherwise(plain)


def normal_form(text: Column) -> Column:
    """Lower case, single spaces, trimmed: what checksums compare."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def trim_junk(text: Column) -> Column:
    """Leading and trailing list marks and pieces of JSON are cut."""
    lead = r"^(?:\s|[-*,{}\[\]:#\"]|(?:10|[1-9])(?:\.| ))+"
    tail = r"(?:\s|[-*,{}\[\]:#\"])+$"
    return F.regexp_replace(F.regexp_replace(text, lead, ""), tail, "")


def _accents() -> tuple[str, str]:
    """Latin letters whose decomposition is an ASCII letter and marks, and that letter; then the marks, which have none."""
    letters = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isascii() and base.isalpha() and all(unicodedata.combining(m) for m in marks):
            letters[chr(code)] = base
    return "".join(letters) + "".join(map(chr, range(0x300, 0x370))), "".join(letters.values())


ACCENTED, UNACCENTED = _accents()


def fold(text: Column) -> Column:
    """Without accents, in lower case; combining marks go, too."""
    return F.lower(F.translate(text, ACCENTED, UNACCENTED))


def contains_folded(text: Column, part: Column | str) -> Column:
    return fold(text).contains(fold(F.lit(part) if isinstance(part, str) else part))


def starts_with_folded(text: Column, part: Column | str) -> Column:
    return fold(text).startswith(fold(F.lit(part) if isinstance(part, str) else part))


# --- titles, pieces -------------------------------------------------------------------------------------------------


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def title_from_name(path: Column) -> Column:
    """A file's name without its folder and extension, dashes and underscores as spaces."""
    name = F.regexp_replace(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), r"\.[^.]*$", "")
    return F.translate(name, "-_", "  ")


def title_from_text(text: Column) -> Column:
    """The first line that isn't empty, is under 200 characters, and stripped of heading marks."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "^#+", "")))
    good = F.filter(lines, lambda x: (x != "") & (F.length(x) < 200))
    return F.coalesce(F.get(good, F.lit(0)), F.lit("Untitled Document"))


def overlap_concat(a: Column, b: Column) -> Column:
    """a and b, with the longest end of a that begins b only once."""
    longest = F.least(F.length(a), F.length(b))
    starts = F.filter(F.sequence(F.lit(0), longest), lambda n: F.right(a, n) == F.left(b, n))
    return F.concat(a, F.substr(b, F.array_max(starts) + 1))


def last_delimiter(text: Column) -> Column:
    """Place (from 0) where the last mark begins: a blank line (two line ends), a line end, ! . or ;. -1 without any. Of
    the line ends of a run, the first and second are one mark, then the next two."""
    # Sought from the end: a pattern for what follows the last mark would be tried at every place, each time up to the next.
    tail = text
    for mark in "\n!.;":
        tail = F.substring_index(tail, mark, -1)
    last = F.length(text) - F.length(tail) - 1
    upto = F.left(text, last + 1)
    run = F.length(upto) - F.length(F.rtrim(upto, F.lit("\n")))
    return F.when((run > 0) & (run % 2 == 0), last - 1).otherwise(last).cast("int")


def keyword_sections(text: Column, keywords: list[str]) -> Column:
    """map keyword -> text from its first place to the next keyword's, without the keyword and marks around it."""
    place = {k: F.locate(k.lower(), F.lower(text)) for k in keywords}
    entries = []
    for k in keywords:
        after = F.array_min(F.array(*[F.when(place[o] > place[k], place[o]) for o in keywords], F.length(text) + 1))
        body = F.substring(text, place[k] + len(k), after - place[k] - len(k))
        body = F.regexp_replace(F.regexp_replace(F.trim(body), r"^[:{\s]+", ""), r"[-*}\s]+$", "")
        entries.append(F.when(place[k] > 0, F.struct(F.lit(k).alias("key"), body.alias("value"))))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def metadata_line(line: Column) -> Column:
    """k: v | k: v -> map; cut at bars, then at the first colon; the last of equal keys wins."""
    parts = F.filter(F.split(line, r"\|"), lambda p: p.contains(":"))
    entry = lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.substr(p, F.locate(":", p) + 1)).alias("value"))
    entries = F.transform(parts, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def question_answers(text: Column) -> Column:
    """array of (question, answer) from lines Q: and A:; lines after an answer continue it."""
    blocks = F.filter(F.split(F.regexp_replace(text, r"(?m)^\s*Q:", "\u0001"), "\u0001"), lambda b: b.rlike(r"(?m)^\s*A:"))
    question = lambda b: F.trim(F.regexp_extract(b, r"(?s)^([^\n]*)", 1))
    answer = lambda b: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(b, r"(?sm)^\s*A:(.*)", 1), r"(?m)^\s*A:", ""), r"\s*\n\s*", " "))
    pairs = F.transform(blocks, lambda b: F.struct(question(b).alias("question"), answer(b).alias("answer")))
    return F.filter(pairs, lambda p: p["answer"] != "")


# --- checksums, ids -------------------------------------------------------------------------------------------------


def checksums(text: Column) -> list[Column]:
    raw = F.encode(text, "UTF-8")
    return [F.crc32(raw).alias("crc32"), F.md5(raw).alias("md5"), F.sha2(raw, 256).alias("sha256")]


def verify_checksum(text: Column, digest: Column) -> Column:
    """The digest's length tells its kind: up to 10 CRC-32 (hex or decimal), up to 40 MD5, up to 70 SHA-256."""
    raw, given = F.encode(text, "UTF-8"), F.lower(F.trim(digest))
    crc = F.crc32(raw)
    short = (given == F.lower(F.hex(crc))) | (given == F.lpad(F.lower(F.hex(crc)), 8, "0")) | (given == crc.cast("string"))
    return F.when(F.length(given) <= 10, short).when(F.length(given) <= 40, given == F.md5(raw)).when(F.length(given) <= 70, given == F.sha2(raw, 256)).otherwise(F.lit(False))


# Fixed value: the namespace of names.
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def cleaned_for_id(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def uuid5(text: Column, namespace: str = NAMESPACE) -> Column:
    """Name-based UUID (SHA-1) of the text without white space, in lower case; the zero UUID for an empty text."""
    name = F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(cleaned_for_id(text), "UTF-8"))
    h = F.sha1(name)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda start, n: F.substring(h, start, n)
    made = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))
    return F.when(F.coalesce(cleaned_for_id(text), F.lit("")) == "", F.lit("00000000-0000-0000-0000-000000000000")).otherwise(made)


def text_sha256(text: Column) -> Column:
    return F.sha2(F.encode(cleaned_for_id(text), "UTF-8"), 256)


# --- formats, enums, dates ------------------------------------------------------------------------------------------


def detect_format(content: Column) -> Column:
    """MIME type by the first bytes of a binary column."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.lower(F.trim(F.decode(F.substring(content, 1, 256), "ISO-8859-1")))
    return (
        F.when(head.startswith("25504446"), "application/pdf")
        .when(head.startswith("D0CF11E0"), "application/msword")
        .when(head.startswith("504B0304"), "application/vnd.openxmlformats-officedocument")
        .when(head.startswith("7B5C727466"), "application/rtf")
        .when(text.startswith("<?xml") & ~text.contains("<html"), "application/xml")
        .when(text.contains("<html") | text.startswith("<!doctype html"), "text/html")
        .when(text.rlike(r"^[\[{]\s*[\"\[{}\]0-9]"), "application/json")
        .when(is_markdown(text), "text/markdown")
        .otherwise("text/plain")
    )


def format_family(mime: Column) -> Column:
    return F.when(mime == "application/pdf", "pdf").when(mime.rlike("msword|officedocument|rtf"), "office").otherwise("text")


def decode_enum(code: Column, names: dict[str, str]) -> Column:
    """Description of a code, found without regard to case and accents."""
    out = F.lit(None).cast("string")
    for key, name in names.items():
        out = F.when(fold(F.trim(code)) == fold(F.lit(key)), F.lit(name)).otherwise(out)
    return out


# Month names of Portuguese long dates.
MONTHS = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]


def long_date(text: Column) -> Column:
    """A date such as "1º de abril de 2021" anywhere in the text."""
    pattern = r"(?i)(\d{1,2})[ºo°]?\s+de\s+(\p{L}+)\s+de\s+(\d{4})"
    month = F.array_position(F.array(*[fold(F.lit(m)) for m in MONTHS]), fold(F.regexp_extract(text, pattern, 2)))
    made = F.try_make_date if hasattr(F, "try_make_date") else F.make_date
    return F.when(text.rlike(pattern) & (month > 0), made(F.regexp_extract(text, pattern, 3).cast("int"), month.cast("int"), F.regexp_extract(text, pattern, 1).cast("int")))


def merge_metadata(a: Column, b: Column) -> Column:
    """Keys of b win."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def contains_any(text: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p.lower()) for p in parts]), lambda p: F.lower(text).contains(p))


def index_in(value: Column, values: list[str]) -> Column:
    """Place from 0, else -1."""
    return (F.array_position(F.array(*map(F.lit, values)), value) - 1).cast("int")


def least_positive(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.least(a, b)).when(a > 0, a).when(b > 0, b).otherwise(F.lit(-1))


def quoted(text: Column) -> Column:
    """A JSON string."""
    return F.substr(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)
