"""Column expressions on titles, names, tags, links, headings and tables of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PLACEHOLDER, WS, collapse, count

# What headings begin with, what ends a sentence after a link, limits of hand-edited metadata.
HEADING = r"(?i)^(?:[0-9]+(?:\.[0-9]+)*\.?|[IVXLC]+\.?|[A-Z]\.)[ \t]+[^ \t]|^(?:abstract|references|acknowledge?ments|appendix)\b"
LINK = r"https?://[^ \t\n\r\f\x0B)】」*]+"
LINK_END = "[.,;:!?。，；]+$"
AUTHOR_BREAK = r"[,;，；\n]|[ \t\n\r\f\x0B]+and[ \t\n\r\f\x0B]+"
NUMBER_CELL = r"^[(\[$€£±+−-]*[0-9][0-9.,]*[%)\]]*[,;:]?$"
MAX_TEXT, MAX_SHORT, MAX_TAG, MAX_TAGS = 500, 200, 32, 20


def normal_query(text: Column) -> Column:
    return F.trim(collapse(F.lower(text)))


def plain_title(text: Column) -> Column:
    """A title without placeholders and bold, raised or lowered marks; lowered text is set off by a space."""
    out = F.regexp_replace(F.regexp_replace(text, PLACEHOLDER, " "), r"\*\*", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\^([^^]*)\^", "$1"), "~([^~]*)~", " $1")
    return F.trim(collapse(out))


def without_bold(text: Column) -> Column:
    """White space collapsed and trimmed, without bold marks; all other signs stay."""
    return collapse(F.regexp_replace(text, r"\*\*", ""))


def note_file_name(title: Column, year: Column, paper_id: Column) -> Column:
    """A file name of up to 60 letters, digits and Han characters of the title (else 8 of the id), and the year."""
    base = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "-")
    base = F.substring(F.regexp_replace(base, "^-+|-+$", ""), 1, 60)
    slug = F.when(base == "", F.substring(paper_id, 1, 8)).otherwise(base)
    return F.concat(slug, F.when(year > 0, F.concat(F.lit("-"), year.cast("string"))).otherwise(""), F.lit(".md"))


def links(text: Column) -> Column:
    """Addresses in a text, without the punctuation that ends a sentence."""
    return F.transform(F.regexp_extract_all(text, F.lit(LINK), 0), lambda u: F.regexp_replace(u, LINK_END, ""))


def is_heading(text: Column, font_size: Column, body: Column) -> Column:
    """Short lines set clearly larger than the body, or numbered or named as headings at body size; no arXiv stamps."""
    numbered = (font_size >= body) & text.rlike(HEADING)
    return (F.char_length(text) <= 120) & ~text.rlike("(?i)^arxiv:[0-9]") & ((font_size >= body * 1.15) | numbered)


def heading_level(text: Column) -> Column:
    """How many parts the leading section number has; 1 without one."""
    return F.size(F.split(F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)*)", 1), r"\.")).cast("long")


def is_text_table(text: Column) -> Column:
    """Prose in a table's place: forty words, and few cells that are numbers or few digits among the letters."""
    tokens = F.filter(F.split(text, WS), lambda t: t != "")
    words = F.size(F.filter(tokens, lambda t: t.rlike("[A-Za-z]{2,}")))
    numbers = F.size(F.filter(tokens, lambda t: t.rlike(NUMBER_CELL)))
    letters, digits = count(text, "[A-Za-z]"), count(text, "[0-9]")
    return (words >= 40) & ((numbers * 100 <= words * 35) | (letters * 10 >= (letters + digits) * 8))


def split_authors(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, AUTHOR_BREAK), lambda a: F.trim(collapse(a))), lambda a: a != "")


def normal_tags(tags: Column) -> Column:
    """Tags without leading #, the first of those that differ in case alone, twenty at most."""
    cut = F.transform(tags, lambda t: F.trim(F.regexp_replace(F.substring(F.trim(collapse(t)), 1, MAX_TAG), "^#+", "")))
    cut = F.filter(cut, lambda t: t != "")
    lower = F.transform(cut, lambda t: F.lower(t))
    return F.slice(F.filter(cut, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1), 1, MAX_TAGS)


def short_text(text: Column, size: int = MAX_TEXT) -> Column:
    """White space collapsed and trimmed, cut to ``size``; null for nothing."""
    out = F.trim(collapse(text))
    return F.when(out != "", F.substring(out, 1, size))


def legal_year(year: Column) -> Column:
    return F.when(year.between(1000, 2999), year)


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over code points (equal to one over UTF-16 units inside the basic plane)."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(2166136261), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


def map_version(terms: Column) -> Column:
    """A number for the content of a map, whatever the order of its entries; 0 for an empty one."""
    entries = F.array_sort(F.map_entries(terms))
    joined = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")
    return F.when(F.size(terms) == 0, F.lit(0).cast("long")).otherwise(fnv1a32(joined))
