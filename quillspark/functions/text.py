"""Column functions on text: everything here stays inside Spark's expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

WS = r"[ \t\n\r\f\x0B]+"
PLACEHOLDER = r"⟦f(\d+)⟧"
SCRIPT_MARK = r"\^[^\s^~]{1,16}\^|~[^\s~^]{1,16}~"


def ascii_edges(pattern: str) -> str:
    r"""The pattern with \b between ASCII letters, digits and _ and other signs; Java's own \b knows more letters."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is made once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WS, " "))


def clamp(text: Column, size: int) -> Column:
    return F.substring(collapse(text), 1, size)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def repeat_key(text: Column) -> Column:
    return F.lower(collapse(F.regexp_replace(text, r"[0-9]+", "#")))


def dehyphenated(text: Column) -> Column:
    return F.regexp_replace(text, rf"([a-zA-Z])-{WS}([a-zA-Z])", "$1$2")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(dehyphenated(text)), F.lit(r"([a-z0-9]+|[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}])"), 1)


def adjacent(tokens: Column) -> Column:
    """Pairs of neighbours. The tokens are not named inside a lambda, where they would be made anew for each element."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def features(tokens: Column) -> Column:
    return F.concat(tokens, adjacent(tokens))


def script_counts(text: Column) -> dict[str, Column]:
    return {
        "han": count(text, r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"),
        "kana": count(text, r"[\x{3040}-\x{30ff}]"),
        "hangul": count(text, r"[\x{ac00}-\x{d7af}]"),
        "latin": count(text, r"[A-Za-z\x{c0}-\x{24f}]"),
    }


def text_language(text: Column) -> Column:
    """Script ratios first, then function words (at least two, four in a hundred words); English otherwise."""
    said = {lang: words.split() for lang, words in fixed.FUNCTION_WORDS.items()}
    bare = F.lower(F.regexp_replace(text, r"(?i)\bet[ \t\n\r]+al\b\.?", " "))
    words = F.filter(F.split(bare, r"[^\p{L}]+"), lambda w: w != "")
    among = lambda s: lambda w: w.isin(*s)
    counted = lambda w: F.struct(F.size(w).alias("n"), *[F.size(F.filter(w, among(s))).alias(lang) for lang, s in said.items()])

    def latin(c: Column) -> Column:
        # of languages with enough words the one with most; of equals the first
        enough = lambda lang: (c[lang] >= fixed.HIT_WORDS) & (c[lang] / c["n"] >= fixed.HIT_SHARE) & (c["n"] >= fixed.SHORT_TEXT)
        told = F.array(*[F.when(enough(lang), F.struct(c[lang].alias("hits"), F.lit(-i).alias("first"), F.lit(lang).alias("lang"))) for i, lang in enumerate(said)])
        return F.coalesce(F.array_max(told)["lang"], F.lit("en"))

    def told(c: Column) -> Column:
        cjk = c["han"] + c["kana"] + c["hangul"]
        asian = F.when(c["hangul"] >= cjk * 0.3, "ko").when(c["kana"] >= cjk * 0.15, "ja").otherwise("zh")
        return F.when((cjk > 0) & (cjk >= c["latin"] / 4), asian).otherwise(let(let(words, counted), latin))

    return let(F.struct(*[n.alias(k) for k, n in script_counts(text).items()]), told)


def cjk_dominant(text: Column) -> Column:
    cjk = count(text, r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]")
    return (cjk > 0) & (cjk >= count(text, "[A-Za-z]") / 4)


def token_estimate(text: Column) -> Column:
    wide = r"[\x{3000}-\x{9fff}\x{f900}-\x{faff}]"
    words = count(F.regexp_replace(text, wide, " "), r"[^ \t\n\r\f\x0B]+")
    return F.floor(count(text, wide) + words * F.lit(1.3) + F.lit(0.5)).cast("long")


def reference_entry(text: Column) -> Column:
    """Looks like an entry of a bibliography: dated, not too long, and a numbered list of names or a venue after a title in capitals."""

    def told(t: Column) -> Column:
        title = F.regexp_extract(t, r"(?s)^(.*?)(?:\.\s|\z)", 1)
        words, capitals = count(title, r"\S+"), count(title, r"(?<!\S)[A-Z]")
        named = t.rlike(fixed.ENTRY_NUMBER) & t.rlike(ascii_edges(fixed.ENTRY_NAMES))
        published = (words >= 2) & (capitals >= fixed.ENTRY_CAPITALS * words) & t.rlike(ascii_edges(fixed.ENTRY_VENUE))
        return (F.char_length(t) <= fixed.ENTRY_LONGEST) & t.rlike(ascii_edges(fixed.ENTRY_YEAR)) & (named | published)

    return let(F.trim(text), told)


def skip_translation(text: Column, target: str) -> Column:
    none = ~text.rlike("[A-Za-z]{2,}") & ~text.rlike(r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]")
    return none | (text_language(text) == target) | reference_entry(text)


def formula_fragment(text: Column) -> Column:
    """A piece of a formula: each bound of length has its own evidence."""

    def told(t: Column) -> Column:
        evidence = {
            fixed.FORMULA_TINY: F.lit(True),
            fixed.FORMULA_SHORT: t.rlike(fixed.FORMULA_SIGNS) & (count(t, "[a-zA-Z]{4,}") <= fixed.FORMULA_WORDS),
            fixed.FORMULA_LONG: t.rlike(fixed.FORMULA_RELATION) & (count(t, ascii_edges(r"\b[A-Z]\b")) >= fixed.FORMULA_CAPITALS),
        }
        return (t != "") & reduce(Column.__or__, [(F.char_length(t) <= longest) & found for longest, found in evidence.items()])

    return let(F.trim(text), told)


def numeric_noise(text: Column) -> Column:
    words = F.filter(F.split(text, WS), lambda w: w != "")
    numbers = F.size(F.filter(words, lambda w: w.rlike(r"^[-+(]?[0-9][0-9.,%)]*$")))
    return (F.size(words) >= 8) & (numbers >= 0.6 * F.size(words))


def ends_mid_sentence(text: Column) -> Column:
    """Prose whose last sign closes no sentence."""
    told = lambda t: (F.char_length(t) >= fixed.OPEN_LENGTH) & ~F.contains(F.lit(fixed.CLOSING_SIGNS), F.right(t, F.lit(1))) & (count(t, ascii_edges(r"\b[a-z]{3,}\b")) >= fixed.OPEN_WORDS) & ~t.rlike(ascii_edges(fixed.LINK_AT_END))
    return let(F.regexp_replace(text, r"[\s*^~]+$", ""), told)


def starts_mid_sentence(text: Column) -> Column:
    """Begins as the rest of a sentence does, and is neither a link nor an item of a list."""
    return text.rlike(rf"^[\s*]*+(?!{fixed.LINK_AT_START}|{fixed.LIST_LABEL})(?:{fixed.GOES_ON})")


def inline_tokens(text: Column) -> Column:
    """Sorted placeholders and script marks of a text; most texts have none, and patterns run only on those with a sign of the kind."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(PLACEHOLDER), 1), lambda n: F.concat(F.lit("formula:"), F.regexp_replace(n, "^0+(?=.)", "")))
    marks = F.regexp_extract_all(text, F.lit(SCRIPT_MARK), 0)
    placed, marked = F.contains(text, F.lit("⟦f")), F.contains(text, F.lit("^")) | F.contains(text, F.lit("~"))
    none = F.array().cast("array<string>")
    return F.when(placed & marked, F.array_sort(F.concat(numbers, marks))).when(placed, F.array_sort(numbers)).when(marked, F.array_sort(marks)).when(text.isNotNull(), none)


def preserves_inline(source: Column, translated: Column) -> Column:
    # within ``let``, as a bare equation of two sides of a join becomes a key of it, and a key is made anew for each comparison of the sort
    return let(F.struct(source.alias("a"), translated.alias("b")), lambda t: inline_tokens(t["a"]) == inline_tokens(t["b"]))


def query_terms(question: Column) -> Column:
    """All terms of a question, each once: runs of letters and digits, then Han characters."""
    latin = F.regexp_extract_all(question, F.lit("[a-zA-Z0-9]{3,}"), 0)
    return F.array_distinct(F.concat(latin, F.regexp_extract_all(question, F.lit(r"[\x{4e00}-\x{9fff}]"), 0)))


def broad_question(question: Column) -> Column:
    return question.rlike(f"(?i){fixed.BROAD_HAN}|{fixed.BROAD_LATIN}")


def doi(text: Column) -> Column:
    found = F.regexp_extract(text, r"(10\.[0-9]{4,9}/[^ \t\n\r\"<>]+)", 1)
    return F.nullif(F.regexp_replace(found, r"[.,;)]+$", ""), F.lit(""))


def arxiv_id(text: Column) -> Column:
    new = F.regexp_extract(text, r"(?:^|[^0-9.])([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?(?:$|[^0-9])", 1)
    old = F.regexp_extract(text, r"([a-z-]+(?:\.[A-Z]{2})?/[0-9]{7})", 1)
    return F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit("")))


def title_key(title: Column) -> Column:
    return F.lower(F.regexp_replace(title, r"[^\p{L}\p{N}]+", ""))


def session_title(question: Column) -> Column:
    bare = F.regexp_replace(question, r"^(?:>[^\n]*\n)+", "")
    return F.substring(collapse(bare), 1, 48)


def safe_link(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https", "mailto")


def human_tokens(n: Column) -> Column:
    """In thousands or millions with one digit after the point; halves go up."""
    tenth = lambda unit: F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor((n + unit // 20) / unit), F.pmod(F.floor((n + unit // 20) / (unit // 10)), F.lit(10)))])
    return F.when(n >= 1_000_000, F.concat(tenth(1_000_000), F.lit("M"))).when(n >= 1000, F.concat(tenth(1000), F.lit("k"))).otherwise(n.cast("string"))


def human_usd(usd: Column) -> Column:
    return F.when((usd > 0) & (usd < 0.01), F.format_string("$%.4f", usd)).otherwise(F.format_string("$%.2f", usd))
