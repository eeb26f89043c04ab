"""A dictionary of words: what of a large one is kept, and lookup over base forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rarest rank, the longest word and the length up to which every word is kept; notes that name an inflected form.
RAREST, LONGEST, SHORT = 250_000, 24, 4
INFLECTED = ("过去式", "过去分词", "现在分词", "复数", "比较级", "最高级")

# Endings and what stands in a base form instead, prefixes of word formation, and the letters that a prefix leaves at least.
ENDINGS = [("ies", "y"), ("es", ""), ("s", ""), ("ing", ""), ("ing", "e"), ("ed", ""), ("ed", "e"), ("er", ""), ("est", ""), ("ly", ""), ("al", "")]
PREFIXES = ("un", "non", "multi", "sub", "inter", "anti", "over", "under")
LEFT_BY_PREFIX = 4
WORD = r"^[a-z][a-z'-]{0,23}$"


def trimmed(entries: DataFrame) -> DataFrame:
    """(word, phonetic, translation) of entries (word, phonetic, translation, frq, bnc, collins, oxford, tag, seq): common, short, tagged or inflected words.

    Words in lower case; of equal ones the last by ``seq`` counts. Null ranks and tags speak for nothing.
    """
    ranked = [F.col(c).between(1, RAREST) for c in ("frq", "bnc")] + [F.col(c) > 0 for c in ("collins", "oxford")]
    noted = [F.contains("translation", F.lit(f"的{n}")) for n in INFLECTED]
    reasons = [*ranked, F.col("tag") != "", F.char_length("word") <= SHORT, *noted]
    useful = reduce(Column.__or__, [F.coalesce(r, F.lit(False)) for r in reasons])
    kept = entries.where((F.col("translation") != "") & F.col("word").rlike("^[a-z][^ ]*$") & (F.char_length("word") <= LONGEST) & useful)
    last = kept.groupBy(F.lower("word").alias("word")).agg(F.max_by(F.struct("phonetic", "translation"), "seq").alias("e"))
    return last.select("word", F.coalesce("e.phonetic", F.lit("")).alias("phonetic"), "e.translation")


def base_forms(word: Column) -> Column:
    """The word, then what it may be a form of: without endings, with one of two equal last consonants, without a prefix."""
    cut = [F.when(word.endswith(end), F.concat(F.substring(word, F.lit(1), F.char_length(word) - len(end)), F.lit(instead))) for end, instead in ENDINGS]
    plain = F.array_distinct(F.concat(F.array(word), F.filter(F.array(*cut), lambda c: F.char_length(c) >= 2)))
    single = F.transform(F.filter(plain, lambda c: c.rlike(r"([b-df-hj-np-tv-z])\1$") & (F.char_length(c) > 2)), lambda c: F.substring(c, F.lit(1), F.char_length(c) - 1))
    bare = F.array(*[F.when(word.startswith(p) & (F.char_length(word) >= len(p) + LEFT_BY_PREFIX), F.substring(word, len(p) + 1, LONGEST)) for p in PREFIXES])
    return F.array_distinct(F.concat(plain, single, F.filter(bare, lambda c: c.isNotNull())))


def looked_up(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(term, word, phonetic, translation) of words (term): the first base form that the dictionary has; others are left out.

    A frequent term is one row before the join, so no key is hot.
    """
    asked = words.select("term").distinct().withColumn("w", F.lower(F.trim("term"))).where(F.col("w").rlike(WORD))
    forms = asked.select("term", F.posexplode(base_forms(F.col("w"))).alias("place", "word"))
    found = forms.join(dictionary.hint("merge"), "word")
    return found.groupBy("term").agg(F.min_by(F.struct("word", "phonetic", "translation"), "place").alias("e")).select("term", "e.*")
