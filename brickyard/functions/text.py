"""Column functions over text: folding, words, similarity, Vietnamese numbers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Words of a price question that never narrow it down.
STOPWORDS = ["gia", "cua", "loai", "vat", "lieu", "bao", "nhieu", "mot", "va", "co", "cho", "tai", "o", "la", "voi", "theo"]
MIN_WORD = 2
TOKEN = r"\w+|[^\w\s]"


def _accented() -> tuple[str, str]:
    """Precomposed Latin letters and the plain letter each folds to; d with stroke by hand."""
    pairs = {chr(0x111): "d"}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter, base = chr(c).lower(), unicodedata.normalize("NFD", chr(c).lower())
        if len(letter) == 1 and base != letter and base[0].isascii():
            pairs[letter] = base[0]
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _accented()


def fold(c: Column) -> Column:
    """Lower case without accents; the stroke of a d goes too."""
    return F.regexp_replace(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), r"\p{M}+", "")


def norm_ws(c: Column) -> Column:
    """White space runs become one space, ends are trimmed; null stays null."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^ | $", "")


def norm(c: Column) -> Column:
    return norm_ws(F.lower(F.coalesce(c, F.lit(""))))


def match_words(c: Column) -> Column:
    """The folded words a product name must hold, in order, repeats included."""
    words = F.regexp_extract_all(fold(c), F.lit("[0-9a-z]+"), 0)
    return F.filter(words, lambda w: (F.length(w) >= MIN_WORD) & ~w.isin(STOPWORDS))


def name_tokens(c: Column) -> Column:
    """The distinct folded whole words of a stored text."""
    return F.array_distinct(F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0))


def has_word(tokens: Column, word: Column) -> Column:
    return F.array_contains(tokens, word)


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words, each padded by two spaces before and one after."""
    words = F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit("[0-9a-z]+"), 0)
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams of two :func:`trigrams` columns; 0 when both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def count_tokens(c: Column) -> Column:
    """Words and single punctuation marks."""
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), 0))


def clip_tokens(c: Column, n: int) -> Column:
    """The text up to and with its n-th token."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?s)^(?:\s*(?:\w+|[^\w\s])){{0,{n}}}", 0)


def parse_price(c: Column) -> Column:
    """A Vietnamese number: '.' groups thousands, ',' marks decimals; null if none or not above 0."""
    closed = F.regexp_replace(F.trim(c), r"^(\d{1,2})\s+(?=\d)", "$1")

    def plain(raw: Column) -> Column:
        comma, dot = raw.contains(","), raw.contains(".")
        thousands = lambda sep: F.length(F.substring_index(raw, sep, -1)) == 3
        return (
            F.when(comma & dot, F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(comma, F.when(thousands(","), F.replace(raw, F.lit(","), F.lit(""))).otherwise(F.replace(raw, F.lit(","), F.lit("."))))
            .otherwise(F.when(thousands("."), F.replace(raw, F.lit("."), F.lit(""))).otherwise(raw))
        )

    # over arrays of one, so that what a step reads many times is computed once
    raw = F.array(F.regexp_extract(closed, r"[\d.,]+", 0))
    values = F.transform(F.transform(raw, plain), lambda p: F.when(p.rlike(r"^(\d+\.?\d*|\.\d+)$"), p.try_cast("double")))
    return F.get(F.filter(values, lambda v: v > 0), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def register_sql(spark: SparkSession) -> None:
    """Makes ``fold(s)`` a temporary SQL function of the session."""
    spark.sql(rf"CREATE OR REPLACE TEMPORARY FUNCTION fold(s STRING) RETURNS STRING RETURN regexp_replace(translate(lower(s), '{FOLD_FROM}', '{FOLD_TO}'), r'\p{{M}}+', '')")
