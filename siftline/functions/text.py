"""Text functions as column expressions: tokens, stems, sentences, n-grams."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and the underscore, in any script. Java and RE2 read it alike.
TOKEN = r"[\p{L}\p{N}_]+"

# The stop list of the lexical analyser.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "did", "do", "does", "for", "from", "had", "has",
    "have", "he", "her", "his", "how", "i", "if", "in", "into", "is", "it", "its", "of", "on", "or", "she", "should",
    "so", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "was", "were", "what",
    "when", "where", "which", "who", "why", "will", "with", "would", "you", "your",
)
# The stop list for marking query terms in snippets.
SNIPPET_STOPWORDS = (
    "the", "and", "for", "why", "did", "was", "were", "what", "when", "who", "how", "with", "from", "that", "this",
    "are", "has", "have", "does", "any", "all", "its", "our", "their",
)


def raw_tokens(text: Column) -> Column:
    """Lower-case tokens in order, stop words included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _undoubled(word: Column) -> Column:
    """Without the second of two equal final consonants, if more than three characters remain to look at."""
    return F.when((F.length(word) > 3) & word.rlike(r"([bcdfgklmnprstvz])\1$"), F.left(word, F.length(word) - 1)).otherwise(word)


def stem(word: Column) -> Column:
    """Light suffix removal; tokens with a digit, or of three characters or fewer, stay as they are.

    The first rule that fits applies: -ies, -ing, -ed, -es, -s.
    """
    n = F.length(word)
    cut = lambda k: F.left(word, n - k)
    es = F.when(cut(2).rlike("(s|x|z|ch|sh)$"), cut(2)).otherwise(cut(1))
    return (
        F.when(word.rlike(r"\p{Nd}") | (n <= 3), word)
        .when(word.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(word.endswith("ing") & (n >= 6), _undoubled(cut(3)))
        .when(word.endswith("ed") & (n >= 5), _undoubled(cut(2)))
        .when(word.endswith("es"), es)
        .when(word.endswith("s") & ~word.endswith("ss"), cut(1))
        .otherwise(word)
    )


def is_stopword(word: Column) -> Column:
    return word.isin(*STOPWORDS)


def analysed(text: Column) -> Column:
    """Index terms of a text in order."""
    return F.transform(F.filter(raw_tokens(text), lambda w: ~is_stopword(w)), stem)


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Trimmed pieces after a full stop, exclamation or question mark and white space, or at line ends."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+", -1)
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, white space inside each line collapsed, empty lines dropped."""
    blocks = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n", -1), normalised_lines)
    return F.filter(blocks, lambda b: b != "")


def normalised_lines(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+", -1), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def hard_split(text: Column, size: int) -> Column:
    """Slices of ``size`` words."""
    w = words(text)
    starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(size))
    return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(size)), " ")), lambda s: s != "")


def char_ngrams(token: Column) -> Column:
    """Character 3- to 5-grams of ^token$; none for tokens under four characters."""
    padded = F.concat(F.lit("^"), token, F.lit("$"))

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(padded) - n + 1)
        return F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))

    grams = F.concat(of_size(3), of_size(4), of_size(5))
    return F.when(F.length(token) >= 4, grams).otherwise(F.array().cast("array<string>"))


def hms(seconds: Column) -> Column:
    """HH:MM:SS, truncated; hours may exceed 99."""
    s = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(s / 3600).cast("long")
    shown = F.when(hours < 100, two(hours)).otherwise(hours.cast("string"))
    return F.concat_ws(":", shown, two(F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long")), two(F.pmod(s, F.lit(60))))


def parsed_timestamp(text: Column) -> Column:
    """ISO first, then day/month/year, then month/day/year with time, then year/month/day; null if nothing fits."""
    trimmed = F.trim(text)
    iso = F.try_to_timestamp(F.regexp_replace(trimmed, "Z$", "+00:00"))
    return F.coalesce(iso, *[F.try_to_timestamp(trimmed, F.lit(f)) for f in ("dd/MM/yyyy", "MM/dd/yyyy HH:mm", "yyyy/MM/dd")])


def stable_id(prefix: str, length: int, *parts: Column) -> Column:
    """``prefix`` and the first ``length`` hex digits of the SHA-256 of the parts joined by the unit separator."""
    joined = F.concat_ws("\x1f", *[p.cast("string") for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, length))


def _plain_letters() -> tuple[str, str]:
    """Accented letters that decompose to one letter and marks, and those letters; the marks come last, without a partner."""
    accented, plain = [], []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFKD", chr(code))
        base = "".join(c for c in parts if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            accented.append(chr(code))
            plain.append(base)
    marks = [chr(code) for code in range(0x300, 0x370) if unicodedata.combining(chr(code))]
    return "".join([*accented, *marks]), "".join(plain)


def unaccented(text: Column) -> Column:
    """Letters without their accents, in scripts below U+2000; a letter that decomposes to several stays."""
    accented, plain = _plain_letters()
    return F.translate(text, accented, plain)
