"""Text normalisation, tokens and trigram similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a search does not count (fixed values).
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


#: White space of Unicode, and the separators U+001C to U+001F, but for the blank (fixed values).
WHITE = "".join(chr(x) for x in (*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: One ASCII space character.
SPACE = r"[ \t\n\x0B\f\r]"


def normalized(text: Column) -> Column:
    """Line ends to LF, no blanks at line ends, no outer empty lines; empty for null."""
    lf = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    # A run of blanks is tried at its first one only, so long runs take linear time.
    return F.btrim(F.regexp_replace(lf, "(?md)(?<![ \t])[ \t]++$", ""), F.lit("\n"))


def canonical(text: Column) -> Column:
    """Outer white space gone, inner squeezed to one blank, lower case; empty for null."""
    blank = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.lower(F.btrim(F.regexp_replace(blank, " +", " "), F.lit(" ")))


def content_hash(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def squeezed(text: Column, most: int = 4000) -> Column:
    """The first ``most`` characters, trimmed, spaces squeezed; empty for null."""
    return F.regexp_replace(F.btrim(F.substring(F.coalesce(text, F.lit("")), 1, most), F.lit(" ")), f"{SPACE}+", " ")


def fingerprint(text: Column) -> Column:
    """Squeezed and lower-cased, without spaces and ASCII punctuation at the end."""
    return F.lower(F.regexp_replace(squeezed(text), r"(?<![ \t\n\x0B\f\r\p{Punct}])[ \t\n\x0B\f\r\p{Punct}]++$", ""))


def error_shape(text: Column) -> Column:
    """An error message without its ids and numbers, up to 500 characters; empty for null."""
    known = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>")
    return F.substring(F.regexp_replace(F.regexp_replace(known, "[0-9]+", "<n>"), f"{SPACE}+", " "), 1, 500)


def tokens(text: Column) -> Column:
    """Lower-case words of [a-z0-9] without stop words, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def trigrams(text: Column) -> Column:
    """Set of 3-grams of the words, each padded with two blanks and one."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    return F.array_distinct(grams)


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def without_tags(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(bare, "[ \t\r\n]+", " "))
