"""English stems by suffix stripping (Porter's second algorithm), on a column of words.

The rules are tables of suffixes; each step is one column expression, so a
vocabulary is stemmed in one pass without Python code. Meant for distinct words,
whose stems are joined back to where they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a text search in English leaves out (fixed values).
ENGLISH_STOP = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
#: Words with stems of their own (fixed values).
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
#: Words that stay as they are once a plural ending is gone (fixed values).
SETTLED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Endings that change where they stand in the first region, with what they become (fixed values).
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
#: An ending in a short syllable.
SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
#: Up to the first consonant behind a vowel.
REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"


def ending(word: Column, endings) -> Column:
    """The longest of the endings that the word has, or an empty text."""
    return F.regexp_extract(word, f"^(.*?)({'|'.join(endings)})$", 2)


def without(word: Column, suffix: Column) -> Column:
    return F.substr(word, F.lit(1), F.length(word) - F.length(suffix))


def _become(suffix: Column, rules: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(suffix == a, F.lit(b)) for a, b in rules.items()], F.lit(""))


def with_stems(words: DataFrame, word: str = "word", stem: str = "stem") -> DataFrame:
    """``words`` with the stem of the column ``word``.

    Words are lower-case; such with other letters than a-z, of fewer than three
    letters, and null are their own stems.
    """
    w, r1, r2, s = F.col("_w"), F.col("_r1"), F.col("_r2"), F.col("_s")
    plain = F.coalesce(F.col(word).rlike("^[a-z]{3,}$"), F.lit(False))
    special = F.coalesce(*[F.when(F.col(word) == a, F.lit(b)) for a, b in EXCEPTIONS.items()])
    # y counts as a consonant, written Y, at the beginning and behind a vowel.
    # Words that are their own stems are null from here on, which costs nothing.
    out = words.withColumn("_w", F.when(plain, F.regexp_replace(F.regexp_replace(F.col(word), "^y", "Y"), "([aeiouy])y", "$1Y")))
    head = F.length(F.regexp_extract(w, "^(gener|commun|arsen)", 0))
    first = F.greatest(head, F.when(head > 0, F.lit(0)).otherwise(F.length(F.regexp_extract(w, REGION, 0))))
    out = out.withColumn("_r1", F.when(first > 0, first).otherwise(F.length(w)))
    second = F.length(F.regexp_extract(F.substr(w, r1 + 1, F.length(w)), REGION, 0))
    out = out.withColumn("_r2", F.when(second > 0, r1 + second).otherwise(F.length(w)))

    plural = (
        F.when(F.endswith(w, F.lit("sses")), F.regexp_replace(w, "sses$", "ss"))
        .when(w.rlike("(ied|ies)$"), F.when(F.length(w) > 4, F.regexp_replace(w, "(ied|ies)$", "i")).otherwise(F.regexp_replace(w, "(ied|ies)$", "ie")))
        .when(w.rlike("(us|ss)$"), w)
        .when(w.rlike("[aeiouy].+s$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )
    out = out.withColumn("_w", plural)

    out = out.withColumn("_s", ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly")))
    out = out.withColumn("_b", without(w, s))
    bare = F.col("_b")
    mended = (
        F.when(bare.rlike("(at|bl|iz)$"), F.concat(bare, F.lit("e")))
        .when(bare.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.substr(bare, F.lit(1), F.length(bare) - 1))
        .when(bare.rlike(SHORT) & (r1 >= F.length(bare)), F.concat(bare, F.lit("e")))
        .otherwise(bare)
    )
    past = (
        F.when(s.isin("eed", "eedly"), F.when(F.length(bare) >= r1, F.concat(bare, F.lit("ee"))).otherwise(w))
        .when((s != "") & bare.rlike("[aeiouy]"), mended)
        .otherwise(w)
    )
    out = out.withColumn("_w", past)
    out = out.withColumn("_w", F.regexp_replace(w, "^(.+[^aeiouy])[yY]$", "$1i"))

    out = out.withColumn("_s", ending(w, SECOND)).withColumn("_b", without(w, s))
    fits = F.when(s == "ogi", F.endswith(bare, F.lit("l"))).when(s == "li", bare.rlike("[cdeghkmnrt]$")).otherwise(s != "")
    out = out.withColumn("_w", F.when(fits & (F.length(bare) >= r1), F.concat(bare, _become(s, SECOND))).otherwise(w))

    out = out.withColumn("_s", ending(w, THIRD)).withColumn("_b", without(w, s))
    fits = (s != "") & (F.length(bare) >= r1) & ((s != "ative") | (F.length(bare) >= r2))
    out = out.withColumn("_w", F.when(fits, F.concat(bare, _become(s, THIRD))).otherwise(w))

    out = out.withColumn("_s", ending(w, FOURTH)).withColumn("_b", without(w, s))
    fits = (s != "") & (F.length(bare) >= r2) & ((s != "ion") | bare.rlike("[st]$"))
    out = out.withColumn("_w", F.when(fits, bare).otherwise(w))

    out = out.withColumn("_b", F.regexp_replace(w, "[el]$", ""))
    final_e = F.endswith(w, F.lit("e")) & ((F.length(bare) >= r2) | ((F.length(bare) >= r1) & ~bare.rlike(SHORT)))
    final_l = F.endswith(w, F.lit("ll")) & (F.length(bare) >= r2)
    out = out.withColumn("_w", F.translate(F.when(final_e | final_l, bare).otherwise(w), "Y", "y"))
    # Settled words skip all that came after the plural.
    settled = F.coalesce(*[F.when(F.col(word).isin(x, f"{x}s"), F.lit(x)) for x in SETTLED])
    found = F.when(~plain, F.col(word)).otherwise(F.coalesce(special, settled, w)).alias(stem)
    return out.select(*words.columns, found)
