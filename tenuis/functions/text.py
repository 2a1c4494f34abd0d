"""Text keys as column expressions.

Each normalizer is named after its rule, because they differ in plural, underscore and
punctuation handling and those differences decide which rows group together.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_ALNUM = r"[^\p{L}\p{N}]+"
NOT_ALNUM_OR_UNDERSCORE = r"[^\p{L}\p{N}_]+"
SPACES = r"[\s\p{Z}]+"
# Fixed value: separators that spelling variants may use between words.
DASHES = r"[-‐‑‒–—−_]+"

# Blocks in which lower() plus the sharp-s rule can stand in for NFKC + casefold; the code
# points inside them that do not satisfy this are found by rule in ``unsafe_pattern``.
_NATIVE_BLOCKS = ((0x00, 0x24F), (0x400, 0x45F), (0x2010, 0x203F), (0x4E00, 0x9FFF))


@lru_cache(maxsize=1)
def unsafe_pattern() -> str:
    """Java character class of everything that needs the exact NFKC + casefold path.

    Java tries the ranges of a class one after another, so ASCII, which is safe, is ruled out before them.
    """
    safe: list[tuple[int, int]] = []
    for first, last in _NATIVE_BLOCKS:
        for code in range(first, last + 1):
            char = chr(code)
            lower = char.lower().replace("ß", "ss")
            if unicodedata.normalize("NFKC", char).casefold() != lower or len(char.lower()) != 1:
                continue
            if safe and safe[-1][1] == code - 1:
                safe[-1] = (safe[-1][0], code)
            else:
                safe.append((code, code))
    ranges = "".join(f"\\x{{{first:x}}}-\\x{{{last:x}}}" for first, last in safe)
    return f"[[^\\x00-\\x7f]&&[^{ranges}]]"


@F.pandas_udf(T.StringType())
def _nfkc_casefold(values: pd.Series) -> pd.Series:
    return values.map(
        lambda value: unicodedata.normalize("NFKC", value).casefold(), na_action="ignore"
    )


def fold_native(value: Column) -> Column:
    """NFKC + casefold for text made of code points outside ``unsafe_pattern``."""
    return F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))


def fold(value: Column) -> Column:
    """NFKC + casefold.

    Only rows holding a code point the JVM functions cannot fold exactly are sent to Python;
    all other rows reach the Arrow worker as nulls.
    """
    exact = _nfkc_casefold(F.when(value.rlike(unsafe_pattern()), value))
    return F.coalesce(exact, fold_native(value))


def squash(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, SPACES, " "))


def alnum_words(folded: Column) -> Column:
    """Runs of anything but letters and digits become one space."""
    return F.trim(F.regexp_replace(folded, NOT_ALNUM, " "))


def identity_key(value: Column) -> Column:
    return alnum_words(fold(value))


def title_key(value: Column) -> Column:
    """Keeps the underscore as a word character."""
    return F.trim(F.regexp_replace(fold(value), NOT_ALNUM_OR_UNDERSCORE, " "))


def phrase_key(value: Column) -> Column:
    """Dashes and underscores become spaces, other punctuation stays."""
    return squash(F.regexp_replace(fold(value), DASHES, " "))


def name_key(value: Column) -> Column:
    return squash(fold(value))


def orthographic_key(value: Column) -> Column:
    """Spelling-variant key: every ASCII word loses a plural s (not ss, us, is; length > 3)."""
    spaced = squash(F.regexp_replace(name_key(value), DASHES, " "))
    return F.regexp_replace(spaced, r"(?<=^| )([a-z]{2,}[a-hj-rtv-z])s(?= |$)", "$1")


def queue_key(value: Column) -> Column:
    """Like the orthographic key but without punctuation and not limited to ASCII words."""
    words = alnum_words(F.regexp_replace(fold(value), DASHES, " "))
    return F.regexp_replace(words, r"(?<=^| )([^ ]{2,}[^ sui])s(?= |$)", "$1")


def card_key(value: Column) -> Column:
    """Key of a result card: a trailing (ACRONYM) that matches the initials is dropped and only
    the last word loses a plural s."""
    text = F.trim(F.regexp_replace(value, SPACES, " "))
    inner = F.regexp_extract(text, r"^(.*?)\s*\(([^()]*)\)\s*$", 2)
    base = F.trim(F.regexp_extract(text, r"^(.*?)\s*\(([^()]*)\)\s*$", 1))
    acronym = F.lower(F.regexp_replace(inner, NOT_ALNUM, ""))
    initials = F.lower(
        F.array_join(
            F.transform(
                F.regexp_extract_all(base, F.lit("([A-Za-z0-9]+)"), 1),
                lambda word: F.substring(word, 1, 1),
            ),
            "",
        )
    )
    bracketed = (
        F.length(acronym).between(2, 8)
        & (F.length(initials) > 0)
        & (F.startswith(acronym, initials) | F.startswith(initials, acronym))
    )
    kept = F.when(bracketed, base).otherwise(text)
    words = squash(F.regexp_replace(fold(kept), DASHES, " "))
    return F.regexp_replace(words, r"(?<=^| )([^ ]{2,}[^ sui])s$", "$1")


def scope_words(value: Column) -> Column:
    """Words for scope matching; ASCII words of four letters or more lose a plural s (not ss, is)."""
    words = alnum_words(fold_native(value))
    return F.regexp_replace(words, r"(?<=^| )([\x00-\x1f!-\x7f]{2,}[\x00-\x1f!-hj-rt-\x7f])s(?= |$)", "$1")


def words(normalized: Column) -> Column:
    """Word array of a normalized key; an empty key has no words."""
    return F.filter(F.split(normalized, " "), lambda word: word != "")


def bigrams(tokens: Column, joiner: str) -> Column:
    """Adjacent pairs of a word array."""
    size = F.size(tokens)
    left = F.slice(tokens, F.lit(1), F.greatest(size - 1, F.lit(0)))
    right = F.slice(tokens, F.lit(2), F.greatest(size - 1, F.lit(0)))
    return F.when(
        size > 1, F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(joiner), b))
    ).otherwise(F.array().cast("array<string>"))


def word_terms(normalized: Column) -> Column:
    """Words and adjacent pairs of a normalized key, with repetition."""
    tokens = words(normalized)
    return F.concat(tokens, bigrams(tokens, "::"))


def has_phrase(normalized: Column, phrase: Column) -> Column:
    """Whole-word phrase test on two normalized keys."""
    padded = F.concat(F.lit(" "), normalized, F.lit(" "))
    return (phrase != "") & F.contains(padded, F.concat(F.lit(" "), phrase, F.lit(" ")))


def first_spelling(values: Column) -> Column:
    """Case-insensitive distinct that keeps the first spelling and the order."""
    return F.aggregate(
        values,
        F.array().cast("array<string>"),
        lambda kept, value: F.when(
            F.exists(kept, lambda seen: fold_native(seen) == fold_native(value)), kept
        ).otherwise(F.concat(kept, F.array(value))),
    )


def acronym_of(name: Column) -> Column:
    """Upper-case initials of a name of two to eight ASCII words, else null."""
    found = F.regexp_extract_all(name, F.lit("([A-Za-z][A-Za-z0-9]*)"), 1)
    return F.when(
        F.size(found).between(2, 8),
        F.upper(F.array_join(F.transform(found, lambda word: F.substring(word, 1, 1)), "")),
    )


def is_acronym(name: Column) -> Column:
    return name.rlike("^[A-Z0-9]{3,8}$")


def taxonomy_words(value: Column, stop_words: list[str]) -> Column:
    """ASCII words of the compatibility-decomposed text without the stop words."""
    folded = _nfkd_casefold(F.when(value.rlike(r"[^\x00-\x7f]"), value))
    text = F.coalesce(folded, F.lower(value))
    found = F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(found, lambda word: ~word.isin(stop_words)))


@F.pandas_udf(T.StringType())
def _nfkd_casefold(values: pd.Series) -> pd.Series:
    return values.map(
        lambda value: unicodedata.normalize("NFKD", value).casefold(), na_action="ignore"
    )
