"""String columns: cleaning, coercion, counting, normalization."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The white space characters of Unicode text, the four separator controls included.
_SPACES = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# the same set as a plain character class, which matches faster than a Unicode-aware \s
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = SPACE.replace("[", "[^", 1)


def strip_text(col: Column) -> Column:
    """Strip every kind of white space at both ends, not only U+0020."""
    return F.btrim(col, F.lit(_SPACES))


def clean_text(col: Column) -> Column:
    """Strip, then collapse runs of white space into one space."""
    return F.regexp_replace(strip_text(col), f"{SPACE}+", " ")


def lower_text(col: Column) -> Column:
    return F.lower(clean_text(col))


def upper_text(col: Column) -> Column:
    return F.upper(clean_text(col))


def to_ts(col: Column) -> Column:
    """Timestamp without zone, null where the text is not one; the session time zone plays no part."""
    return col.try_cast("timestamp_ntz")


def to_num(col: Column) -> Column:
    """Double, null where the text is not a number."""
    return col.try_cast("double")


def to_int(col: Column) -> Column:
    """Nullable long, null where the text is not an integer."""
    return col.try_cast("bigint")


def text_length(col: Column) -> Column:
    return F.length(col).cast("long")


def word_count(col: Column) -> Column:
    """Runs of non-space characters."""
    return F.regexp_count(col, F.lit(f"{WORD}+")).cast("long")


def has_word(col: Column, word: str) -> Column:
    """Whole-word presence, with Unicode word boundaries."""
    return F.coalesce(col.rlike(rf"(?U)\b{word}\b"), F.lit(False))


def count_words_of(col: Column, words: list[str]) -> Column:
    """Occurrences of any of the words, as whole words."""
    return F.regexp_count(col, F.lit(r"(?U)\b(" + "|".join(words) + r")\b"))


def has_accented_latin(col: Column) -> Column:
    """Any Latin letter outside ASCII."""
    return F.coalesce(col.rlike(r"[\p{IsLatin}&&[^\x00-\x7F]]"), F.lit(False))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_text(col: Column, nfkc: bool = False) -> Column:
    """Lower case, single spaces, `!!`→`!`, `??`→`?`, four or more dots→`...`; words are all kept.

    NFKC has no built-in function, so it alone goes through an Arrow UDF.
    """
    text = F.coalesce(col, F.lit(""))
    if nfkc:
        text = _nfkc(text)
    text = F.regexp_replace(F.lower(text), f"{SPACE}+", " ")
    text = F.regexp_replace(text, "!{2,}", "!")
    text = F.regexp_replace(text, r"\?{2,}", "?")
    text = F.regexp_replace(text, r"\.{3,}", "...")
    return strip_text(text)
