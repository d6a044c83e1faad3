"""Column expressions over text: folding, the two tokenizers, content keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of the pairwise scorer may hold inner apostrophes and hyphens; terms of retrieval may not.
WORD = r"(?U)[^\W_]+(?:['’\-][^\W_]+)*"
TERM = r"(?U)[^\W_]+"


def fold(text: Column) -> Column:
    """Lower case with ß as ss: equal to full case folding on Latin text that is composed already."""
    return F.lower(F.replace(text, F.lit("ß"), F.lit("ss")))


def fold_unicode(text: Column) -> Column:
    """Full compatibility composition and case folding, for any script; Spark has neither built in."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())

    return run(text)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold(text), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(normal(text), F.lit(WORD), 0)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TERM), 0)


def content_key(text: Column) -> Column:
    """sha256 of the text without case and signs; texts that differ in these alone share it."""
    return F.sha2(F.trim(F.regexp_replace(fold(text), r"(?U)\W+", " ")), 256)


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once; a column that a lambda mentions is computed anew for every element."""
    return F.flatten(F.transform(F.array(value), use))


def word_grams(tokens: Column) -> Column:
    """Single words and pairs of neighbours."""

    def of(t: Column) -> Column:
        rest = F.greatest(F.size(t) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(t, F.lit(1), rest), F.slice(t, F.lit(2), rest), lambda a, b: F.concat(F.lit("b:"), a, F.lit("_"), b))
        return F.concat(F.transform(t, lambda w: F.concat(F.lit("w:"), w)), pairs)

    return bound(tokens, of)


def char_grams(text: Column) -> Column:
    """Runs of three to five characters, signs as blanks; edge blanks count. Characters are split once: substring counts from the start each time."""
    flat = F.regexp_replace(normal(text), r"(?U)[^\w]+", " ")

    def of(chars: Column) -> Column:
        def runs(n: int) -> Column:
            last = F.size(chars) - n
            made = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
            return F.when(last >= 0, made).otherwise(F.array().cast("array<string>"))

        return F.concat(runs(3), runs(4), runs(5))

    return bound(F.split(flat, ""), of)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded half to even on the scaled binary value, the same on every engine."""
    return F.rint(x * float(10**digits)) / float(10**digits)
