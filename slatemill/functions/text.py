"""Names: folding, tokens and similarity."""
from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accented letters folded to ASCII, and words that do not identify a club.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžčćđłńřťůěęąśźżğışœæø"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyszccdlnrtueeaszzgisoao"
STOP_WORDS = ["basketball", "basket", "club", "the", "bc", "kk", "bk", "sad", "team", "fc", "as", "cb"]
NAME_SUFFIXES = ["jr", "sr", "ii", "iii", "iv"]


def fold_accents(s: Column) -> Column:
    """Lower-cased ASCII letters for the Latin accents in the table above."""
    return F.translate(F.lower(F.coalesce(s, F.lit(""))), ACCENTED, PLAIN)


def name_tokens(s: Column, folded: bool = False) -> Column:
    """Distinct-order word list: three or more letters or digits, stop words removed."""
    base = s if folded else fold_accents(s)
    words = F.regexp_extract_all(base, F.lit("([a-z0-9]{3,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def person_key(s: Column) -> Column:
    """Comparable form of a person's name: folded, letters only (a hyphen parts words), generation suffix dropped."""
    words = F.split(F.trim(F.regexp_replace(F.translate(fold_accents(s), "-", " "), r"[^a-z ]", "")), r"\s+")
    return F.concat_ws(" ", F.filter(words, lambda w: ~w.isin(*NAME_SUFFIXES)))


def nickname(team: Column) -> Column:
    """Last word of a team name, lower case."""
    return F.element_at(F.split(F.lower(F.trim(team)), r"\s+"), -1)


def alnum_key(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), r"[^a-z0-9]", "")


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; the built-in stand-in for the matcher ratio."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


@F.pandas_udf(T.DoubleType())
def matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib ratio; called on distinct token pairs only."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def paired_list(s: Column) -> Column:
    """'A, B, C, D' -> ['A, B', 'C, D'] (surname, given name pairs)."""
    parts = F.transform(F.split(s, ","), lambda x: F.trim(x))
    starts = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i % 2 == 0)
    return F.transform(starts, lambda i: F.array_join(F.slice(parts, i + 1, F.lit(2)), ", "))
