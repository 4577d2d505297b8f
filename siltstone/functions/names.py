"""Name rules as column expressions: table names, number forms, similarity."""

from __future__ import annotations

import sys
from difflib import SequenceMatcher

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Workers get the helpers below with the function, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Irregular number forms; they hold in both directions.
IRREGULAR = {
    "person": "people",
    "child": "children",
    "man": "men",
    "woman": "women",
    "datum": "data",
    "medium": "media",
    "analysis": "analyses",
    "status": "statuses",
}
_BOTH_WAYS = {**IRREGULAR, **{many: one for one, many in IRREGULAR.items()}}
_IRREGULAR_MAP = "map({})".format(", ".join(f"'{a}', '{b}'" for a, b in _BOTH_WAYS.items()))


def sanitize(name: Column) -> Column:
    """File name to table name: no extension, only letters, digits and ``_``, lower case."""
    stem = F.regexp_replace(name, r"(?s)^(.*[^./].*)\.[^./]*$", "$1")
    plain = F.regexp_replace(stem, "[^a-zA-Z0-9]", "_")
    lettered = F.when(plain.rlike("^[0-9]"), F.concat(F.lit("t_"), plain)).otherwise(plain)
    return F.when(lettered == "", "dataset").otherwise(F.lower(lettered))


def _irregular(word: Column) -> Column:
    return F.try_element_at(F.expr(_IRREGULAR_MAP), word)


def singular(name: Column) -> Column:
    w = F.lower(name)
    return F.coalesce(
        _irregular(w),
        F.when(w.rlike(".ies$"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike(".ses$"), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("[cs]hes$"), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("(^|[^s])s$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w),
    )


def plural(name: Column) -> Column:
    w = F.lower(name)
    return F.coalesce(
        _irregular(w),
        F.when(w.rlike("[^aeiou]y$"), F.regexp_replace(w, "y$", "ies"))
        .when(w.rlike("(s|sh|ch|x|z)$"), F.concat(w, F.lit("es")))
        .otherwise(F.concat(w, F.lit("s"))),
    )


def variations(name: Column) -> Column:
    """Array of the name, its singular, its plural and the singular of that plural."""
    # Lambdas bind each word once; written out, the nested rules outgrow a compiled method.
    forms = F.transform(F.array(F.lower(name)), lambda w: F.struct(w.alias("w"), plural(w).alias("many")))
    return F.array_distinct(
        F.flatten(
            F.transform(
                forms, lambda f: F.array(f["w"], singular(f["w"]), f["many"], singular(f["many"]))
            )
        )
    )


def substrings(name: Column) -> Column:
    """Every non-empty substring of a (short) name.

    Joining these on equality finds all "is contained in" pairs without comparing all pairs.
    """
    n = F.length(name)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(
        F.flatten(
            F.transform(
                starts,
                lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(name, i, k)),
            )
        )
    )


#: Letters from rare to common in English names; others count as rarer still.
_RARE_FIRST = "zqjxkwvfybhgpmculd_otrnsaie"


def letters(name: Column) -> Column:
    """A name's letters, numbered so that the second ``e`` is an element of its own, rare ones first.

    Elements sort by number (a repeated letter is rarer than one), then by letter; the same order for all names. Two names
    share as many elements as they have letters in common, so at least their longest common subsequence.
    """
    n = F.length(name)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    singles = F.transform(places, lambda i: F.substring(name, i, F.lit(1)))

    def numbered(letter: Column, at: Column) -> Column:
        nth = F.size(F.filter(F.slice(singles, F.lit(1), at + 1), lambda other: other == letter))
        rank = F.call_function("instr", F.lit(_RARE_FIRST), letter)
        return F.concat(F.lpad((F.lit(999_999) - nth).cast("string"), 6, "0"), F.lpad(rank.cast("string"), 2, "0"), letter)

    return F.array_sort(F.transform(singles, numbered))


def letter_pairs(found: Column, ratio: float) -> Column:
    """Join keys from a name's ``letters``, of which two names share at least one if their ratio (0 to 1) is at least ``ratio``.

    A pair of lengths n and m with that ratio has t = ratio * (n + m) / 2 letters in common, and as none has more than its own
    length, t is at least n * ratio / (2 - ratio) whatever m is. Two names with t common elements of one order share two
    among the first n - t + 2 of each: every pair of those is a key. Where one common letter is enough, which takes names
    of 2 / ratio letters together, each single letter is a key too.
    """
    n = F.size(found)
    # Rounding must not raise the bound.
    least = F.greatest(F.ceil(n * (ratio / (2 - ratio)) - 1e-9), F.lit(2)).cast("int")
    first = F.slice(found, F.lit(1), F.greatest(n - least + 2, F.lit(0)))
    pairs = F.transform(first, lambda x, i: F.transform(F.slice(found, i + 2, n - least + 1 - i), lambda y: F.concat(x, y)))
    return F.concat(F.flatten(pairs), F.when(n <= 2 / ratio - 1 + 1e-9, found).otherwise(F.array().cast("array<string>")))


def may_resemble(left: Column, right: Column, ratio: float) -> Column:
    """Whether two names, given by their ``letters``, have enough in common for the ratio; no pair that reaches it fails."""
    return 2 * F.size(F.array_intersect(left, right)) >= (F.size(left) + F.size(right)) * ratio - 1e-9


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    unmatched = full
    for ch in b:
        hit = unmatched & places.get(ch, 0)
        unmatched = ((unmatched + hit) | (unmatched - hit)) & full
    return len(a) - unmatched.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b); two empty names are equal."""
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * _common_subsequence(a, b) / total


@F.pandas_udf(T.DoubleType())
def indel_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """``indel_ratio`` over already blocked name pairs."""
    return pd.Series([indel_ratio(a, b) for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def matching_blocks_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """difflib ratio (0 to 1) over already blocked name pairs."""
    return pd.Series(
        [SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64"
    )


_COMMON_FIRST = "eiadsrnto_lucmphgbyfvkwxjqz"


@F.pandas_udf(T.ArrayType(T.StringType()))
def rare_letters(names: pd.Series) -> pd.Series:
    """Blocking tokens for pairs that share at least a quarter of their joint length.

    If two names share (len a + len b)/4 letters, each shares at least a third of its own
    length. Sort a name's letters (counted, so the second ``e`` is its own token) from rare to
    common and keep all but that third, less one: two such names then always share a kept token.
    """

    def tokens(name: str) -> list[str]:
        seen: dict[str, int] = {}
        numbered = []
        for ch in name:
            seen[ch] = seen.get(ch, 0) + 1
            numbered.append((-_COMMON_FIRST.find(ch) if ch in _COMMON_FIRST else -99, ch, seen[ch]))
        numbered.sort()
        keep = len(name) - -(-len(name) // 3) + 1
        return [f"{ch}{n}" for _, ch, n in numbered[:keep]]

    return names.map(tokens)
