import random
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import names as N
from siltstone.plans import relate as R


def column(spark, words, make):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("w"))).collect()]


@pytest.mark.parametrize(
    "word, one, many",
    [
        ("users", "user", "userses"),
        ("user", "user", "users"),
        ("categories", "category", "categorieses"),
        ("category", "category", "categories"),
        ("boxes", "boxe", "boxeses"),
        ("box", "box", "boxes"),
        ("churches", "church", "churcheses"),
        ("dishes", "dish", "disheses"),
        ("address", "address", "addresses"),
        ("addresses", "address", "addresseses"),
        ("day", "day", "days"),
        ("child", "children", "children"),
        ("children", "child", "child"),
        ("Status", "statuses", "statuses"),
        ("ies", "ie", "ieses"),
        ("y", "y", "ys"),
        ("s", "", "ses"),
        ("", "", "s"),
    ],
)
def test_number_forms(spark, word, one, many):
    assert column(spark, [word], N.singular) == [one]
    assert column(spark, [word], N.plural) == [many]


def test_variations_hold_both_numbers(spark):
    got = column(spark, ["Category", "person"], N.variations)
    assert got[0] == ["category", "categories"]
    assert set(got[1]) == {"person", "people"}


@pytest.mark.parametrize(
    "file, name",
    [
        ("2024 Sales.csv", "t_2024_sales"),
        ("a-b.c.parquet", "a_b_c"),
        (".csv", "_csv"),
        ("Ünï.csv", "_n_"),
        ("..csv", "__csv"),
        ("a..csv", "a_"),
        ("", "dataset"),
        ("plain", "plain"),
    ],
)
def test_sanitize(spark, file, name):
    assert column(spark, [file], N.sanitize) == [name]


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcde_", max_size=12), st.text("abcde_", max_size=12))
def test_indel_ratio_is_twice_the_common_subsequence(a, b):
    total = len(a) + len(b)
    want = 100.0 if total == 0 else 200 * brute_lcs(a, b) / total
    assert N.indel_ratio(a, b) == pytest.approx(want)


def test_indel_ratio_is_not_levenshtein():
    assert N.indel_ratio("abc", "axc") == pytest.approx(200 * 2 / 6)


def numbered(word):
    """Letters of a name as (letter, how many of it so far)."""
    return {(ch, word[: i + 1].count(ch)) for i, ch in enumerate(word)}


def test_letters_share_an_order(spark):
    words = ["", "a", "assess", "é£z", "Aa_1", "zebra" * 9]
    for word, found in zip(words, column(spark, words, N.letters)):
        assert found == sorted(found) and {(e[8:], 999_999 - int(e[:6])) for e in found} == numbered(word)
    assert [e[-1] for e in column(spark, ["eze"], N.letters)[0]] == ["e", "z", "e"]


def test_substrings(spark):
    assert set(column(spark, ["aba"], N.substrings)[0]) == {"a", "b", "ab", "ba", "aba"}
    assert column(spark, [""], N.substrings) == [[]]


def many_names(n):
    """Random names over few and many letters, with one to four edits of each, and all names of up to three letters of two."""
    rnd = random.Random(11)
    found = {"".join(p) for k in (1, 2, 3) for p in product("ab", repeat=k)} | {""}
    while len(found) < n:
        name = "".join(rnd.choices(rnd.choice(["abs", "etaoin_s", "abcdefghijklmnopqrstuvwxyz_"]), k=rnd.randint(1, 14)))
        found.add(name)
        for _ in range(rnd.randint(1, 4)):
            at = rnd.randrange(len(name) + 1)
            name = name[:at] + rnd.choice(["", "s", "_", "e"]) + name[at + rnd.randint(0, 1) :]
            found.add(name)
    return sorted(found)


@pytest.mark.parametrize("ratio", [0.7, 0.75, 0.9])
def test_resembling_names_equal_brute_force(spark, ratio):
    names = many_names(300)
    a = spark.createDataFrame([(w,) for w in names], "a string")
    met = {tuple(r) for r in R.resembling(a, a.withColumnRenamed("a", "b"), "a", "b", [], ratio).collect()}
    want = {(x, y) for x in names for y in names if x and y and N.indel_ratio(x, y) >= 100 * ratio - 1e-9}
    assert want <= met
    # Whoever is handed on has letters enough in common.
    assert all(2 * len(numbered(x) & numbered(y)) >= ratio * (len(x) + len(y)) - 1e-9 for x, y in met)


def test_resembling_names_meet_seldom(spark):
    """Names of one prefix and one ending, of which every pair shares several neighbouring letters."""
    rnd = random.Random(7)
    names = sorted({"crm_" + "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=8)) + "_items" for _ in range(400)})
    a = spark.createDataFrame([(w,) for w in names], "a string")
    met = R.resembling(a, a.withColumnRenamed("a", "b"), "a", "b", [], 0.9).count()
    want = sum(N.indel_ratio(x, y) >= 90 for x in names for y in names)
    assert want <= met < 0.05 * len(names) ** 2


@settings(max_examples=1000, deadline=None)
@given(st.text("abcxyz_", min_size=1, max_size=9), st.text("abcxyz_", min_size=1, max_size=9))
def test_names_with_a_quarter_in_common_share_a_rare_letter(a, b):
    import pandas as pd
    from difflib import SequenceMatcher

    tokens = N.rare_letters.func(pd.Series([a, b]))
    if SequenceMatcher(None, a, b).ratio() >= 0.5:
        assert set(tokens[0]) & set(tokens[1])


def test_similarity_columns(spark):
    df = spark.createDataFrame([("usr", "user"), ("", "")], "a string, b string")
    got = df.select(N.indel_similarity("a", "b"), N.matching_blocks_similarity("a", "b")).collect()
    assert got[0][0] == pytest.approx(600 / 7) and got[0][1] == pytest.approx(6 / 7)
    assert got[1][0] == 100.0 and got[1][1] == 1.0
