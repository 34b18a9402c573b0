"""Literal values of the column functions."""

import difflib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgertone import functions as fn
from ledgertone.functions import text as tx
from ledgertone.functions.curves import leading_numbers, loose_pair
from ledgertone.operators.duplicates import ALIKE, brand_fuzzy_pairs
from ledgertone.operators.typos import near_words


def values(spark, items, make, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make("x")).collect()]


def test_ascii_fold_is_compatibility_decomposition(spark):
    rng = random.Random(1)
    pool = [chr(c) for c in (*range(32, 0x250), *range(0x2000, 0x2200), *range(0x3300, 0x3400), *range(0xFB00, 0xFB07), 0x1D400, 0x2F800)]
    texts = ["".join(rng.choices(pool, k=12)) for _ in range(300)]
    want = [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]
    assert values(spark, texts, tx.ascii_fold) == want


@pytest.mark.parametrize(
    "parts,want",
    [(("Moondrop", "Chu II", ""), "moondrop_chu_ii"), (("7HZ", "Zero+", "Black"), "7hz_zero_plus_black"), (("", "", ""), "")],
)
def test_build_id(spark, parts, want):
    df = spark.createDataFrame([parts], "a string, b string, c string")
    assert df.select(fn.build_id("a", "b", "c")).first()[0] == want


def test_build_id_of_other_scripts_is_a_digest(spark):
    name = "".join(map(chr, (0x30BD, 0x30CB, 0x30FC)))
    df = spark.createDataFrame([(name, "WH", "")], "a string, b string, c string")
    first = df.select(fn.build_id("a", "b", "c")).first()[0]
    assert first.startswith("x") and first.endswith("_wh") and len(first) == 10


def test_coerce_int(spark):
    texts = ["$1,299", "12,50", "18 ohm", "high", "1_000", "239.5", "-3", "1e999", "1,299.50", "2f", " 7 ", "1,299 ohm", "", "1234,567"]
    assert values(spark, texts, fn.coerce_int) == [1299, 0, 18, 0, 0, 240, -3, 0, 1300, 0, 7, 1299, 0, 0]


def test_prices(spark):
    prices = [98.0, 498.0, 1498.0, -3.0, 22.0, 0.0, 12.5]
    assert values(spark, prices, fn.round_to_5, "double") == [100, 500, 1500, 0, 20, 0, 15]
    tiers = values(spark, [98.0, 498.0, 1498.0, 20.0], lambda c: fn.price_tier(fn.tier_basis(c)), "double")
    assert tiers == ["Mid-Tier", "Premium", "Flagship", "Budget"]


def test_drivers(spark):
    df = spark.createDataFrame([("1BC+1EST+4BA+1DD",), ("1dd+2ba",), ("1DD+2microPE",), ("",)], "c string")
    rows = df.select(fn.classify_driver(fn.driver_parts("c")).alias("d"), fn.unknown_driver_tokens("c").alias("u")).collect()
    assert [tuple(r.d) for r in rows] == [("Tribrid", "1DD+4BA+1EST+1BC"), ("Hybrid", "1DD+2BA"), ("DD", "1DD"), ("", "")]
    assert rows[2].u == ["2microPE"]


def test_line_fields(spark):
    lines = ["20;50,5", "20,5 60,25", "20,112.594", "20\t50.5\t1"]
    rows = values(spark, lines, lambda c: leading_numbers(fn.split_fields(c)))
    assert [(r.freq, r.spl) for r in rows] == [(20.0, 50.5), (20.5, 60.25), (20.0, 112.594), (20.0, 50.5)]
    pair = values(spark, ["Freq = 20, SPL = 50"], loose_pair)[0]
    assert (pair.freq, pair.spl) == (20.0, 50.0)


def test_paths(spark):
    assert values(spark, ["./data//A/./b.txt ", "data\\x.txt"], fn.normalize_path) == ["data/A/b.txt", "data/x.txt"]
    assert values(spark, ["../x", "/x", "C:x", "a/../b", " ", "a/b"], fn.safe_path) == [False] * 5 + [True]


def _osa(a, b, swaps=True):
    d = {}
    for i in range(-1, len(a) + 1):
        d[i, -1] = i + 1
    for j in range(-1, len(b) + 1):
        d[-1, j] = j + 1
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if swaps and i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@pytest.mark.parametrize("held", [100_000, 10])
@pytest.mark.parametrize("method", ["osa", "levenshtein"])
def test_near_words_equals_brute_force(spark, method, held):
    """Walked and joined; words of one letter up to beyond a state's 62, repeats, empty and null words."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(120)})
    tall = ["".join(rng.choices("ab", k=n)) for n in (61, 62, 63, 64, 70)]
    cores, pool = words[:60] + [w[1:] for w in tall], words[60:] + [w[:9] + w[10] + w[9] + w[11:] for w in tall]
    got = near_words(
        spark.createDataFrame([(w,) for w in [*cores, cores[0], None]], "core string"),
        spark.createDataFrame([(w,) for w in [*pool, pool[0], "", None]], "word string"), method, held,
    )
    distance = _osa if method == "osa" else lambda a, b: _osa(a, b, swaps=False)
    want = sorted((a, b, distance(a, b)) for a in cores for b in pool if distance(a, b) <= 2)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_no_words_are_near_nothing(spark):
    none, one = spark.createDataFrame([], "core string"), spark.createDataFrame([("abc",)], "core string")
    pool = spark.createDataFrame([("abc",)], "word string")
    assert near_words(none, pool).count() == 0
    assert near_words(one, pool.where("word = ''")).count() == 0


def test_name_candidates_miss_no_alike_pair(spark):
    """Every pair the ratio calls alike and the cheap rules allow is found, against all pairs."""
    rng = random.Random(3)
    stems = ["blessing", "aria snow", "chu", "variations", "space travel", "kato titanium"]
    names = set()
    while len(names) < 90:
        s = list(rng.choice(stems))
        for _ in range(rng.randint(0, 3)):
            s.insert(rng.randrange(len(s) + 1), rng.choice("aeiox"))
        names.add(" ".join("".join(s).split()))
    names = sorted(names)
    df = spark.createDataFrame([(i, n, i) for i, n in enumerate(names)], "row_id long, name string, spec long")
    got = brand_fuzzy_pairs(df, F.lit("b"), F.col("name"), ["spec"], method="gestalt").where("kind = 'similar'")
    got = {(r.name_a, r.name_b) for r in got.collect()}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            shares = bool(set(a.split()) & set(b.split()))
            common = len([1 for k in range(1, min(len(a), len(b)) + 1) if a[:k] == b[:k]])
            allowed = common >= 3 or shares or (abs(len(a) - len(b)) <= 2 and common >= 2)
            alike = difflib.SequenceMatcher(None, a, b).ratio() >= ALIKE
            assert ((a, b) in got) == (alike and allowed), (a, b)
