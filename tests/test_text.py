import random

import pytest
from pyspark.sql import functions as F

from siftspark.functions import dates, fuzzy, scoring, text
from siftspark.plans.request import parse_query

CASES = [
    "Hello, World-wide 42nd!", "Crème BRÛLÉE", "ΟΔΟΣ Straße", "東京tower大阪", "한국어 text", "a_b a.b", "", "...", "x" * 100, "İstanbul", "naïve café №5 ½", "日本語", "\U00020000b",
]


def test_column_and_python_tokens_agree(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, t string").select("i", text.terms(F.col("t")).alias("w")).orderBy("i").collect()
    for case, row in zip(CASES, rows, strict=True):
        assert row["w"] == text.tokenize(case), case


def test_folding():
    assert text.tokenize("Crème BRÛLÉE") == ["creme", "brulee"]
    assert text.tokenize("ΟΔΟΣ") == ["οδοσ"]
    assert text.tokenize("東京tower") == ["東", "京", "tower"]
    assert text.tokenize("x" * 100) == ["x" * 64]
    assert len(text.tokenize("한")[0]) == 3


def test_null_text_has_no_tokens(spark):
    assert spark.createDataFrame([(None,)], "t string").select(text.terms(F.col("t")).alias("w")).first()["w"] is None


def test_values_keep_a_gap(spark):
    df = spark.createDataFrame([(["a b", None, "...", "c"],), ([],), (None,)], "v array<string>").select(text.positioned(F.col("v")).alias("p"))
    rows = [r["p"] for r in df.collect()]
    assert [(x["term"], x["pos"]) for x in rows[0]] == [("a", 0), ("b", 1), ("c", 102)]
    assert rows[1] == [] and rows[2] is None


def _plain_damerau(a, b):
    """Lowrance and Wagner's table by its definition."""
    far = len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    last = {}
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            i1, j1 = last.get(b[j - 1], 0), db
            cost = 0 if a[i - 1] == b[j - 1] else 1
            if cost == 0:
                db = j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[i1 - 1, j1 - 1] + (i - i1 - 1) + 1 + (j - j1 - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_distance_against_its_definition():
    rng = random.Random(4)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        want = _plain_damerau(a, b)
        for most in (0, 1, 2, 20):
            assert fuzzy.distance(a, b, most) == (want if want <= most and abs(len(a) - len(b)) <= most else None), (a, b)
    assert fuzzy.distance("ca", "abc", 3) == 2
    assert fuzzy.distance("a", "b" * 65, 90) is None


def test_near_terms_has_all_that_brute_force_has(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(2, 8))) for _ in range(600)})
    df = spark.createDataFrame([(w,) for w in words], "term string")
    for most in (1, 2):
        got = {(r["term"], r["edits"]) for r in fuzzy.near_terms(df, "abcde", most).collect()}
        assert got == {(w, d) for w in words if (d := fuzzy.distance("abcde", w, most)) is not None}


@pytest.mark.parametrize(
    "value",
    ["2024-02-29T12:30:45Z", "2024-02-30T00:00:00Z", "2023-02-29T00:00:00Z", "2020-01-01 00:00:00", "2020-01-01t00:00:00.1239+02:30", "2016-12-31T23:59:60Z", "2020-01-01T00:00:00,5z",
     "1969-12-31T23:59:59-00:30", "2020-13-01T00:00:00Z", "2020-01-01", "", "2020-01-01T24:00:00Z", "2020-01-01T00:60:00Z", "2020-1-01T00:00:00Z"],
)
def test_dates_agree(spark, value):
    got = spark.createDataFrame([(value,)], "t string").select(dates.millis(F.col("t")).alias("m")).first()["m"]
    assert got == dates.epoch_millis(value)


def test_date_values():
    assert dates.epoch_millis("1970-01-01T00:00:00.0019Z") == 1
    assert dates.epoch_millis("1970-01-01T01:00:00+01:00") == 0
    assert dates.epoch_millis("1970-01-01T00:00:60Z") == 59_000


def test_smallest_span_against_brute_force(spark):
    import itertools

    rng = random.Random(6)
    cases = [[sorted(rng.sample(range(40), rng.randint(1, 5))) for _ in range(rng.randint(1, 4))] for _ in range(120)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, l array<array<int>>")
    for row in df.select("l", scoring.smallest_span(F.col("l"), F.size("l")).alias("s")).collect():
        assert row["s"] == min(max(x) - min(x) for x in itertools.product(*row["l"]))


def test_query_text():
    q = parse_query('red "mouse pad" big "one" "open end')
    assert q.tokens == ["red", "mouse", "pad", "big", "one", "open", "end"]
    assert q.phrases == [(1, 2)]
    assert parse_query(' "" ').tokens == []
