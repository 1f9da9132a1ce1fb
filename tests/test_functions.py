from datetime import date
from decimal import ROUND_HALF_UP, Context, Decimal
from fractions import Fraction
from statistics import variance as exact_sample_variance

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordersight import functions as fn
from ordersight.operators import rating_spread


def texts(spark, *items):
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")


def column(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_normalize_key_trims_lowers_and_maps_aliases(spark):
    df = texts(spark, "chennai", "CHENNAI", " Chennai", "Pondy", None)
    key = fn.normalize_key(F.col("v"), {"pondy": "pondicherry"})
    assert column(df, key) == ["chennai", "chennai", "chennai", "pondicherry", None]


def test_title_key(spark):
    df = texts(spark, " middle EAST ", "navi-mumbai", "o'NEIL", "", None)
    titles = ["Middle East", "Navi-Mumbai", "O'Neil", "", None]
    assert column(df, fn.title_key(F.col("v"))) == titles


def test_parse_mixed_date_takes_other_formats(spark):
    df = texts(spark, "2022-03-14", "14/02/2022", "14-Feb-2022")
    slashes = {"^[0-9]{2}/[0-9]{2}/[0-9]{4}$": "dd/MM/yyyy"}
    days = column(df, fn.parse_mixed_date(F.col("v"), slashes))
    assert days == [date(2022, 3, 14), date(2022, 2, 14), None]


def test_parse_mixed_date_knows_two_formats(spark):
    df = texts(
        spark, "2022-03-14", "14-Feb-2022", "5-feb-2022", "bad", "14-Xyz-2022", "2022-02-30", None
    )
    assert column(df, fn.parse_mixed_date(F.col("v"))) == [
        date(2022, 3, 14),
        date(2022, 2, 14),
        date(2022, 2, 5),
        None,
        None,
        None,
        None,
    ]


def test_iso_date_is_not_read_as_minutes(spark):
    df = texts(spark, "2024-02-14", " 2024-02-14 ", "2024-02-14 10:30:00")
    assert column(df, fn.parse_iso_date(F.col("v"))) == [date(2024, 2, 14)] * 3


def test_weekend(spark):
    df = texts(spark, "2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08", None)
    assert column(df, fn.is_weekend(F.col("v").cast("date"))) == [False, True, True, False, False]


def test_bucketize_bounds_and_null(spark):
    df = spark.createDataFrame(
        list(enumerate([29, 30, 44, 45, 59, 60, None])), "i int, v int"
    )
    label = fn.bucketize(F.col("v"), (30, 45, 60), ("a", "b", "c", "d"), "unknown")
    assert column(df, label) == ["a", "b", "b", "c", "c", "d", "unknown"]
    with pytest.raises(ValueError):
        fn.bucketize(F.col("v"), (30,), ("a",), "unknown")


MANY_DIGITS = Context(prec=90)


def rounded(n, d, places):
    exact = Fraction(n) / Fraction(d)
    scaled = abs(exact) * 10**places
    whole = (2 * scaled.numerator + scaled.denominator) // (2 * scaled.denominator)
    return MANY_DIGITS.scaleb(Decimal(whole if exact >= 0 else -whole), -places)


@settings(max_examples=15, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.decimals(-(10**14), 10**14, places=2), st.integers(-(10**9), 10**9)
        ),
        min_size=1,
        max_size=40,
    )
)
def test_exact_ratio_rounds_half_away_from_zero(spark, pairs):
    rows = [(i, n, d) for i, (n, d) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, n decimal(24,2), d bigint")
    got = column(df, fn.exact_ratio(F.col("n"), F.col("d"), 2))
    assert got == [None if d == 0 else rounded(n, d, 2) for n, d in pairs]


WIDE = st.decimals(-(10**30) + 1, 10**30 - 1, places=6)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(WIDE, WIDE), min_size=1, max_size=40))
def test_exact_ratio_of_sums_of_any_size(spark, pairs):
    pairs = pairs + [(n, rounded(Fraction(d) * Fraction(n), 10**40, 6)) for n, d in pairs]
    pairs = pairs + [(d, n) for n, d in pairs]
    wanted = [None if d == 0 else rounded(n, d, 2) for n, d in pairs]
    fits = [i for i, w in enumerate(wanted) if w is None or abs(w) < 10**32]
    rows = [(i, *pairs[i]) for i in fits]
    df = spark.createDataFrame(rows, "i int, n decimal(38,6), d decimal(38,6)")
    assert column(df, fn.exact_ratio(F.col("n"), F.col("d"), 2)) == [wanted[i] for i in fits]
    shares = fn.percent(F.col("n"), F.col("d"), 2)
    fits = [i for i in fits if wanted[i] is None or abs(wanted[i]) < 10**29]
    wide = column(df.filter(F.col("i").isin(fits)), shares)
    assert wide == [None if pairs[i][1] == 0 else rounded(100 * Fraction(pairs[i][0]), pairs[i][1], 2) for i in fits]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.decimals(-(10**22) + 1, 10**22 - 1, places=4), st.integers(0, 10**12)), min_size=1))
def test_per_count_of_any_size(spark, pairs):
    rows = [(i, n, d) for i, (n, d) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, n decimal(38,4), d bigint")
    got = column(df, fn.per_count(F.col("n"), F.col("d"), 2))
    assert got == [None if d == 0 else rounded(n, d, 2) for n, d in pairs]
    too_large = spark.createDataFrame([(Decimal(10**22),)], "n decimal(38,4)")
    with pytest.raises(Exception, match="does not fit"):
        too_large.select(fn.per_count(F.col("n"), F.lit(7), 2)).collect()


@settings(max_examples=15, deadline=None)
@given(
    st.lists(
        st.decimals(-(10**32) + 1, 10**32 - 1, places=6) | st.decimals(-9, 9, places=2),
        min_size=1,
        max_size=40,
    )
)
def test_wide_mean_holds_sums_beyond_38_digits(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v decimal(38,6)")
    total = sum(Fraction(v) for v in values)
    assert df.agg(fn.wide_mean(F.col("v"), 2)).first()[0] == rounded(total, len(values), 2)


def test_wide_mean_where_a_plain_sum_fails(spark):
    df = spark.createDataFrame([(Decimal(10**32 - 1),)] * 50, "v decimal(38,6)")
    assert df.agg(fn.mean_of(df.schema["v"].dataType)(F.col("v"), 2)).first()[0] == 10**32 - 1
    with pytest.raises(Exception, match="(?i)overflow|out of range|NUMERIC_VALUE|cannot be represented"):
        df.agg(fn.mean(F.col("v"), 2)).collect()
    assert fn.mean_of(df.select(F.col("v").cast("decimal(12,2)")).schema["v"].dataType) is fn.mean


def test_finer_digits_of_large_sums_are_not_dropped(spark):
    """As doubles, the sum and what is left of it after a cast are equal."""
    df = spark.createDataFrame([(Decimal("123456789012345678.000049"),)], "v decimal(38,6)")
    with pytest.raises(Exception, match="does not fit"):
        df.select(fn.per_count(F.col("v"), F.lit(1), 6)).collect()
    exact = df.select(fn.exact_ratio(F.col("v"), F.lit(1), 6)).first()[0]
    with pytest.raises(Exception, match="does not fit"):
        df.select(fn.exact_ratio(F.lit(1), F.lit(Decimal(10**31)), 2)).collect()
    assert exact == Decimal("123456789012345678.000049")
    halves = df.select(fn.exact_ratio(F.lit(0.1), F.lit(1), 1), fn.exact_ratio(F.lit(0.5), F.lit(2), 2))
    assert halves.first() == (Decimal("0.1"), Decimal("0.25"))


def test_exact_ratio_ties(spark):
    rows = [(0, 1, 8), (1, -1, 8), (2, 201, 200), (3, 2, 3)]
    df = spark.createDataFrame(rows, "i int, n bigint, d bigint")
    ratio = column(df, fn.exact_ratio(F.col("n"), F.col("d"), 2))
    assert [float(r) for r in ratio] == [0.13, -0.13, 1.01, 0.67]


def test_mean_skips_null_and_is_null_without_values(spark):
    df = spark.createDataFrame([(1, 4), (1, None), (1, 5), (2, None)], "k int, v int")
    rows = df.groupBy("k").agg(fn.mean(F.col("v"), 2).alias("m")).orderBy("k").collect()
    assert [r.m for r in rows] == [Decimal("4.50"), None]


def test_fractions_of_a_cent_count_and_finer_ones_are_refused(spark):
    rows = [(Decimal("0.0050"),), (Decimal("0"),)]
    df = spark.createDataFrame(rows, "v decimal(12,4)")
    assert df.agg(fn.mean(F.col("v"), 2)).first()[0] == Decimal("0.00")
    fine = df.select((F.col("v").cast("decimal(12,6)") + F.lit("0.000001").cast("decimal(12,6)")).alias("v"))
    with pytest.raises(Exception, match="does not fit"):
        fine.agg(fn.mean(F.col("v"), 2)).collect()


def test_fractional_ratings_are_exact_and_floats_refused(spark):
    df = spark.createDataFrame([(Decimal("4.5"),), (Decimal("3.5"),)], "r decimal(2,1)")
    sums = df.agg(*rating_spread(df, "r"))
    args = (F.col("rated"), F.col("rating_sum"), F.col("rating_squares"))
    assert sums.first()[:2] == (2, Decimal("8.0"))
    assert sums.select(fn.sample_variance(*args, 2)).first()[0] == Decimal("0.50")
    with pytest.raises(TypeError):
        rating_spread(df.select(F.col("r").cast("double").alias("r")), "r")


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=30))
def test_variances_match_the_definition(spark, ratings):
    df = spark.createDataFrame([(r,) for r in ratings], "v bigint")
    sums = df.agg(
        F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")
    )
    args = (F.col("n"), F.col("s"), F.col("q"))
    sample, population = sums.select(fn.sample_variance(*args, 2), fn.variance(*args)).first()
    if len(ratings) == 1:
        assert sample is None and population == 0
    else:
        exact = exact_sample_variance([Fraction(r) for r in ratings])
        tie_up = Decimal(exact.numerator) / Decimal(exact.denominator)
        assert sample == tie_up.quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert population == pytest.approx(float(exact) * (len(ratings) - 1) / len(ratings))
