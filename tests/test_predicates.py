"""Truth tables of the filters: plain Python, numpy masks and Spark must agree."""

from __future__ import annotations

import datetime as dt
import itertools
import math
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions.predicates import BoolEq, Const, Custom, FloatRange, IntRange

FLOATS = [None, math.nan, -math.inf, math.inf, -0.0, 0.0, 0.1, -1.5, 1.5, 2.0, 1e300]


def kept(spark, values, dtype, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", dtype)]))
    return {r.i for r in df.filter(f.column(F.col("v"), dtype)).collect()}


def plain_float(v, f, single):
    """The filter's definition, in IEEE comparisons."""
    if v is None:
        return f.null_allowed
    narrow = (lambda x: float(np.float32(x))) if single else (lambda x: x)
    v, lo, hi = narrow(v), narrow(f.lower), narrow(f.upper)
    low = not f.lower_bounded or (v >= lo if f.lower_included else v > lo)
    return low and (not f.upper_bounded or (v <= hi if f.upper_included else v < hi))


@pytest.mark.filterwarnings("ignore:overflow")
@pytest.mark.parametrize("dtype", [T.DoubleType(), T.FloatType()])
def test_float_ranges_follow_ieee(spark, dtype):
    single = isinstance(dtype, T.FloatType)
    bounds = [(0.1, 1.5), (1.5, 0.1), (0.0, 0.0), (-math.inf, math.inf), (math.nan, 1.0), (0.0, math.nan), (0.1, 0.1)]
    filters = [FloatRange(lo, hi, *flags) for lo, hi in bounds for flags in itertools.product([True, False], repeat=5)]
    df = spark.createDataFrame([(v,) for v in FLOATS], T.StructType([T.StructField("v", dtype)])).coalesce(1)
    for start in range(0, len(filters), 56):
        part = filters[start : start + 56]
        rows = df.select(*(F.coalesce(f.column(F.col("v"), dtype), F.lit(False)).alias(f"f{i}") for i, f in enumerate(part))).collect()
        for v, row in zip(FLOATS, rows, strict=True):
            for i, f in enumerate(part):
                assert row[i] == plain_float(v, f, single), (v, f)
                assert f.check(v, dtype) == plain_float(v, f, single), (v, f)


def test_integer_bounds_are_clamped(spark):
    values = [None, -(2**31), -1, 0, 5, 2**31 - 1]
    kind = T.IntegerType()
    assert kept(spark, values, kind, IntRange(0, 5)) == {3, 4}
    assert kept(spark, values, kind, IntRange(5, 5, True)) == {0, 4}
    assert kept(spark, values, kind, IntRange(-(2**100), 2**100)) == {1, 2, 3, 4, 5}
    assert kept(spark, values, kind, IntRange(2**31, 2**40, True)) == {0}
    assert kept(spark, values, kind, IntRange(5, 0)) == set()
    assert kept(spark, [None, -(2**63), 2**63 - 1], T.LongType(), IntRange(0, 2**70)) == {2}


def test_integers_behind_other_types(spark):
    days = [dt.date(1969, 12, 31), dt.date(1970, 1, 3), None]
    assert kept(spark, days, T.DateType(), IntRange(0, 10)) == {1}
    times = [dt.datetime(1970, 1, 1, 0, 0, 1), dt.datetime(1970, 1, 2)]
    assert kept(spark, times, T.TimestampNTZType(), IntRange(0, 1_000_000)) == {0}
    assert kept(spark, [Decimal("1.25"), Decimal("1.50")], T.DecimalType(9, 2), IntRange(126, 150)) == {1}


def test_wide_integers(spark):
    df = spark.range(1).select(F.lit(Decimal(10**30)).cast("decimal(38,0)").alias("v"))
    assert df.filter(IntRange(10**29, 10**31).check_wide(F.col("v"))).count() == 1
    assert df.filter(IntRange(0, 10**29).check_wide(F.col("v"))).count() == 0


@pytest.mark.parametrize(("value", "nulls", "want"), [(True, False, {0}), (True, True, {0, 2}), (False, False, {1}), (False, True, {1, 2})])
def test_booleans(spark, value, nulls, want):
    assert kept(spark, [True, False, None], T.BooleanType(), BoolEq(value, nulls)) == want


def test_other_kind_is_false_even_for_nulls(spark):
    assert kept(spark, [1.0, None], T.DoubleType(), IntRange(0, 5, True)) == set()
    assert kept(spark, [1, None], T.IntegerType(), FloatRange(0.0, 5.0, null_allowed=True)) == set()
    assert kept(spark, [1, None], T.IntegerType(), BoolEq(True, True)) == set()
    assert IntRange(0, 5, True).check(None, T.DoubleType()) is False


def test_strings_are_refused():
    for kind in (T.StringType(), T.BinaryType()):
        with pytest.raises(NotImplementedError):
            IntRange(0, 1).column(None, kind)


def test_constants_and_custom(spark):
    assert kept(spark, [1, None], T.IntegerType(), Const(True)) == {0, 1}
    assert kept(spark, [1, None], T.IntegerType(), Const(False)) == set()
    odd = lambda c: c % 2 == 1
    assert kept(spark, [1, 2, None], T.IntegerType(), Custom(odd)) == {0}
    assert kept(spark, [1, 2, None], T.IntegerType(), Custom(odd, True)) == {0, 2}
    assert Const(True).check(None, T.StringType()) and not Const(False).check_null(True)


def test_null_check_looks_at_validity_only():
    for nulls in (True, False):
        assert FloatRange(null_allowed=nulls).check_null(True)
        assert IntRange(0, 1, nulls).check_null(False) == nulls


def test_text_forms():
    assert str(IntRange(1, 2)) == "integer in [1, 2], nulls fail"
    assert str(FloatRange(1.0, 2.0, lower_included=True, null_allowed=True)) == "float in [1.0, 2.0), nulls pass"
    assert str(FloatRange(lower_bounded=False, upper_bounded=False)) == "float in (-inf, +inf), nulls fail"
    assert str(BoolEq(True)) == "boolean = True, nulls fail" and str(Const(False)) == "always False"
    assert IntRange(0, 1).kind == "integer range"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-1000, 1000), min_size=1, max_size=20), st.integers(-1200, 1200), st.integers(-1200, 1200), st.booleans())
def test_integer_zone_map_is_sound(values, lo, hi, has_null):
    f = IntRange(lo, hi, True)
    dtype = T.LongType()
    found = any(f.check(v, dtype) for v in values) or has_null
    assert f.may_match(min(values), max(values), has_null, dtype) >= found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=1, max_size=20), st.floats(-120, 120), st.floats(-120, 120), st.tuples(*[st.booleans()] * 4))
def test_float_zone_map_is_sound(values, lo, hi, flags):
    f = FloatRange(lo, hi, *flags)
    dtype = T.DoubleType()
    assert f.may_match(min(values), max(values), False, dtype) >= any(f.check(v, dtype) for v in values)


def test_zone_map_honours_inclusion_and_domain():
    d = T.DoubleType()
    assert not FloatRange(5.0, 9.0).may_match(1.0, 5.0, False, d)
    assert FloatRange(5.0, 9.0, lower_included=True).may_match(1.0, 5.0, False, d)
    assert not IntRange(2**31, 2**40).may_match(0, 10, False, T.IntegerType())
    assert IntRange(2**31, 2**40, True).may_match(0, 10, True, T.IntegerType())
    assert not IntRange(0, 1).may_match(None, None, True, T.IntegerType())


def test_masks_of_arrays():
    assert IntRange(2, 3).mask(np.arange(5), T.IntegerType()).tolist() == [False, False, True, True, False]
    assert FloatRange(0.1, 1.0).mask(np.array([0.1, 0.5, np.nan], np.float32), T.FloatType()).tolist() == [False, True, False]
    assert BoolEq(True).mask(np.array([True, False]), T.BooleanType()).tolist() == [True, False]
    assert IntRange(0, 1).mask(np.zeros(1), T.DoubleType()) is None
