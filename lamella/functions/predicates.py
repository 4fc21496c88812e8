"""Range filters of one column, and their translation to Catalyst predicates.

A filter is stateless: a test of values and a policy for nulls. Translated, it
is a plain comparison that Spark pushes to the Parquet scan. The semantics
that comparisons alone would not give:

* NaN fails every bounded side (Spark orders NaN above all numbers).
* Bounds of a single-precision column are narrowed to single precision.
* Integer bounds of any size are clamped to the column's domain; a range that
  misses the domain is false for every value.
* A filter on a column of another kind is false for every row, nulls included.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least and greatest value of each integer type.
INT_DOMAINS = {T.ByteType: (-(2**7), 2**7 - 1), T.ShortType: (-(2**15), 2**15 - 1), T.IntegerType: (-(2**31), 2**31 - 1), T.LongType: (-(2**63), 2**63 - 1)}
_EPOCH = dt.datetime(1970, 1, 1)
#: Days and microseconds since 1970 of the first and last day that Python and Spark both know.
_DAYS = ((dt.date.min - _EPOCH.date()).days, (dt.date.max - _EPOCH.date()).days)
_MICROS = (_DAYS[0] * 86_400_000_000, (_DAYS[1] + 1) * 86_400_000_000 - 1)


def _false() -> Column:
    return F.lit(False)


class RangeFilter:
    """Base of the filters. ``kind`` names the filter; ``null_allowed`` says whether null rows pass."""

    kind = "filter"
    null_allowed: bool = False

    def column(self, c: Column, dtype: T.DataType) -> Column:
        """The predicate for a column of this type."""
        if isinstance(dtype, (T.StringType, T.BinaryType)):
            raise NotImplementedError(f"{self.kind} filters are not defined for {dtype.simpleString()} columns")
        values = self._values(c, dtype)
        if values is None:
            return _false()
        return values | c.isNull() if self.null_allowed else values

    def _values(self, c: Column, dtype: T.DataType) -> Column | None:
        """The test of non-null values; None where the filter is of another kind than the column."""
        raise NotImplementedError

    def check_null(self, valid: bool) -> bool:
        """Whether a row passes by its validity alone."""
        return valid or self.null_allowed

    def null_column(self, c: Column) -> Column:
        return c.isNotNull() | F.lit(self.null_allowed)

    def check(self, value: object, dtype: T.DataType) -> bool:
        """The filter's verdict on one value, None being null."""
        found = self.mask(np.array([0 if value is None else value], _numpy_type(dtype)), dtype)
        if found is None:
            return False
        return self.null_allowed if value is None else bool(found[0])

    def mask(self, values: np.ndarray, dtype: T.DataType) -> np.ndarray | None:
        """Verdicts on an array of non-null values; None where the filter is of another kind."""
        raise NotImplementedError

    def may_match(self, least: object, greatest: object, has_null: bool, dtype: T.DataType) -> bool:
        """Zone map: whether rows with this least and greatest value can hold a match."""
        raise NotImplementedError

    def may_match_column(self, least: Column, greatest: Column, has_null: Column, dtype: T.DataType) -> Column:
        raise NotImplementedError


def _numpy_type(dtype: T.DataType) -> object:
    return {T.BooleanType: np.bool_, T.FloatType: np.float32, T.DoubleType: np.float64}.get(type(dtype), object if isinstance(dtype, T.DecimalType) else np.int64)


@dataclass(frozen=True)
class BoolEq(RangeFilter):
    """A boolean column equal to ``value``."""

    value: bool
    null_allowed: bool = False
    kind = "boolean"

    def _values(self, c: Column, dtype: T.DataType) -> Column | None:
        return c == F.lit(self.value) if isinstance(dtype, T.BooleanType) else None

    def mask(self, values: np.ndarray, dtype: T.DataType) -> np.ndarray | None:
        return values == self.value if isinstance(dtype, T.BooleanType) else None

    def may_match(self, least: bool | None, greatest: bool | None, has_null: bool, dtype: T.DataType) -> bool:
        if not isinstance(dtype, T.BooleanType):
            return False
        inside = least is not None and least <= self.value <= greatest
        return inside or (has_null and self.null_allowed)

    def may_match_column(self, least: Column, greatest: Column, has_null: Column, dtype: T.DataType) -> Column:
        if not isinstance(dtype, T.BooleanType):
            return _false()
        return F.coalesce((least <= F.lit(self.value)) & (greatest >= F.lit(self.value)), _false()) | (has_null & F.lit(self.null_allowed))

    def __str__(self) -> str:
        return f"boolean = {self.value}, nulls {'pass' if self.null_allowed else 'fail'}"


@dataclass(frozen=True)
class IntRange(RangeFilter):
    """Integers from ``lower`` to ``upper``, both included, of any size.

    Works on integer columns, and on the integers behind dates (days),
    timestamps without zone (microseconds) and decimals (unscaled values);
    there the bounds are turned into literals of the column's type.
    """

    lower: int
    upper: int
    null_allowed: bool = False
    kind = "integer range"

    @staticmethod
    def _domain(dtype: T.DataType) -> tuple[int, int] | None:
        if isinstance(dtype, T.DateType):
            return _DAYS
        if isinstance(dtype, T.TimestampNTZType):
            return _MICROS
        if isinstance(dtype, T.DecimalType):
            return -(10**dtype.precision) + 1, 10**dtype.precision - 1
        return INT_DOMAINS.get(type(dtype))

    @staticmethod
    def _literal(n: int, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.DateType):
            return F.lit(_EPOCH.date() + dt.timedelta(days=n))
        if isinstance(dtype, T.TimestampNTZType):
            return F.lit(_EPOCH + dt.timedelta(microseconds=n)).cast("timestamp_ntz")
        if isinstance(dtype, T.DecimalType):
            return F.lit(Decimal(n).scaleb(-dtype.scale)).cast(dtype)
        return F.lit(n).cast(dtype)

    def clamped(self, dtype: T.DataType) -> tuple[int, int] | None:
        """Bounds within the type's domain; None where no value of the type is in range."""
        least, most = self._domain(dtype)
        lo, hi = max(self.lower, least), min(self.upper, most)
        return (lo, hi) if lo <= hi else None

    def _values(self, c: Column, dtype: T.DataType) -> Column | None:
        if self._domain(dtype) is None:
            return None
        bounds = self.clamped(dtype)
        if bounds is None:
            return _false()
        lo, hi = bounds
        least, most = self._domain(dtype)
        sides = [c >= self._literal(lo, dtype)] * (lo > least) + [c <= self._literal(hi, dtype)] * (hi < most)
        return reduce(and_, sides) if sides else c.isNotNull()

    def check_wide(self, c: Column) -> Column:
        """The test on a decimal(38,0) value, for integers wider than 64 bits."""
        most = 10**38 - 1
        lo, hi = max(self.lower, -most), min(self.upper, most)
        return c.between(F.lit(Decimal(lo)).cast("decimal(38,0)"), F.lit(Decimal(hi)).cast("decimal(38,0)")) if lo <= hi else _false()

    def mask(self, values: np.ndarray, dtype: T.DataType) -> np.ndarray | None:
        if self._domain(dtype) is None:
            return None
        bounds = self.clamped(dtype)
        return np.zeros(len(values), bool) if bounds is None else (values >= bounds[0]) & (values <= bounds[1])

    def may_match(self, least: int | None, greatest: int | None, has_null: bool, dtype: T.DataType) -> bool:
        if self._domain(dtype) is None:
            return False
        bounds = self.clamped(dtype)
        inside = bounds is not None and least is not None and greatest >= bounds[0] and least <= bounds[1]
        return inside or (has_null and self.null_allowed)

    def may_match_column(self, least: Column, greatest: Column, has_null: Column, dtype: T.DataType) -> Column:
        if self._domain(dtype) is None:
            return _false()
        bounds = self.clamped(dtype)
        inside = _false() if bounds is None else (greatest >= self._literal(bounds[0], dtype)) & (least <= self._literal(bounds[1], dtype))
        return F.coalesce(inside, _false()) | (has_null & F.lit(self.null_allowed))

    def __str__(self) -> str:
        return f"integer in [{self.lower}, {self.upper}], nulls {'pass' if self.null_allowed else 'fail'}"


@dataclass(frozen=True)
class FloatRange(RangeFilter):
    """Floats between two bounds, each of which may be absent or exclusive. NaN passes only without bounds."""

    lower: float = 0.0
    upper: float = 0.0
    lower_bounded: bool = True
    upper_bounded: bool = True
    lower_included: bool = False
    upper_included: bool = False
    null_allowed: bool = False
    kind = "float range"

    def _bounds(self, dtype: T.DataType) -> tuple[float, float]:
        if isinstance(dtype, T.FloatType):
            with np.errstate(over="ignore"):
                return float(np.float32(self.lower)), float(np.float32(self.upper))
        return self.lower, self.upper

    def _nan_bound(self) -> bool:
        return (self.lower_bounded and math.isnan(self.lower)) or (self.upper_bounded and math.isnan(self.upper))

    def _values(self, c: Column, dtype: T.DataType) -> Column | None:
        if not isinstance(dtype, (T.FloatType, T.DoubleType)):
            return None
        if self._nan_bound():
            return _false()
        lo, hi = (F.lit(b).cast(dtype) for b in self._bounds(dtype))
        sides = []
        if self.lower_bounded:
            sides.append(c >= lo if self.lower_included else c > lo)
        if self.upper_bounded:
            sides.append(c <= hi if self.upper_included else c < hi)
        elif self.lower_bounded:
            sides.append(c <= F.lit(math.inf).cast(dtype))  # keeps NaN out and is still pushed to the scan
        return reduce(and_, sides) if sides else c.isNotNull()

    def mask(self, values: np.ndarray, dtype: T.DataType) -> np.ndarray | None:
        if not isinstance(dtype, (T.FloatType, T.DoubleType)):
            return None
        lo, hi = (_numpy_type(dtype)(b) for b in self._bounds(dtype))
        out = np.ones(len(values), bool)
        if self.lower_bounded:
            out &= values >= lo if self.lower_included else values > lo
        if self.upper_bounded:
            out &= values <= hi if self.upper_included else values < hi
        return out

    def may_match(self, least: float | None, greatest: float | None, has_null: bool, dtype: T.DataType) -> bool:
        if not isinstance(dtype, (T.FloatType, T.DoubleType)):
            return False
        lo, hi = self._bounds(dtype)
        inside = least is not None
        if inside and self.lower_bounded:
            inside = greatest >= lo if self.lower_included else greatest > lo
        if inside and self.upper_bounded:
            inside = least <= hi if self.upper_included else least < hi
        return inside or (has_null and self.null_allowed)

    def may_match_column(self, least: Column, greatest: Column, has_null: Column, dtype: T.DataType) -> Column:
        """As ``may_match``; a greatest value of NaN leaves the zone in, as numbers may lie below it."""
        if not isinstance(dtype, (T.FloatType, T.DoubleType)):
            return _false()
        sides = [least.isNotNull()] + [_false()] * self._nan_bound()
        lo, hi = (F.lit(b).cast(dtype) for b in self._bounds(dtype))
        if self.lower_bounded:
            sides.append(greatest >= lo if self.lower_included else greatest > lo)
        if self.upper_bounded:
            sides.append(least <= hi if self.upper_included else least < hi)
        return F.coalesce(reduce(and_, sides), _false()) | (has_null & F.lit(self.null_allowed))

    def __str__(self) -> str:
        left = ("[" if self.lower_included else "(") + str(self.lower) if self.lower_bounded else "(-inf"
        right = str(self.upper) + ("]" if self.upper_included else ")") if self.upper_bounded else "+inf)"
        return f"float in {left}, {right}, nulls {'pass' if self.null_allowed else 'fail'}"


@dataclass(frozen=True)
class Const(RangeFilter):
    """The same verdict on every row, nulls included, whatever the column's type."""

    value: bool
    kind = "constant"

    @property
    def null_allowed(self) -> bool:  # type: ignore[override]
        return self.value

    def column(self, c: Column, dtype: T.DataType) -> Column:
        return F.lit(self.value)

    def check_null(self, valid: bool) -> bool:
        return self.value

    def check(self, value: object, dtype: T.DataType) -> bool:
        return self.value

    def mask(self, values: np.ndarray, dtype: T.DataType) -> np.ndarray:
        return np.full(len(values), self.value)

    def may_match(self, least: object, greatest: object, has_null: bool, dtype: T.DataType) -> bool:
        return self.value

    def may_match_column(self, least: Column, greatest: Column, has_null: Column, dtype: T.DataType) -> Column:
        return F.lit(self.value)

    def __str__(self) -> str:
        return f"always {self.value}"


@dataclass(frozen=True)
class Custom(RangeFilter):
    """A caller's own predicate: any function from the column to a boolean ``Column``.

    Nulls pass by ``null_allowed`` and not by what the predicate makes of them.
    """

    predicate: object
    null_allowed: bool = False
    kind = "custom"

    def column(self, c: Column, dtype: T.DataType) -> Column:
        values = F.coalesce(self.predicate(c), _false()) & c.isNotNull()
        return values | c.isNull() if self.null_allowed else values

    def may_match(self, least: object, greatest: object, has_null: bool, dtype: T.DataType) -> bool:
        """A zone with any value may match: the predicate isn't known to follow the order of values."""
        return least is not None or (has_null and self.null_allowed)

    def may_match_column(self, least: Column, greatest: Column, has_null: Column, dtype: T.DataType) -> Column:
        return least.isNotNull() | (has_null & F.lit(self.null_allowed))

    def __str__(self) -> str:
        return f"custom predicate, nulls {'pass' if self.null_allowed else 'fail'}"
