"""Sums and averages of floats that are exact whatever the order and the partitions.

A float stands for the shortest decimal that reads back as it (its text). Values
below 1e10 whose decimal has at most PLACES places, which prices and shares
have, are summed as decimals. Every other value belongs to the class of its
magnitude (ten decimal digits wide), is brought to the same range by its text's
exponent, and is summed there. Only classes that occur get a sum of their own;
which ones do is asked once for all columns. The sums of all classes are put
together for each group, and only that result is rounded to a float.
"""

from __future__ import annotations

import decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.guards import finite, is_float, kind_of

#: Decimal places of a summand, which leaves room for 10**11 rows, and digits of a class.
PLACES, WIDTH = 17, 10
_KIND = T.DecimalType(38, PLACES)


def _text(x: Column) -> Column:
    return x.cast("string")


def _decimal(x: Column) -> Column:
    return _text(x).try_cast(_KIND)


def _plain(x: Column) -> Column:
    """Whether the value goes into the plain sum."""
    small = F.abs(x) < 10.0**WIDTH
    return small & F.coalesce(F.when(small, _decimal(x)).cast("double") == x, F.lit(False))


def _magnitude(x: Column) -> Column:
    """The class of the other values, from the exponent of their text."""
    return F.floor(F.floor(F.log10(F.abs(x))) / WIDTH).cast("int")


def _shifted(x: Column, magnitude: int) -> Column:
    """x / 10 ** (WIDTH * magnitude) without rounding."""
    parts = F.split(_text(x), "E")
    power = F.coalesce(F.try_element_at(parts, F.lit(2)).cast("int"), F.lit(0)) - WIDTH * magnitude
    return F.concat(parts[0], F.lit("E"), power.cast("string")).try_cast(_KIND)


@F.udf(T.DoubleType())
def _together(sums, count):
    """Sum, or average if there is a count, of (class, sum) pairs; rounded once."""
    with decimal.localcontext(decimal.Context(prec=1200)):
        total = sum((s.value.scaleb(WIDTH * s.magnitude) for s in sums if s.value is not None), decimal.Decimal(0))
    if count is None:
        return float(total)
    with decimal.localcontext(decimal.Context(prec=1200)):
        return float(total / count) if count else None


class ExactFloats:
    """Exact sums of the float columns of a table: asks once which classes of magnitude they have."""

    def __init__(self, df: DataFrame, columns: list[str], sources: dict[str, DataFrame] | None = None):
        """sources: tables by alias whose columns ``df`` has as alias.column; they are asked instead of ``df``."""
        self.df = df
        floats = [c for c in dict.fromkeys(columns) if is_float(kind_of(df, c))]
        self.classes: dict[str, list[int]] = {}
        asked: dict[str | None, list[tuple[str, str]]] = {}
        for c in floats:
            alias, _, own = c.partition(".")
            known = sources is not None and alias in sources and own in sources[alias].columns
            asked.setdefault(alias if known else None, []).append((c, own if known else c))
        for alias, names in asked.items():
            at = df if alias is None else sources[alias]
            odd = lambda x: F.when(~_plain(x) & (x != 0), _magnitude(x))
            found = at.agg(*[F.collect_set(odd(finite(at, own).cast("double"))).alias(f"c{i}") for i, (_, own) in enumerate(names)]).first()
            self.classes |= {c: sorted(found[i]) for i, (c, _) in enumerate(names)}

    def _parts(self, x: Column, classes: list[int]) -> Column:
        plain = _plain(x) | (x == 0)
        sums = [F.struct(F.lit(0).alias("magnitude"), F.sum(F.when(plain, _decimal(x))).alias("value"))]
        sums += [F.struct(F.lit(k).alias("magnitude"), F.sum(F.when(~plain & (_magnitude(x) == k), _shifted(x, k))).alias("value")) for k in classes]
        return F.array(*sums)

    def total(self, column: str) -> Column:
        """Sum of the finite values, 0 for none; integers and decimals stay what they are."""
        x, kind = finite(self.df, column), kind_of(self.df, column)
        if not is_float(kind):
            return F.coalesce(F.sum(x if isinstance(kind, T.DecimalType) else x.cast(T.DecimalType(38, 0))), F.lit(0))
        x = x.cast("double")
        if not self.classes[column]:
            return F.coalesce(F.sum(_decimal(x)).cast("double"), F.lit(0.0))
        return _together(self._parts(x, self.classes[column]), F.lit(None).cast("long"))

    def average(self, column: str) -> Column:
        """Exact sum of the finite values by their number, null for none."""
        x = finite(self.df, column)
        n = F.count(x)
        if self.classes.get(column):
            return _together(self._parts(x.cast("double"), self.classes[column]), n)
        return F.try_divide(self.total(column).cast("double"), n)
