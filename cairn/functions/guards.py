"""Guards that fix what null, NaN and infinity mean, and type families for keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, NUMERIC)


def kind_of(df: DataFrame, column: str) -> T.DataType:
    """The type of a column; unknown names are an error that lists the columns."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r} in {df.columns}")
    return df.schema[column].dataType


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def finite(df: DataFrame, column: str) -> Column:
    """The column with NaN and infinities as null."""
    c = col(column)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) if is_float(kind_of(df, column)) else c


def family(kind: T.DataType) -> str:
    """Keys join within one of these families only; other types are no keys."""
    if is_numeric(kind):
        return "number"
    for name, types in {"boolean": T.BooleanType, "string": (T.StringType, T.VarcharType, T.CharType), "date": T.DateType, "timestamp": (T.TimestampType, T.TimestampNTZType), "binary": T.BinaryType}.items():
        if isinstance(kind, types):
            return name
    return "other"


def same_family(left: T.DataType, right: T.DataType) -> bool:
    """A date never equals a timestamp: joining them would match midnights by accident."""
    return family(left) == family(right) != "other"


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation within [-1, 1] over rows where both are not null; null below two rows or for a constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    usable = (F.count(x) > 1) & (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    scale = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.covar_pop(x, y), scale))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))
