"""Column expressions on numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATING = (T.DoubleType, T.FloatType)
_NUMERIC = (T.NumericType,)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC) and f.name not in exclude]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column, so aggregates skip missing values."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, _FLOATING)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def finite_or_null(df: DataFrame) -> DataFrame:
    """Replace NaN and infinities by NULL in every floating column, as a database write needs."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, _FLOATING)]
    finite = {c: F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.col(c)) for c in floats}
    return df.withColumns(finite)


def box_cox(x: Column, lam: float) -> Column:
    return F.ln(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)


def inverse_box_cox(z: Column, lam: float) -> Column:
    return F.exp(z) if lam == 0 else F.pow(z * F.lit(lam) + 1, F.lit(1.0 / lam))


def yeo_johnson(x: Column, lam: float) -> Column:
    """Yeo and Johnson (2000): Box-Cox of x+1 for x >= 0, of 1-x with power 2-lambda and sign flipped below."""
    return F.when(x >= 0, box_cox(F.greatest(x, F.lit(0.0)) + 1, lam)).when(
        x < 0, -box_cox(F.greatest(-x, F.lit(0.0)) + 1, 2.0 - lam)
    )


def inverse_yeo_johnson(z: Column, lam: float) -> Column:
    return F.when(z >= 0, inverse_box_cox(F.greatest(z, F.lit(0.0)), lam) - 1).when(
        z < 0, 1 - inverse_box_cox(F.greatest(-z, F.lit(0.0)), 2.0 - lam)
    )
