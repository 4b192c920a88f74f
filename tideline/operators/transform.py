"""Log transform before a fit, and components back in the original domain after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prepare_input(df: DataFrame, log: bool = False, floor: float = 1e-6) -> DataFrame:
    """NaN to NULL; with ``log`` the natural logarithm of values above ``floor``, others missing."""
    y = F.when(~F.isnan("y"), F.col("y"))
    return df.withColumn("y", F.when(y > floor, F.ln(y)) if log else y)


def recover_components(frame: DataFrame, roles: Sequence[str], log: bool = False) -> DataFrame:
    """Roles and residual (factors if ``log``) and their sum, or product, as the reconstruction."""
    value = lambda r: F.exp(r) if log else F.col(r)
    total = value(roles[0])
    for r in roles[1:]:
        total = total * value(r) if log else total + value(r)
    kept = [c for c in frame.columns if c not in (*roles, "residual", "reconstruction")]
    return frame.select(*kept, *[value(r).alias(r) for r in roles], value("residual").alias("residual"), total.alias("reconstruction"))


def recover_frame(frame: DataFrame, roles: Sequence[str], log: bool = False) -> DataFrame:
    """``recover_components`` with y in the original domain."""
    back = F.exp("y") if log else F.col("y")
    return recover_components(frame.withColumn("y", back), roles, log)
