"""Column helpers that carry the pandas NULL semantics over to Spark.

* ``not_blocked``: ``severity != 'BLOQUANT'`` must keep NULL severities (a clean
  row has NULL severity), so it is a null-safe negation.
* ``nan_to_null``: pandas skips NaN in means; Spark does not. Convert once.
* ``safe_div``: pandas divides by zero silently; Spark ANSI raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oeeforge import schema as S


def blocked(col: str = "quality_severity") -> Column:
    return F.col(col).eqNullSafe(F.lit(S.SEVERITY_BLOQUANT))


def not_blocked(col: str = "quality_severity") -> Column:
    return ~blocked(col)


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def safe_div(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


#: Units (powers of two) of the limbs of ``exact_sum``, and the width of a limb in bits.
LIMB_UNITS = (24, 0, -24, -48, -72, -96)
LIMB_BITS = 24
#: From this size on a value has no place in the first limb.
LIMB_LIMIT = 2.0 ** 47


def exact_limbs(x: Column) -> list[Column]:
    """The value as whole multiples of the limb units, each small enough that sums of 2**39 of them fit a BIGINT.

    Rounding to a unit and taking away what a coarser unit already holds are exact in doubles, so the limbs times their
    units add up to the value rounded to a multiple of 2**-96: to the value itself from 6e-14 in size on.
    """
    at = lambda unit: F.rint(x * F.lit(2.0 ** -unit))
    own = [at(LIMB_UNITS[0])]
    own += [at(u) - at(u + LIMB_BITS) * F.lit(2.0 ** LIMB_BITS) for u in LIMB_UNITS[1:]]
    return [F.when(F.abs(x) < F.lit(LIMB_LIMIT), limb.cast("long")) for limb in own]


def exact_sum(c: Column | str) -> Column:
    """Sum of doubles that does not depend on the order of addition (an aggregate expression; NULL without values).

    A plain DOUBLE sum depends on the order in which tasks add up. Here each value is split without error into limbs
    at fixed binary places, the limbs are summed as integers (exact, in any order, with map-side combine), and
    the few totals are put together in one fixed order. So the result is the same bits on any cluster layout, on a rerun
    after an executor loss, and in any engine that runs the same expression. Groups with a value of 2**47 or more in size
    are summed as plain doubles.
    """
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    totals = [F.sum(limb).cast("double") * F.lit(2.0 ** u) for limb, u in zip(exact_limbs(x), LIMB_UNITS)]
    whole = totals[-1]
    for t in reversed(totals[:-1]):  # smallest first
        whole = whole + t
    return F.when(F.max(F.abs(x)) < F.lit(LIMB_LIMIT), whole).otherwise(F.sum(x))


def exact_mean(c: Column | str) -> Column:
    """Mean from ``exact_sum``, as DOUBLE. NULL when the column has no non-NULL value."""
    col = F.col(c) if isinstance(c, str) else c
    return F.try_divide(exact_sum(col), F.count(col).cast("double"))


def round_half_up(c: Column, scale: int = 4) -> Column:
    """``floor(x * 10^s + 0.5) / 10^s`` in IEEE arithmetic (same bits in any engine)."""
    k = float(10 ** scale)
    return F.floor(c * F.lit(k) + F.lit(0.5)).cast("double") / F.lit(k)


def round_doubles(df: DataFrame, scale: int = 4) -> DataFrame:
    """Round every DOUBLE column; used for engine-independent comparison only."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            cols.append(round_half_up(F.col(f.name), scale).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def severity_rank(sev: Column) -> Column:
    expr = F.lit(None).cast("int")
    for name, rank in S.SEVERITY_RANK.items():
        expr = F.when(sev == F.lit(name), F.lit(rank)).otherwise(expr)
    return expr


def severity_of_rank(rank: Column) -> Column:
    expr = F.lit(None).cast("string")
    for name, r in S.SEVERITY_RANK.items():
        expr = F.when(rank == F.lit(r), F.lit(name)).otherwise(expr)
    return expr


def non_null_array(*items: Column) -> Column:
    """Array of the non-NULL items (one expression, no explode)."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())
