"""Running aggregates over one long order, without a task that sees all rows.

Rows go to buckets that follow the order: an equal cut of the value's range, then of its logarithm, so that neither a far tail nor
a narrow band of values ends in one bucket (strings: their first bytes). Running aggregates are taken inside buckets; what comes
before a bucket is the aggregate of the buckets before it, a table of a few thousand rows at most for each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PARTS, OCTAVE = 1024, 64
_JOIN = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + b, "max": F.greatest, "min": F.least}
_OVER = {"sum": F.sum, "max": F.max, "min": F.min}


def with_bucket(df: DataFrame, value: str, out: str = "_order_bucket") -> DataFrame:
    """Adds a bucket that never falls as the value rises."""
    if isinstance(df.schema[value].dataType, StringType):
        return df.withColumn(out, F.rpad(F.hex(F.substring(F.col(value).cast("binary"), 1, 4)), 8, "0"))
    v = F.col(value).cast("double")
    ends = df.agg(F.min(v).alias("_order_low"), F.max(v).alias("_order_high"))
    part = F.coalesce(F.floor((v - F.col("_order_low")) / F.nullif(F.col("_order_high") - F.col("_order_low"), F.lit(0.0)) * PARTS), F.lit(0))
    octave = F.floor(F.signum(v) * F.greatest(F.lit(0.0), F.coalesce(F.log2(F.abs(v)), F.lit(-60.0)) + 60) * OCTAVE) + (1 << 19)
    return df.join(F.broadcast(ends), F.lit(True)).withColumn(out, (part * (1 << 20) + octave).cast("long")).drop("_order_low", "_order_high")


def running(df: DataFrame, keys: Sequence[str], value: str, what: dict[str, tuple[str, Column]], more: Sequence[str] = (), descending: bool = False, totals: dict[str, Column] | None = None) -> DataFrame:
    """Adds out = sum, max or min of a column over the group's rows up to this one, by value, then by `more`; and sums over the whole group.

    what: {out: ("sum", column)}. Equal places are ordered arbitrarily, so (value, more) should tell rows apart. Rows without a value are to be left out before.
    """
    totals = totals or {}
    placed = with_bucket(df, value)
    down = (lambda c: F.col(c).desc()) if descending else F.col
    each = placed.groupBy(*keys, "_order_bucket").agg(*(_OVER[how](c).alias(f"_order_in_{n}") for n, (how, c) in what.items()), *(F.sum(c).alias(f"_order_all_{n}") for n, c in totals.items()))
    before = Window.partitionBy(*keys).orderBy(down("_order_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = each.select(
        *(F.col(k).alias(f"_order_k_{k}") for k in keys), F.col("_order_bucket").alias("_order_same"), *(_OVER[how](f"_order_in_{n}").over(before).alias(f"_order_before_{n}") for n, (how, _) in what.items()),
        *(F.sum(f"_order_all_{n}").over(Window.partitionBy(*keys)).alias(n) for n in totals),
    )
    inside = Window.partitionBy(*keys, "_order_bucket").orderBy(down(value), *more).rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumns({n: _OVER[how](c).over(inside) for n, (how, c) in what.items()})
    same = F.col("_order_bucket") == F.col("_order_same")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_order_k_{k}"))
    out = rows.join(ahead, same).withColumns({n: _JOIN[how](F.col(f"_order_before_{n}"), F.col(n)) for n, (how, _) in what.items()})
    return out.select(*df.columns, *what, *totals)
