"""Ordered scans over groups of any size.

A plain window function sends all rows of a key to one task. ``scan`` does so only for keys that
were counted to be small: the count combines before its shuffle. A key with more rows than ``spark.sigspark.maxGroupRows`` is cut into slices,
contiguous ranges of its order column taken from approximate quantiles; each slice is scanned on
its own, one summary row per slice is scanned in slice order, and the summary of the earlier slices
is combined with the local result. Rows that need slicing are written to the shared folder first. Any split points give the same answer, so the approximation
affects balance only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.session import (
    BROADCAST_ROWS_CONF,
    BROADCAST_ROWS_DEFAULT,
    GROUP_ROWS_CONF,
    GROUP_ROWS_DEFAULT,
    int_conf,
    stage,
)


@dataclass(frozen=True)
class Scan:
    """One running value: ``how`` is sum, max, min, last or first (the last two skip nulls).

    ``inclusive`` takes the current row in; ``reverse`` runs from the end of the group.
    """

    how: str
    expr: Column
    inclusive: bool = True
    reverse: bool = False


def running_sum(expr, **kw) -> Scan:
    return Scan("sum", expr, **kw)


def running_max(expr, **kw) -> Scan:
    return Scan("max", expr, **kw)


def running_min(expr, **kw) -> Scan:
    return Scan("min", expr, **kw)


def last_value(expr, **kw) -> Scan:
    return Scan("last", expr, **kw)


def first_value(expr, **kw) -> Scan:
    return Scan("first", expr, **kw)


def row_number() -> Scan:
    return Scan("sum", F.lit(1).cast("bigint"))


def lag(expr) -> Scan:
    """Value of the previous row, null values kept: boxed in a struct so that null is a value."""
    return Scan("last", F.struct(expr.alias("v")), inclusive=False)


def lead(expr) -> Scan:
    return Scan("last", F.struct(expr.alias("v")), inclusive=False, reverse=True)


def _local(scan: Scan, window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, 0 if scan.inclusive else -1)
    if scan.how == "sum":
        return F.sum(scan.expr).over(frame)
    if scan.how == "max":
        return F.max(scan.expr).over(frame)
    if scan.how == "min":
        return F.min(scan.expr).over(frame)
    if scan.how == "last":
        return F.last(scan.expr, ignorenulls=True).over(frame)
    return F.first(scan.expr, ignorenulls=True).over(frame)


def _total(scan: Scan, order: Column) -> Column:
    if scan.how in ("sum", "max", "min"):
        return getattr(F, scan.how)(scan.expr)
    present = F.when(scan.expr.isNotNull(), order)
    latest = (scan.how == "last") != scan.reverse
    return (F.max_by if latest else F.min_by)(scan.expr, present)


def _combine(scan: Scan, carry: Column, local: Column) -> Column:
    if scan.how == "sum":
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    if scan.how == "max":
        return F.greatest(carry, local)
    if scan.how == "min":
        return F.least(carry, local)
    if scan.how == "last":
        return F.coalesce(local, carry)
    return F.coalesce(carry, local)


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> tuple[int, int, DataFrame]:
    """(number of keys above ``limit`` rows, rows of the largest key, the keys above)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n, biggest = counts.agg(F.count_if(F.col("_n") > limit), F.coalesce(F.max("_n"), F.lit(0))).first()
    return n, biggest, counts.where(F.col("_n") > limit).select(*keys)


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    limit = int_conf(df.sparkSession, BROADCAST_ROWS_CONF, BROADCAST_ROWS_DEFAULT)
    return F.broadcast(df) if rows <= limit else df


def _null_safe(left: DataFrame, right: DataFrame, cols: Sequence[str]):
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right["_r_" + c])
    return cond


def join_null_safe(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "left") -> DataFrame:
    renamed = right
    for c in cols:
        renamed = renamed.withColumnRenamed(c, "_r_" + c)
    out = left.join(renamed, _null_safe(left, renamed, cols), how)
    return out.drop(*["_r_" + c for c in cols])


def slice_rows(df: DataFrame, keys: Sequence[str], by: Column, limit: int | None = None, known_max: int | None = None):
    """Add ``_slice``: null for rows of ordinary keys, a number rising with ``by`` for hot ones.

    Returns (df, number of hot keys, slices per hot key). ``by`` must be a number or a time.
    ``known_max`` is a proven bound on the rows of any key, where the caller has one.
    """
    return _slice_rows(df, keys, by, limit, known_max)[:3]


def _slice_rows(df: DataFrame, keys: Sequence[str], by: Column, limit: int | None, known_max: int | None):
    spark = df.sparkSession
    limit = limit or int_conf(spark, GROUP_ROWS_CONF, GROUP_ROWS_DEFAULT)
    small = known_max is not None and known_max <= limit
    n_hot, biggest, hot = (0, known_max, df) if small else hot_keys(df, keys, limit)
    if n_hot == 0:
        return df.withColumn("_slice", F.lit(None).cast("int")), 0, 0, biggest
    df = stage(df, "hot-rows")  # read for the split points, the slice totals and the rows themselves
    n_slices = int(max(2, -(-2 * biggest // limit)))
    probs = [i / n_slices for i in range(1, n_slices)]
    pos = df.withColumn("_pos", by.try_cast("double"))
    hot_rows = join_null_safe(
        pos.select(*keys, "_pos"), _maybe_broadcast(hot, n_hot), keys, "left_semi"
    )
    points = hot_rows.groupBy(*keys).agg(
        F.percentile_approx("_pos", probs, 10 * n_slices).alias("_points")
    )
    points = _maybe_broadcast(points, n_hot * n_slices)
    out = join_null_safe(pos, points, keys)
    at = F.size(F.filter("_points", lambda p: p < F.coalesce(F.col("_pos"), F.lit(float("-inf")))))
    out = out.withColumn("_slice", F.when(F.col("_points").isNotNull(), at))
    return out.drop("_points", "_pos"), n_hot, n_slices, biggest


class Scanner:
    """Several scans over one grouping: counts and slices the groups once.

    ``most`` is the number of rows of the largest key: a bound for later scans of the same rows.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int | None = None, known_max: int | None = None):
        first = F.col(order[0])
        if df.schema[order[0]].dataType.typeName() in ("timestamp_ntz", "date"):
            first = first.cast("timestamp")
        self.keys, self.order = list(keys), list(order)
        self._df, self.n_hot, self.n_slices, self.most = _slice_rows(df, keys, first, limit, known_max)
        self._part = self.keys + (["_slice"] if self.n_hot else [])
        self._changed = False

    def with_column(self, name: str, value: Column) -> Scanner:
        self._df = self._df.withColumn(name, value)
        return self

    def add(self, **values: Scan) -> Scanner:
        """Add running values as columns; ``lag`` and ``lead`` come out unboxed."""
        forward = Window.partitionBy(*self._part).orderBy(*[F.col(c).asc_nulls_first() for c in self.order])
        backward = Window.partitionBy(*self._part).orderBy(*[F.col(c).desc_nulls_last() for c in self.order])
        local = {n: _local(s, backward if s.reverse else forward) for n, s in values.items()}
        if not self.n_hot:
            self._df = self._df.select("*", *[c.alias(n) for n, c in local.items()])
        else:
            self._df = self._sliced(values, local)
        for name in values:
            kind = self._df.schema[name].dataType
            if kind.typeName() == "struct" and kind.fieldNames() == ["v"]:
                self._df = self._df.withColumn(name, F.col(name)["v"])
        return self

    def _sliced(self, values: dict[str, Scan], local: dict[str, Column]) -> DataFrame:
        if self._changed:
            # totals and rows both read it: without a table, each further scan would double the work
            self._df = stage(self._df, "hot-rows")
        self._changed = True
        order = F.struct(*[F.col(c) for c in self.order])
        totals = self._df.where(F.col("_slice").isNotNull()).groupBy(*self._part).agg(
            *[_total(s, order).alias("_t_" + n) for n, s in values.items()]
        )
        slices = Window.partitionBy(*self.keys)
        carried = [
            _local(
                Scan(s.how, F.col("_t_" + n), inclusive=False),
                slices.orderBy(F.col("_slice").desc() if s.reverse else F.col("_slice").asc()),
            ).alias("_c_" + n)
            for n, s in values.items()
        ]
        carry = _maybe_broadcast(totals.select(*self._part, *carried), self.n_hot * self.n_slices)
        out = self._df.select("*", *[c.alias("_l_" + n) for n, c in local.items()])
        out = join_null_safe(out, carry, self._part)
        for n, s in values.items():
            out = out.withColumn(n, _combine(s, F.col("_c_" + n), F.col("_l_" + n)))
        return out.drop(*["_c_" + n for n in values], *["_l_" + n for n in values])

    @property
    def df(self) -> DataFrame:
        return self._df.drop("_slice")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Scan],
    limit: int | None = None,
) -> DataFrame:
    """Add the running ``values`` per ``keys`` in ``order`` (ascending, nulls first).

    ``order`` must be a total order within a key; its first column decides the slices of hot keys,
    so rows equal in that column stay together.
    """
    return Scanner(df, keys, order, limit).add(**values).df


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key, with their ``rank``.

    Spark prunes each map task to ``n`` rows per key before the shuffle (WindowGroupLimit), so a
    hot key never gathers whole in one task. ``n`` is the feature here: a top-k report.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)
