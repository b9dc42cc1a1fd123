"""Ordered scans over groups of any size.

A window keyed on one game or team puts the whole group into one task. The
scans here cut a group into pieces that follow the order, run the window inside
a piece, and bring in what earlier pieces hold from a table with one row per
piece. ``ordered_scan`` cuts every group at segments that the rows name.
``range_scan`` cuts only groups of more rows than a task should hold, into ranges
of about equal length found from a sample of their rows, so that the table of
pieces is bounded and travels by broadcast, and nothing as long as the rows is
joined.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.sources.shared import materialized

#: Rows of a group that one task scans; larger groups are cut into ranges.
RANGE_ROWS = 1 << 20
#: Ranges of one scan at most: beyond that many times ``RANGE_ROWS``, ranges get longer.
MOST_RANGES = 4096
#: Sampled rows per range, which the cuts are chosen from.
SAMPLED = 16
#: Cuts that a row is compared with on each of two levels (a power of two).
FANOUT = 64


def _whole(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _local(kind: str, value: Column, window) -> Column:
    if kind == "count":
        return F.row_number().over(window).cast("long")
    if kind == "first":
        return F.first(value).over(window)
    if kind == "last":
        upto = window.rowsBetween(Window.unboundedPreceding, 0)
        return F.last(value, ignorenulls=True).over(upto)
    if kind == "sum":
        return F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, 0))
    if kind == "max_before":
        return F.max(value).over(window.rangeBetween(Window.unboundedPreceding, -1))
    if kind == "lag":
        return F.lag(value).over(window)
    if kind == "any":
        return F.bool_or(value).over(_whole(window))
    if kind == "is_last":
        return F.lead(F.lit(1)).over(window).isNull()
    raise ValueError(f"unknown scan kind: {kind}")


def _summary(kind: str, value: Column, order: Column) -> Column:
    if kind == "count":
        return F.count(F.lit(1))
    if kind == "first":
        return F.min_by(value, order)
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), order))
    if kind == "sum":
        return F.sum(value)
    if kind == "max_before":
        return F.max(value)
    if kind == "lag":
        return F.max_by(value, order)
    if kind == "any":
        return F.bool_or(value)
    return F.lit(None).cast("boolean") if kind == "is_last" else value


def _carry(kind: str, name: str, window) -> Column:
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    if kind in ("count", "sum"):
        return F.sum(name).over(before)
    if kind == "first":
        return F.first(name).over(before)
    if kind == "last":
        return F.last(name, ignorenulls=True).over(before)
    if kind == "max_before":
        return F.max(name).over(before)
    if kind == "lag":
        return F.lag(name).over(window)
    if kind == "any":
        return F.bool_or(name).over(_whole(window))
    return F.lead(F.lit(True)).over(window)


def _combine(kind: str, local: Column, carry: Column, at_start: Column, later: Column) -> Column:
    if kind == "count":
        return local + F.coalesce(carry, F.lit(0))
    if kind == "first":
        return F.when(later, carry).otherwise(local)
    if kind == "last":
        return F.coalesce(local, carry)
    if kind == "sum":
        return F.coalesce(local + carry, local, carry)
    if kind == "max_before":
        return F.greatest(local, carry)
    if kind == "lag":
        return F.when(at_start, carry).otherwise(local)
    if kind == "any":
        return F.coalesce(carry, local)
    return local & ~F.coalesce(carry, F.lit(False))


def ordered_scan(
    rows: DataFrame,
    keys: list[str],
    segment: list[str],
    order: list[str],
    wanted: dict[str, tuple[str, str | None]],
) -> DataFrame:
    """Add running columns to ``rows``.

    ``segment`` columns must not decrease along ``order`` within ``keys``.
    ``wanted`` maps a new column to (kind, source column); kinds are ``count``
    (1-based position), ``first``, ``last`` (non-null so far, this row
    included), ``max_before`` (strictly smaller position; one order column),
    ``lag``, ``is_last`` and ``any`` (a flag set on any row of the group). Nulls
    in ``keys``, ``segment`` and ``order`` are values of their own and come first;
    rows equal in all of ``order`` may stand either way, so name enough columns.
    """
    # One exchange serves both the windows and the totals of the segments.
    rows = rows.repartition(*keys, *segment)
    window = Window.partitionBy(*keys, *segment).orderBy(*order)
    place = F.struct(*order)

    def source(column):
        return F.lit(None) if column is None else F.col(column)

    local = rows.withColumns(
        {f"__l_{n}": _local(k, source(c), window) for n, (k, c) in wanted.items()}
        | {"__at_start": F.row_number().over(window) == 1}
    )
    across = Window.partitionBy(*keys).orderBy(*segment)
    totals = rows.groupBy(*keys, *segment).agg(
        *[_summary(k, source(c), place).alias(n) for n, (k, c) in wanted.items()]
    )
    carried = (
        totals.select(
            *[F.col(c).alias(f"__k_{c}") for c in (*keys, *segment)],
            (F.row_number().over(across) > 1).alias("__later"),
            F.lead(F.lit(True)).over(across).isNotNull().alias("__more"),
            *[_carry(k, n, across).alias(f"__c_{n}") for n, (k, _) in wanted.items()],
        )
        .filter("__later OR __more")
        .drop("__more")
    )
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in (*keys, *segment)))
    joined = local.join(carried, same, "left")
    return joined.select(
        *rows.columns,
        *[
            _combine(
                k, F.col(f"__l_{n}"), F.col(f"__c_{n}"), F.col("__at_start"), F.col("__later")
            ).alias(n)
            for n, (k, _) in wanted.items()
        ],
    )


def _same(names: list[str], mark: str) -> Column:
    return reduce(and_, (F.col(c).eqNullSafe(F.col(f"{mark}{c}")) for c in names))


def range_cuts(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame | None:
    """Where groups of more than ``most`` rows are cut; None if there is no such group.

    One row per group: its keys under ``__h_`` names, ``cuts`` (ascending orders,
    each the first of a range) and ``coarse`` (every ``FANOUT``-th of them). Rows are
    sampled by a hash of their order, so the cuts depend on the rows alone. The
    first job counts rows per group from the key columns only.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    seen = sizes.agg(F.sum("n").alias("total"), F.max("n").alias("largest")).first()
    if not seen["total"] or seen["largest"] <= most:
        return None
    most = max(most, -(-seen["total"] // MOST_RANGES))
    # At most total / most groups, hence at most MOST_RANGES rows.
    large = sizes.filter(F.col("n") > most).select(*[F.col(c).alias(f"__h_{c}") for c in keys])
    step = max(1, most // SAMPLED)
    sampled = rows.filter(F.pmod(F.xxhash64(*order), F.lit(step)) == 0)
    found = sampled.select(*keys, F.struct(*order).alias("place")).distinct().join(
        F.broadcast(large), _same(keys, "__h_")
    )
    ranked = found.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
    )
    chosen = ranked.filter(F.col("rank") % min(SAMPLED, most) == 0)
    cuts = chosen.groupBy(*[f"__h_{c}" for c in keys]).agg(
        F.array_sort(F.collect_list("place")).alias("cuts")
    )
    coarse = F.filter("cuts", lambda _, i: i % FANOUT == 0)
    return materialized(cuts.withColumn("coarse", coarse), "cuts")


def _range(order: list[str]) -> Column:
    """How many cuts a row's order has reached, from two short lists of them."""
    place = F.struct(*order)
    block = F.size(F.filter("coarse", lambda c: c <= place)) - 1
    near = F.slice("cuts", block * FANOUT + 1, F.lit(FANOUT))
    reached = block * FANOUT + F.size(F.filter(near, lambda c: c <= place))
    return F.when(F.col("cuts").isNull() | (block < 0), F.lit(0)).otherwise(reached)


def range_scan(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    wanted: dict[str, tuple[str, str | None]],
    most: int | None = RANGE_ROWS,
) -> DataFrame:
    """Add running columns to ``rows``, see ``ordered_scan`` for ``wanted`` and nulls.

    There is one more kind: ``sum`` (of all values so far, this row included). Groups
    of up to ``most`` rows are scanned whole. Larger ones are cut into ranges of their
    order, each scanned by itself; what earlier ranges hold comes from one row per
    range, broadcast. Rows equal in all of ``order`` share a range, so name enough
    columns. ``most`` of None says that no group is too large, and spares the count.
    """
    cuts = None if most is None else range_cuts(rows, keys, order, most)
    group = [*keys]
    held = rows
    if cuts is not None:
        joined = rows.join(F.broadcast(cuts), _same(keys, "__h_"), "left")
        held = joined.select(
            *rows.columns, F.col("cuts").isNotNull().alias("__cut"), _range(order).alias("__range")
        )
        group += ["__range"]
        # Rows that are already dealt by key would leave all ranges of a group in one task.
        held = held.repartition(*group)
    window = Window.partitionBy(*group).orderBy(*order)

    def source(column):
        return F.lit(None) if column is None else F.col(column)

    marks = {} if cuts is None else {"__at_start": F.row_number().over(window) == 1}
    local = held.withColumns(
        {f"__l_{n}": _local(k, source(c), window) for n, (k, c) in wanted.items()} | marks
    )
    if cuts is None:
        return local.select(*rows.columns, *[F.col(f"__l_{n}").alias(n) for n in wanted])
    across = Window.partitionBy(*keys).orderBy("__range")
    totals = held.filter("__cut").groupBy(*group).agg(
        *[_summary(k, source(c), F.struct(*order)).alias(n) for n, (k, c) in wanted.items()]
    )
    carried = totals.select(
        *[F.col(c).alias(f"__k_{c}") for c in group],
        (F.row_number().over(across) > 1).alias("__later"),
        *[_carry(k, n, across).alias(f"__c_{n}") for n, (k, _) in wanted.items()],
    )
    out = local.join(F.broadcast(carried), _same(group, "__k_"), "left")
    return out.select(
        *rows.columns,
        *[
            _combine(
                k, F.col(f"__l_{n}"), F.col(f"__c_{n}"), F.col("__at_start"), F.col("__later")
            ).alias(n)
            for n, (k, _) in wanted.items()
        ],
    )
