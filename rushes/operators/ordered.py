"""Ordered work inside a series (a file, a batch, a recording) that stays parallel when one series is huge.

``partitionBy(file)`` puts a whole file in one task.  That is right for ordinary files and wrong for one
that holds a third of the table, so a series above ``rows_per_slice`` rows is cut into slices first:
windows run per slice, one summary row per slice is scanned in order, and its result is carried back into
the slice.  Slices are cut by rank in the whole order, so bursts, equal times and text orders give slices of
about equal rows.  When no series is that large, the plan is an ordinary window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rushes.session import checkpoint_dir

SLICE = "_slice"
# Slice number of a series that was not cut.
WHOLE = -1
ROWS_PER_SLICE = 1_000_000
# Sampled rows from which the bounds of one slice are drawn.
SAMPLES_PER_SLICE = 100
# Bounds up to this number are broadcast; beyond it the join is left to adaptive execution.
BROADCAST_BOUNDS = 1_000_000


def slice_series(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], rows_per_slice: int | None = ROWS_PER_SLICE
) -> DataFrame:
    """Add ``_slice`` when some series has more than ``rows_per_slice`` rows; otherwise return ``df`` as it is.

    ``None`` skips the check, for series that are short by nature.  ``order`` may be of any sortable types; rows
    that are equal in all of it stay in one slice.

    The bounds of the slices are drawn from a sample of the long series, chosen by hash and kept in the
    checkpoint folder, so a recomputed task assigns the same slices.
    """
    if SLICE in df.columns or rows_per_slice is None:
        return df
    order = [order] if isinstance(order, str) else list(order)
    long_series = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_slice).select(*keys)
    if long_series.isEmpty():
        return df
    checkpoint_dir(df.sparkSession)
    step = max(1, rows_per_slice // SAMPLES_PER_SLICE)
    at = F.struct(*[F.col(c) for c in order])
    sampled = df.select(*keys, *[c for c in order if c not in keys]).join(long_series, list(keys), "left_semi")
    sampled = sampled.filter(F.pmod(F.xxhash64(*keys, *order), F.lit(step)) == 0)
    # A sample of a series is a fixed share of it; it is ranked by slices of its own size.
    ranked = sampled.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    bounds = (
        ranked.filter(F.col("_r") % max(1, rows_per_slice // step) == 0).groupBy(*keys)
        .agg(F.sort_array(F.collect_set(at)).alias("_bounds")).checkpoint()
    )
    total = bounds.agg(F.sum(F.size("_bounds"))).first()[0] or 0
    few = F.broadcast(bounds) if total <= BROADCAST_BOUNDS else bounds
    number = F.size(F.filter("_bounds", lambda b: b < at))
    return (
        df.join(few, list(keys), "left")
        .withColumn(SLICE, F.when(F.col("_bounds").isNull(), F.lit(WHOLE)).otherwise(number).cast("int"))
        .select(*df.columns, SLICE)
    )


def parts(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """Columns to partition by: the series, and its slice where one was assigned."""
    return [*keys, SLICE] if SLICE in df.columns else list(keys)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    prev: Mapping[str, str] | None = None,
    nxt: Mapping[str, str] | None = None,
    cum: Mapping[str, Column] | None = None,
    ffill: Mapping[str, str] | None = None,
    bfill: Mapping[str, str] | None = None,
    total: Mapping[str, Column] | None = None,
    position: str | None = None,
) -> DataFrame:
    """Lag, lead, running sum, previous/next non-null value, series total and row position per series.

    ``order`` must be unique within a series and be the order the slices were cut on, or begin with it.
    ``prev``/``nxt`` map a new column to the column read one row earlier/later; ``cum`` maps a new
    column to an expression summed up to and including the row; ``ffill``/``bfill`` take the nearest
    non-null value strictly before/after the row; ``total`` sums an expression over the whole series;
    ``position`` counts rows from 0.
    """
    prev, nxt, cum, total = dict(prev or {}), dict(nxt or {}), dict(cum or {}), dict(total or {})
    ffill, bfill = dict(ffill or {}), dict(bfill or {})
    if position:
        cum[position] = F.lit(1).cast("long")

    cols = parts(df, keys)
    w = Window.partitionBy(*cols).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(1, Window.unboundedFollowing)

    out = {}
    for name, col in prev.items():
        out[name] = F.lag(F.struct(F.col(col).alias("v"))).over(w)
    for name, col in nxt.items():
        out[name] = F.lead(F.struct(F.col(col).alias("v"))).over(w)
    for name, expr in cum.items():
        out[name] = F.sum(expr).over(upto)
    for name, col in ffill.items():
        out[name] = F.last(col, ignorenulls=True).over(before)
    for name, col in bfill.items():
        out[name] = F.first(col, ignorenulls=True).over(after)
    whole = Window.partitionBy(*cols)
    for name, expr in total.items():
        out[name] = F.sum(expr).over(whole)
    local = df.select("*", *[c.alias(n) for n, c in out.items()])

    if SLICE not in df.columns:
        fixed = {n: F.col(n)["v"] for n in [*prev, *nxt]}
        return _finish(local, fixed, position)

    at = F.struct(*[F.col(c) for c in order])
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.max_by(F.struct(F.col(c).alias("v")), at).alias(f"_c_{n}") for n, c in prev.items()]
    aggs += [F.min_by(F.struct(F.col(c).alias("v")), at).alias(f"_c_{n}") for n, c in nxt.items()]
    aggs += [F.sum(e).alias(f"_c_{n}") for n, e in [*cum.items(), *total.items()]]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_c_{n}") for n, c in ffill.items()]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_c_{n}") for n, c in bfill.items()]
    # Only series that were cut have anything to carry.
    summary = df.filter(F.col(SLICE) > WHOLE).groupBy(*cols).agg(*aggs)

    ws = Window.partitionBy(*keys).orderBy(SLICE)
    s_before = ws.rowsBetween(Window.unboundedPreceding, -1)
    s_after = ws.rowsBetween(1, Window.unboundedFollowing)
    carried = {}
    carried |= {n: F.lag(f"_c_{n}").over(ws) for n in prev}
    carried |= {n: F.lead(f"_c_{n}").over(ws) for n in nxt}
    carried |= {n: F.sum(f"_c_{n}").over(s_before) for n in cum}
    everything = Window.partitionBy(*keys)
    carried |= {n: F.sum(f"_c_{n}").over(everything) for n in total}
    carried |= {n: F.last(f"_c_{n}", ignorenulls=True).over(s_before) for n in ffill}
    carried |= {n: F.first(f"_c_{n}", ignorenulls=True).over(s_after) for n in bfill}
    summary = summary.select(*cols, *[c.alias(f"_k_{n}") for n, c in carried.items()])

    # Both sides are dealt by series and slice already, so the carried rows join without another shuffle.
    joined = local.join(summary, cols, "left")
    fixed = {n: F.coalesce(F.col(n), F.col(f"_k_{n}"))["v"] for n in [*prev, *nxt]}
    fixed |= {n: F.col(n) + F.coalesce(F.col(f"_k_{n}"), F.lit(0)) for n in cum}
    fixed |= {n: F.coalesce(F.col(n), F.col(f"_k_{n}")) for n in [*ffill, *bfill]}
    fixed |= {n: F.coalesce(F.col(f"_k_{n}"), F.col(n)) for n in total}
    joined = joined.select(*df.columns, *[fixed[n].alias(n) for n in out])
    return _finish(joined, {}, position)


def _finish(df: DataFrame, fixed: dict[str, Column], position: str | None) -> DataFrame:
    if position:
        fixed = {**fixed, position: F.col(position) - 1}
    return df.withColumns(fixed) if fixed else df


def drop_slice(df: DataFrame) -> DataFrame:
    return df.drop(SLICE)
