"""Sampling, thinning, top-k and set operations on timestamps and rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rushes.operators.ordered import SLICE, WHOLE, ordered_scan, parts, slice_series

_ENTRY = "_entry"


def _next_kept(times: np.ndarray, start: int, last: float, interval: float) -> int:
    """First position from ``start`` whose time is at least ``interval`` after ``last``."""
    at = start + int(np.searchsorted(times[start:], last + interval, side="left"))
    while at > start and times[at - 1] - last >= interval:
        at -= 1
    while at < len(times) and times[at] - last < interval:
        at += 1
    return at


def _greedy(keys: list[str], t: str, interval: float):
    """Mask rows of Arrow batches sorted by keys and time; only the last kept time crosses batches."""

    def run(batches):
        current, last = None, -np.inf
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            new = np.zeros(n, dtype=bool)
            for name in keys:
                col = batch.column(name)
                if n > 1:
                    new[1:] |= pc.fill_null(pc.not_equal(col[1:], col[:-1]), False).to_numpy(zero_copy_only=False)
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            new[0] = first != current
            current = tuple(batch.column(k)[n - 1].as_py() for k in keys)
            times = batch.column(t).cast(pa.float64()).to_numpy(zero_copy_only=False)
            entries = batch.column(_ENTRY).to_numpy(zero_copy_only=False) if _ENTRY in batch.schema.names else None
            keep = np.zeros(n, dtype=bool)
            bounds = [0, *(np.flatnonzero(new[1:]) + 1), n]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if new[lo]:
                    last = -np.inf
                    if entries is not None and not np.isnan(entries[lo]):
                        last = entries[lo]
                run_times = times[lo:hi]
                at = _next_kept(run_times, 0, last, interval)
                while at < hi - lo:
                    keep[lo + at] = True
                    last = run_times[at]
                    at = _next_kept(run_times, at + 1, last, interval)
            yield batch.filter(pa.array(keep))

    return run


def _exits(keys: list[str], t: str, interval: float):
    """For one slice: the last time it would keep, for each range of possible first kept times."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.unique(pdf[t].to_numpy(dtype="float64"))
        n = len(times)
        nxt = np.searchsorted(times, times + interval, side="left")
        for i in range(n):
            j = nxt[i]
            while j > i + 1 and times[j - 1] - times[i] >= interval:
                j -= 1
            while j < n and times[j] - times[i] < interval:
                j += 1
            nxt[i] = j
        ends = np.empty(n)
        for i in range(n - 1, -1, -1):
            ends[i] = times[i] if nxt[i] >= n else ends[nxt[i]]
        starts = min(n, int(nxt[0]) + 1)
        # Neighbouring first times that leave off at the same time are one row, named by the last of them.
        last_of_run = np.append(ends[1:starts] != ends[: starts - 1], True)
        frame = pd.DataFrame({"_cand": times[:starts][last_of_run], "_exit": ends[:starts][last_of_run]})
        for k in [*keys, SLICE]:
            frame[k] = pdf[k].iloc[0]
        return frame[[*keys, SLICE, "_cand", "_exit"]]

    return run


def _entries(keys: list[str], interval: float):
    """Walk the slices of one series in order and record the last time kept before each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([SLICE, "_cand"])
        last, rows = -np.inf, []
        for number, part in pdf.groupby(SLICE, sort=True):
            rows.append((number, None if np.isinf(last) else last))
            cand, leave = part["_cand"].to_numpy(), part["_exit"].to_numpy()
            ok = np.flatnonzero(cand - last >= interval)
            if len(ok):
                last = leave[ok[0]]
        out = pd.DataFrame(rows, columns=[SLICE, _ENTRY])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, SLICE, _ENTRY]]

    return run


def sample_every(
    df: DataFrame,
    keys: Sequence[str] = ("file_id",),
    t: str = "t",
    interval: float = 1.0,
    order: Sequence[str] | None = None,
    valid: Column | None = None,
    **slicing,
) -> DataFrame:
    """Greedy sampling: keep a row when it is at least ``interval`` after the last kept one.

    ``valid`` is applied after the sampling, so an invalid row still uses up its slot.

    Rows are sorted inside their partition and stream through one pass that carries the last kept time.  A
    series cut into slices is solved exactly in parallel: each slice reports where it would leave off for
    every way to enter it, the entries are chained over the slices, and the slices are then filtered.
    """
    keys = list(keys)
    order = list(order or [t])
    df = slice_series(df, keys, t, **slicing)
    columns = df.columns
    by = parts(df, keys)
    if SLICE in columns:
        types = {f.name: f.dataType for f in df.schema.fields}
        head = [T.StructField(k, types[k]) for k in [*keys, SLICE]]
        exits = (
            df.filter(F.col(SLICE) > WHOLE)
            .select(*by, F.col(t).cast("double").alias(t))
            .groupBy(*by)
            .applyInPandas(
                _exits(keys, t, interval),
                T.StructType([*head, T.StructField("_cand", T.DoubleType()), T.StructField("_exit", T.DoubleType())]),
            )
        )
        entries = exits.groupBy(*keys).applyInPandas(
            _entries(keys, interval), T.StructType([*head, T.StructField(_ENTRY, T.DoubleType())])
        )
        # On the keys by which the rows are dealt out next, so that the join costs no shuffle of its own.
        df = df.join(entries, by, "left")
    placed = df.repartition(*by).sortWithinPartitions(*by, *order)
    kept = placed.mapInArrow(_greedy(by, t, interval), placed.schema)
    kept = kept.select(*columns)
    return kept.filter(valid) if valid is not None else kept


def union_times(*dfs: DataFrame, keys: Sequence[str] = ("file_id",), t: str = "t") -> DataFrame:
    """Distinct union of timestamp sets."""
    return reduce(DataFrame.union, [d.select(*keys, t) for d in dfs]).distinct()


def merge_times(
    *dfs: DataFrame, keys: Sequence[str] = ("file_id",), t: str = "t", min_gap: float = 0.3, **slicing
) -> DataFrame:
    """Distinct union of timestamp sets without near duplicates: keep one at least ``min_gap`` after the last kept."""
    return sample_every(union_times(*dfs, keys=keys, t=t), keys, t, min_gap, **slicing)


def sort_by_time(df: DataFrame, keys: Sequence[str] = ("file_id",), order: Sequence[str] = ("t", "idx")) -> DataFrame:
    return df.orderBy(*keys, *order)


def limit_per_file(
    df: DataFrame, n: int, keys: Sequence[str] = ("file_id",), order: Sequence[str] = ("t", "idx"), **slicing
) -> DataFrame:
    """The first ``n`` rows of every series."""
    df = slice_series(df, keys, order, **slicing)
    # A rank is pruned to n rows in each task before the shuffle; the cut series first drop to n rows a slice.
    local = Window.partitionBy(*parts(df, keys)).orderBy(*order)
    first = df.withColumn("_rank", F.row_number().over(local)).filter(F.col("_rank") <= n).drop("_rank")
    if SLICE not in df.columns:
        return first
    return ordered_scan(first, keys, order, position="_pos").filter(F.col("_pos") < n).drop("_pos")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The ``k`` best rows, overall or per key, ranked from 1 in ``rank``.

    Per key the window keeps ``rank <= k``, which Spark also applies before its shuffle
    (``WindowGroupLimit``), so a large group sends at most ``k`` rows from each task.
    """
    if not keys:
        best = df.orderBy(*order).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn(
        "rank", F.col("rank").cast("long")
    )


def smallest_files(files: DataFrame, max_mb: float = 100.0, n: int = 10) -> DataFrame:
    """The ``n`` smallest files of at most ``max_mb`` megabytes, smallest first."""
    return files.filter(F.col("size") <= max_mb * 1024 * 1024).orderBy("size", "file_id").limit(n)


def merge_keep_existing(existing: DataFrame, added: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of two keyed sets; on a clash the existing row stays."""
    return existing.unionByName(added.join(existing.select(*keys), list(keys), "left_anti"))


def new_times(wanted: DataFrame, present: DataFrame, keys: Sequence[str] = ("file_id", "t")) -> DataFrame:
    """Timestamps that are not yet present (exact match)."""
    return wanted.join(present.select(*keys), list(keys), "left_anti")


def drop_expired(df: DataFrame, now: Column, ttl: float = 3600.0) -> DataFrame:
    """Remove finished runs older than ``ttl`` seconds; ``completed_at`` and ``now`` are epoch seconds."""
    finished = F.col("status").isin("completed", "failed")
    expired = finished & F.col("completed_at").isNotNull() & (now - F.col("completed_at") > ttl)
    return df.filter(~F.coalesce(expired, F.lit(False)))


def label_times(det: DataFrame, label: str = "person", keys: Sequence[str] = ("file_id",), t: str = "t") -> DataFrame:
    """Distinct timestamps at which a label was seen."""
    return det.filter(F.col("label") == label).select(*keys, t).distinct()
