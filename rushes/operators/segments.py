"""Runs, gaps and segments over ordered observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rushes.operators.ordered import SLICE, ordered_scan, slice_series

_BLOCK = 100_000


def run_segments(
    df: DataFrame,
    keys: Sequence[str] = ("file_id",),
    order: Sequence[str] = ("t", "idx"),
    label: str = "label",
    value: str = "intensity",
    tail: float = 0.2,
    **slicing,
) -> DataFrame:
    """Consecutive equal labels as segments ``[start, end)``; the last one ends ``tail`` after its last row.

    Columns: keys, ``seg`` (0, 1, ...), ``start``, ``end``, label, value (plain mean), ``n_rows``, ``value_sum``.
    """
    t = order[0]
    df = slice_series(df, keys, order, **slicing)
    stepped = ordered_scan(df, keys, order, prev={"_before": label}, nxt={"_next_t": t}, position="_pos")
    changed = (F.col("_pos") > 0) & ~F.col("_before").eqNullSafe(F.col(label))
    numbered = ordered_scan(stepped, keys, order, cum={"seg": changed.cast("long")})
    aggs = [
        F.min(t).alias("start"),
        F.max(F.coalesce("_next_t", F.col(t) + F.lit(tail))).alias("end"),
        F.first(label).alias(label),
        F.avg(value).alias(value),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(value).alias("value_sum"),
    ]
    if SLICE in df.columns:
        aggs.append(F.min(SLICE).alias(SLICE))
    return numbered.groupBy(*keys, "seg").agg(*aggs)


def absorb_short(
    segments: DataFrame,
    keys: Sequence[str] = ("file_id",),
    label: str = "label",
    value: str = "intensity",
    min_len: float = 0.5,
) -> DataFrame:
    """Merge every segment shorter than ``min_len`` into the one before it.

    A merged segment keeps its label unless the absorbed one is at least as long as everything merged so
    far; its value becomes the plain mean of the two at each merge.  The first segment is never absorbed
    and equal neighbours stay apart.

    A merged segment is a long (or first) segment and the short ones that follow it, so the merge needs no
    loop: the repeated mean is a sum with weights 1/2, 1/4, ... counted back from the last member, and the
    label is that of the last member not shorter than the stretch before it.
    """
    order = ["seg"]
    length = F.col("end") - F.col("start")
    opens = (F.col("seg") == 0) | (length >= min_len)
    marked = segments.withColumns(
        {"_own_seg": F.when(opens, F.col("seg")), "_own_start": F.when(opens, F.col("start"))}
    )
    scanned = ordered_scan(
        marked, keys, order,
        ffill={"_was_seg": "_own_seg", "_was_start": "_own_start"},
        bfill={"_next_seg": "_own_seg"},
        total={"_n": F.lit(1).cast("long")},
    )
    head_seg = F.coalesce("_own_seg", "_was_seg")
    head_start = F.coalesce("_own_start", "_was_start")
    behind = F.coalesce("_next_seg", F.col("_n")) - 1 - F.col("seg")
    halvings = behind + F.when(F.col("_own_seg").isNull(), 1).otherwise(0)
    names_it = F.col("_own_seg").isNotNull() | (length >= F.col("start") - head_start)
    rows = scanned.select(
        *keys,
        head_seg.alias("_head"),
        "seg", "start", "end", "n_rows", "value_sum",
        F.when(names_it, F.struct("seg", label)).alias("_label"),
        (F.col(value) * F.pow(F.lit(0.5), halvings)).alias("_share"),
        *([SLICE] if SLICE in segments.columns else []),
    )
    aggs = [
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.max("_label")[label].alias(label),
        F.sum("_share").alias(value),
        F.sum("n_rows").alias("n_rows"),
        F.sum("value_sum").alias("value_sum"),
    ]
    if SLICE in segments.columns:
        aggs.append(F.min(SLICE).alias(SLICE))
    return rows.groupBy(*keys, "_head").agg(*aggs).withColumnRenamed("_head", "seg")


def motion_summary(
    segments: DataFrame,
    keys: Sequence[str] = ("file_id",),
    label: str = "label",
    files: DataFrame | None = None,
    stable_share: float = 0.7,
    stable_mean: float = 2.0,
) -> DataFrame:
    """Primary label, mean intensity over frames, static time and stability per file.

    ``files`` may supply ``duration`` (and files without any frame, which count as static and stable);
    otherwise the duration is the end of the last segment.
    """
    per_label = segments.groupBy(*keys, label).agg(
        F.sum(F.col("end") - F.col("start")).alias("_time"),
        F.min("seg").alias("_first"),
        F.max("end").alias("_end"),
        F.count(F.lit(1)).alias("_segments"),
        F.sum("n_rows").alias("_rows"),
        F.sum("value_sum").alias("_value"),
    )
    moves = ~F.col(label).isin("static", "handheld")
    summary = per_label.groupBy(*keys).agg(
        F.max_by(label, F.struct(F.col("_time"), -F.col("_first"))).alias("primary_label"),
        F.sum(F.when(F.col(label) == "static", F.col("_time")).otherwise(0.0)).alias("static_time"),
        (F.sum("_value") / F.sum("_rows")).alias("mean_intensity"),
        F.max("_end").alias("_last_end"),
        F.sum("_segments").alias("n_segments"),
        F.sum("_rows").alias("n_frames"),
        F.bool_or(moves).alias("has_motion"),
    )
    if files is not None:
        summary = files.select(*keys, "duration").join(summary, list(keys), "left").withColumns(
            {
                "primary_label": F.coalesce("primary_label", F.lit("static")),
                "static_time": F.coalesce("static_time", F.lit(0.0)),
                "n_segments": F.coalesce("n_segments", F.lit(0)),
                "n_frames": F.coalesce("n_frames", F.lit(0)),
                "has_motion": F.coalesce("has_motion", F.lit(False)),
            }
        )
    else:
        summary = summary.withColumn("duration", F.col("_last_end"))
    no_frames = F.col("n_frames") == 0
    stable = (F.col("static_time") > F.col("duration") * stable_share) | (F.col("mean_intensity") < stable_mean)
    return summary.select(
        *keys,
        "duration",
        "primary_label",
        F.coalesce("mean_intensity", F.lit(0.0)).alias("mean_intensity"),
        "static_time",
        F.when(no_frames, F.lit(True)).otherwise(stable).alias("is_stable"),
        "n_segments",
        "n_frames",
        "has_motion",
    )


def true_runs(
    df: DataFrame,
    keys: Sequence[str] = ("file_id",),
    i: str = "i",
    flag: str = "is_speech",
    step: float = 0.03,
    total: DataFrame | None = None,
    **slicing,
) -> DataFrame:
    """Runs of true frames as ``[start, end)`` seconds; a run still open at the end closes at the total.

    Frame numbers count from 0 without holes.  ``total`` may give ``total_duration`` per key; the default is
    the number of frames times ``step``.
    """
    df = slice_series(df, keys, i, **slicing)
    stepped = ordered_scan(
        df, keys, [i], prev={"_before": flag}, nxt={"_after": flag}, total={"_n": F.lit(1).cast("long")}
    )
    opens = F.col(flag) & ~F.coalesce("_before", F.lit(False))
    numbered = ordered_scan(stepped, keys, [i], cum={"run": opens.cast("long")})
    runs = (
        numbered.filter(flag)
        .groupBy(*keys, "run")
        .agg(F.min(i).alias("_from"), F.max(i).alias("_to"), F.max("_n").alias("_n"))
    )
    if total is not None:
        runs = runs.join(total.select(*keys, "total_duration"), list(keys), "left")
    else:
        runs = runs.withColumn("total_duration", F.col("_n") * step)
    closed = F.col("_to") + 1 < F.col("_n")
    return runs.select(
        *keys,
        (F.col("run") - 1).alias("run"),
        (F.col("_from") * step).alias("start"),
        F.when(closed, (F.col("_to") + 1) * step).otherwise(F.col("total_duration")).alias("end"),
    )


def drop_consecutive(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], **slicing
) -> DataFrame:
    """Drop a row whose ``cols`` all equal those of the row before it (filter invalid rows first)."""
    df = slice_series(df, keys, order, **slicing)
    packed = df.withColumn("_cols", F.struct(*cols))
    stepped = ordered_scan(packed, keys, order, prev={"_was": "_cols"}, position="_pos")
    kept = stepped.filter((F.col("_pos") == 0) | ~F.col("_was").eqNullSafe(F.col("_cols")))
    return kept.drop("_cols", "_was", "_pos")


def continuity_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: str = "start",
    duration: str = "duration",
    tol: float = 1.0,
    **slicing,
) -> DataFrame:
    """Number recordings: a clip continues the one before it when it starts within ``tol`` of its end."""
    df = slice_series(df, keys, order, **slicing)
    with_end = df.withColumn("_stop", F.col(start) + F.col(duration))
    stepped = ordered_scan(with_end, keys, order, prev={"_prev_stop": "_stop"})
    opens = F.col("_prev_stop").isNotNull() & (F.abs(F.col(start) - F.col("_prev_stop")) >= tol)
    return ordered_scan(stepped, keys, order, cum={"recording": opens.cast("long")}).drop("_stop", "_prev_stop")


def successive_gap(df: DataFrame, keys: Sequence[str], order: Sequence[str], **slicing) -> DataFrame:
    """Time to the next row of the series; the last row has none and is left out."""
    t = order[0]
    df = slice_series(df, keys, order, **slicing)
    stepped = ordered_scan(df, keys, order, nxt={"_next": t})
    return stepped.filter(F.col("_next").isNotNull()).withColumn("gap", F.col("_next") - F.col(t)).drop("_next")


def rolling_last_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int = 20, **slicing
) -> DataFrame:
    """Mean of the last ``n`` values up to each row, as ``rolling_mean``.

    A series cut into slices is regrouped into blocks of rows that overlap by ``n - 1``.
    """
    df = slice_series(df, keys, order, **slicing)
    if SLICE not in df.columns:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
        return df.withColumn("rolling_mean", F.avg(value).over(w))
    numbered = ordered_scan(df, keys, order, position="_pos")
    # Blocks of rows; the last n - 1 rows of a block also serve the start of the next one.
    block = F.col("_pos") - F.col("_pos") % _BLOCK
    serves_next = F.col("_pos") + n > block + _BLOCK
    blocks = F.when(serves_next, F.array(block, block + _BLOCK)).otherwise(F.array(block))
    copies = numbered.withColumn("_block", F.explode(blocks))
    w = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(-(n - 1), 0)
    out = copies.withColumn("rolling_mean", F.avg(value).over(w))
    return out.filter(F.col("_pos") >= F.col("_block")).drop("_pos", "_block")


def batch_rows(
    df: DataFrame,
    keys: Sequence[str] = ("file_id",),
    order: Sequence[str] = ("t",),
    k: int = 3,
    overlap: bool = False,
    **slicing,
) -> DataFrame:
    """Frame batches of ``k`` rows, stepping ``k`` or (with overlap) ``k - 1``.

    With overlap a batch of one frame is dropped unless it is the only batch.  One row per batch and frame:
    keys, ``batch``, ``pos`` (0, 1, ...), ``batch_t`` (time of the middle frame) and the frame's columns.
    """
    t = order[0]
    step = max(1, k - 1) if overlap else k
    df = slice_series(df, keys, order, **slicing)
    rows = ordered_scan(df, keys, order, total={"_n": F.lit(1).cast("long")}, position="_i")
    # Row i is in every batch b with b * step <= i < b * step + k.
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - (k - 1)) / F.lit(step)))
    last = F.floor(F.col("_i") / F.lit(step))
    rows = rows.withColumn("batch", F.explode(F.sequence(first, last)))
    size = F.least(F.lit(k), F.col("_n") - F.col("batch") * step)
    rows = rows.withColumns({"_size": size, "pos": F.col("_i") - F.col("batch") * step})
    if overlap:
        rows = rows.filter((F.col("_size") >= 2) | (F.col("batch") == 0))
    middle = F.floor(F.col("_size") / 2)
    # Batches have at most k rows, so this window is never larger than that.
    w = Window.partitionBy(*keys, "batch")
    rows = rows.withColumn("batch_t", F.max(F.when(F.col("pos") == middle, F.col(t))).over(w))
    return rows.withColumnRenamed("_size", "batch_size").drop("_n", "_i")


def previous_text(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, name: str = "previous", **slicing
) -> DataFrame:
    """The last non-null ``col`` strictly before each row."""
    df = slice_series(df, keys, order, **slicing)
    return ordered_scan(df, keys, order, ffill={name: col})


def position_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], **slicing) -> DataFrame:
    """``file_index`` from 0 and ``is_continuation``."""
    df = slice_series(df, keys, order, **slicing)
    out = ordered_scan(df, keys, order, position="file_index")
    return out.withColumn("is_continuation", F.col("file_index") > 0)


def first_seen(
    df: DataFrame,
    keys: Sequence[str] = ("file_id",),
    text: str = "text",
    order: Sequence[str] = ("t", "idx"),
    min_confidence: float | None = None,
) -> DataFrame:
    """First row per series and normalised text (``lower(trim)``).

    An aggregate with map-side combine, so a text repeated a billion times is one row per task before the
    shuffle.
    """
    if min_confidence is not None:
        df = df.filter(F.col("confidence") >= min_confidence)
    key = F.lower(F.trim(F.col(text)))
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    picked = df.groupBy(*keys, key.alias("text_key")).agg(best.alias("_row"))
    return picked.select(*keys, "text_key", "_row.*")


def scenes_from_scores(
    df: DataFrame,
    keys: Sequence[str] = ("file_id",),
    t: str = "t",
    score: str = "score",
    thr: float = 27.0,
    durations: DataFrame | None = None,
    **slicing,
) -> DataFrame:
    """Contiguous scenes from 0, cut at every frame whose content score reaches ``thr``.

    The last scene ends at ``duration`` from ``durations``, or at the last frame.
    """
    df = slice_series(df.select(*keys, t, score), keys, t, **slicing)
    stepped = ordered_scan(df, keys, [t], position="_pos")
    cut = (F.col("_pos") > 0) & (F.col(score) >= thr)
    stepped = ordered_scan(stepped, keys, [t], cum={"scene": cut.cast("long")}, nxt={"_next": t})
    scenes = stepped.groupBy(*keys, "scene").agg(
        F.min(t).alias("_from"), F.max(F.coalesce("_next", t)).alias("_to"), F.max(t).alias("_last"),
        F.max(F.col("_next").isNull()).alias("_final"),
    )
    start = F.when(F.col("scene") == 0, F.lit(0.0)).otherwise(F.col("_from"))
    end = F.col("_to")
    if durations is not None:
        scenes = scenes.join(durations.select(*keys, "duration"), list(keys), "left")
        end = F.when(F.col("_final"), F.coalesce("duration", "_to")).otherwise(F.col("_to"))
    return scenes.select(
        *keys, "scene", start.alias("start"), end.alias("end"), F.round(end - start, 3).alias("duration")
    )


def first_valid(df: DataFrame, keys: Sequence[str], order: Sequence[str], cond: Column | None = None) -> DataFrame:
    """The first row per series that meets ``cond`` (partial aggregation, no sort)."""
    if cond is not None:
        df = df.filter(cond)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def frame_index(
    df: DataFrame, keys: Sequence[str], t: str = "t", ok: Column | None = None, **slicing
) -> DataFrame:
    """Position among the file's sorted timestamps; rows failing ``ok`` leave a hole in the numbering."""
    df = slice_series(df, keys, t, **slicing)
    out = ordered_scan(df, keys, [t], position="frame_index")
    return out.filter(ok) if ok is not None else out
