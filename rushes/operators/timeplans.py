"""Timestamp generators: which moments of a file to look at.

Every function returns one row per planned timestamp: keys, ``sample_no`` (0, 1, ...) and ``t``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushes.functions.arrays import uniform_times
from rushes.functions.media import face_fps
from rushes.operators.ordered import ordered_scan


def _emit(df: DataFrame, keys: Sequence[str], times: Column) -> DataFrame:
    return df.select(*keys, F.posexplode(times).alias("_no", "t")).select(
        *keys, F.col("_no").cast("long").alias("sample_no"), "t"
    )


def _clamp(t: Column, duration: Column) -> Column:
    return F.greatest(F.lit(0.1), F.least(t, duration - 0.1))


def _numbered(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct samples with position and count per file.

    A plan has at most a few samples per second of file, so its window stays small even for a file whose
    observations had to be sliced.
    """
    distinct = samples.groupBy(*keys, "t").agg(
        F.first("duration").alias("duration"), F.first("_settled").alias("_settled")
    )
    return ordered_scan(distinct, keys, ["t"], total={"_n": F.lit(1).cast("long")}, position="_pos")


def _no_times() -> Column:
    return F.array().cast("array<double>")


def adaptive_plan(
    summary: DataFrame,
    segments: DataFrame,
    keys: Sequence[str] = ("file_id",),
    cap: int = 100,
    value: str = "intensity",
) -> DataFrame:
    """Sampling plan by stability and, for moving footage, by the intensity of each segment.

    ``summary`` is what ``motion_summary`` returns; ``segments`` has ``start``, ``end`` and the intensity.
    """
    d = F.col("duration")
    still = F.when(d < 10, F.array(d / 2)).otherwise(F.array(d * 0.15, d * 0.5, d * 0.85))
    few = F.least(F.lit(5), F.greatest(F.lit(1), (d / 10).cast("int")))
    calm = F.when(few == 1, F.array(d / 2)).otherwise(uniform_times(d, few))
    # Every two seconds of the whole file; beyond ``cap`` samples are thinned evenly below.
    grid = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(d / 2)).cast("int")), lambda i: F.lit(0.1) + i * 2.0)
    settled = F.when(
        F.col("is_stable"), F.when(F.col("mean_intensity") < 1.0, still).otherwise(calm)
    ).when(F.col("n_segments") == 0, F.filter(grid, lambda x: x < d - 0.1))

    ordered = ordered_scan(segments, keys, ["start", "end"], prev={"_prev_start": "start"})
    ordered = ordered.select(*keys, "start", "end", value, "_prev_start")
    files = summary.select(*keys, "duration", settled.alias("_fixed"))
    rows = files.join(ordered.withColumn("_seg", F.lit(True)), list(keys), "left")
    v = F.col(value)
    every = F.when(v < 0.5, 10.0).when(v < 2.0, 4.0).when(v < 4.0, 2.0).when(v < 6.0, 1.0).otherwise(0.5)
    begin, stop = F.col("start") + 0.1, F.col("end") - 0.1
    count = F.greatest(F.ceil((stop - begin) / every), F.lit(0)).cast("int")
    inside = F.filter(
        F.transform(F.sequence(F.lit(0), count), lambda i: begin + i * every), lambda x: x < stop
    )
    # A segment too short for a sample gets its middle, unless a point segment just before it sits on its start.
    covered = F.coalesce(F.col("_prev_start") == F.col("start"), F.lit(False))
    middle = F.when(covered, _no_times()).otherwise(F.array((F.col("start") + F.col("end")) / 2))
    rows = rows.withColumn("_inside", F.when(F.col("_seg") & F.col("_fixed").isNull(), inside))
    times = F.coalesce("_fixed", F.when(F.size("_inside") > 0, F.col("_inside")).otherwise(middle))
    samples = rows.select(*keys, "duration", F.col("_fixed").isNotNull().alias("_settled"), F.explode(times).alias("t"))
    numbered = _numbered(samples, keys)
    # Over the cap, sample i of cap is the one at position floor(i * (n / cap)).
    step = F.col("_n").cast("double") / cap
    guess = F.ceil(F.col("_pos") / step)
    pick = F.lit(None).cast("long")
    for near in (1, 0, -1):
        i = guess + near
        pick = F.when((i >= 0) & (i < cap) & (F.floor(i * step) == F.col("_pos")), i.cast("long")).otherwise(pick)
    return _picked(numbered, keys, F.when(F.col("_n") <= cap, F.col("_pos")).otherwise(pick))


def _picked(numbered: DataFrame, keys: Sequence[str], number: Column) -> DataFrame:
    """Keep numbered samples; those taken from segments are moved inside the file."""
    t = F.when(F.col("_settled"), F.col("t")).otherwise(_clamp(F.col("t"), F.col("duration")))
    return (
        numbered.withColumn("sample_no", number.cast("long"))
        .filter(F.col("sample_no") >= 0)
        .select(*keys, "sample_no", t.alias("t"))
    )


def keypoint_plan(
    summary: DataFrame,
    segments: DataFrame,
    keys: Sequence[str] = ("file_id",),
    cap: int = 5,
    label: str = "label",
) -> DataFrame:
    """At most ``cap`` moments per file: middles of quiet segments, both ends of pans, tilts and zooms."""
    d = F.col("duration")
    travels = F.col(label).isin("pan_left", "pan_right", "tilt_up", "tilt_down", "push_in", "pull_out")
    quiet = F.col("is_stable") | (F.col("primary_label") == "static")
    spread = F.transform(F.sequence(F.lit(1), F.lit(cap)), lambda i: d * i / (cap + 1))
    settled = F.when(
        F.col("n_segments") == 0, F.when(quiet, F.array(d / 2)).otherwise(spread)
    ).when(~F.col("has_motion") & F.col("is_stable"), F.array(d / 2))

    files = summary.select(*keys, "duration", settled.alias("_fixed"))
    rows = files.join(segments.select(*keys, "start", "end", label), list(keys), "left")
    ends = F.when(
        F.col("end") - F.col("start") > 1.0, F.array(F.col("start") + 0.2, F.col("end") - 0.2)
    ).otherwise(F.array(F.col("start") + 0.2))
    moments = F.when(travels, ends).otherwise(F.array((F.col("start") + F.col("end")) / 2))
    samples = rows.select(
        *keys, "duration", F.col("_fixed").isNotNull().alias("_settled"),
        F.explode(F.coalesce("_fixed", moments)).alias("t"),
    )
    numbered = _numbered(samples, keys)
    step = (F.col("_n") - 1).cast("double") / (cap - 1)
    wanted = F.transform(
        F.sequence(F.lit(0), F.lit(cap - 1)),
        lambda i: F.when(i == cap - 1, F.col("_n") - 1).otherwise(F.floor(i * step)),
    )
    number = F.when(F.col("_n") <= cap, F.col("_pos")).otherwise(F.array_position(wanted, F.col("_pos")) - 1)
    return _picked(numbered, keys, number)


def face_plan(files: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Uniform timestamps at the face rate; needs ``duration`` and ``mean_intensity``."""
    d = F.col("duration")
    n = F.greatest(F.lit(1), (d * face_fps(F.col("mean_intensity"))).cast("int"))
    return _emit(files.filter(d > 0), keys, uniform_times(d, n))


def fallback_plan(files: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Uniform timestamps when there is no motion result: one per ten seconds, 3 to 10 of them."""
    d = F.col("duration")
    n = F.least(F.lit(10), F.greatest(F.lit(3), (d / 10).cast("int")))
    return _emit(files.filter(d > 0), keys, uniform_times(d, n))


def shot_plan(files: DataFrame, n: int = 5, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Middles of ``n`` equal parts; a file without duration (an image) is sampled at 0."""
    d = F.col("duration")
    middles = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i + 0.5) * d / n)
    return _emit(files, keys, F.when(d == 0, F.array(F.lit(0.0))).otherwise(middles))


def thin_plan(plan: DataFrame, summary: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Fewer samples for stable files: first/middle/last when very stable, else every fourth."""
    rows = ordered_scan(plan, keys, ["sample_no"], total={"_n": F.lit(1).cast("long")}, position="_pos")
    rows = rows.join(summary.select(*keys, "is_stable", "mean_intensity"), list(keys), "left")
    pos, n = F.col("_pos"), F.col("_n")
    ends = (pos == 0) | (pos == F.floor(n / 2)) | (pos == n - 1)
    keep = (
        F.when(~F.coalesce("is_stable", F.lit(False)), F.lit(True))
        .when(F.col("mean_intensity") < 1.0, (n <= 3) | ends)
        .otherwise(pos % 4 == 0)
    )
    return rows.filter(keep).select(*keys, "sample_no", "t")
