"""Per-file, per-run and per-batch summaries.  All of them combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rushes.functions.media import near_edge, rms, zcr
from rushes.operators.ordered import SLICE, ordered_scan, slice_series


def object_summary(tracks: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Number of tracks per label; ``tracks`` has one row per track or per tracked detection."""
    return tracks.groupBy(*keys, "label").agg(F.count_distinct("track").alias("n_tracks"))


def label_presence(responses: DataFrame, keys: Sequence[str] = ("file_id",), label: str = "label") -> DataFrame:
    """Normalised labels with how often they were named; each counts once as present."""
    return responses.groupBy(*keys, F.lower(F.trim(F.col(label))).alias("label")).agg(
        F.count(F.lit(1)).alias("n_named"), F.lit(1).cast("long").alias("present")
    )


def best_of(
    df: DataFrame, keys: Sequence[str], by: str = "confidence", order: Sequence[str] = ("t", "idx")
) -> DataFrame:
    """The row with the highest ``by`` per group, the first in ``order`` on a tie, plus ``n_detections``."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct((-F.col(by)).alias("b"), *order)
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), rank).alias("_row"), F.count(F.lit(1)).alias("n_detections")
    )
    return picked.select(*keys, "_row.*", "n_detections")


def review_flags(
    best: DataFrame, keys: Sequence[str] = ("file_id",), frame_width: Column | str = "frame_width",
    frame_height: Column | str = "frame_height", min_confidence: float = 0.95,
) -> DataFrame:
    """``review_reason`` and ``needs_review`` for the best face of each person.

    A file with one single detection is flagged ``single_detection`` only.
    """
    total = F.sum("n_detections").over(Window.partitionBy(*keys))
    reasons = F.array_compact(
        F.array(
            F.when(near_edge("bbox", frame_width, frame_height), "near_edge"),
            F.when(F.col("confidence") < min_confidence, "low_confidence"),
            F.when(F.col("n_detections") == 1, "single_detection"),
        )
    )
    reason = F.when(total == 1, "single_detection").otherwise(F.nullif(F.array_join(reasons, ", "), F.lit("")))
    return best.withColumn("review_reason", reason).withColumn("needs_review", F.col("review_reason").isNotNull())


def face_summary(best: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    return best.groupBy(*keys).agg(
        F.sum("n_detections").alias("n_detections"),
        F.count(F.lit(1)).alias("n_persons"),
        F.count_if("needs_review").alias("n_review"),
    )


def speaker_stats(turns: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Speaking time and turns per speaker (overlapping turns count twice)."""
    return turns.groupBy(*keys, "speaker").agg(
        F.sum(F.col("end") - F.col("start")).alias("total_duration"), F.count(F.lit(1)).alias("n_turns")
    )


def speaker_count(turns: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    return turns.groupBy(*keys).agg(F.count_distinct("speaker").alias("speaker_count"))


def keyframe_stats(
    keyframes: DataFrame, keys: Sequence[str] = ("file_id",), t: str = "t", order: Sequence[str] | None = None,
    **slicing,
) -> DataFrame:
    """Count, mean interval and whether at least 80 % of intervals lie within 20 % of the mean.

    Fewer than two keyframes give (false, null), a mean of zero (false, 0).
    """
    order = list(order or [t])
    df = slice_series(keyframes, keys, order, **slicing)
    stepped = ordered_scan(df, keys, order, nxt={"_next": t})
    gaps = stepped.withColumn("_gap", F.col("_next") - F.col(t))
    if SLICE not in df.columns:  # each file lies whole in a task by now, so its mean needs no second reading
        placed = gaps.withColumn("_mean", F.avg("_gap").over(Window.partitionBy(*keys)))
        near = F.abs(F.col("_gap") - F.col("_mean")) / F.nullif(F.col("_mean"), F.lit(0.0)) < 0.2
        out = placed.groupBy(*keys).agg(
            F.first("_mean").alias("_mean"), F.count(F.lit(1)).alias("n_keyframes"), (F.count_if(near) / F.nullif(F.count("_gap"), F.lit(0))).alias("_share")
        )
        fixed = F.coalesce((F.col("_mean") != 0) & (F.col("_share") >= 0.8), F.lit(False))
        return out.select(*keys, "n_keyframes", fixed.alias("is_fixed_interval"), F.round("_mean", 3).alias("avg_interval"))
    mean = gaps.groupBy(*keys).agg(F.avg("_gap").alias("_mean"), F.count(F.lit(1)).alias("n_keyframes"))
    near = F.abs(F.col("_gap") - F.col("_mean")) / F.nullif(F.col("_mean"), F.lit(0.0)) < 0.2
    regular = (
        gaps.filter(F.col("_gap").isNotNull())
        .join(mean.select(*keys, "_mean"), list(keys))
        .groupBy(*keys)
        .agg((F.count_if(near) / F.count(F.lit(1))).alias("_share"))
    )
    out = mean.join(regular, list(keys), "left")
    fixed = F.coalesce((F.col("_mean") != 0) & (F.col("_share") >= 0.8), F.lit(False))
    return out.select(*keys, "n_keyframes", fixed.alias("is_fixed_interval"), F.round("_mean", 3).alias("avg_interval"))


def track_bounds(points: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
    )


def vote(
    df: DataFrame, keys: Sequence[str] = ("file_id",), label: str = "label", order: Sequence[str] = ("t",)
) -> DataFrame:
    """Most frequent label per series and its share of all rows; rows without a label count as frames only.

    A tie goes to the label seen first.
    """
    counted = df.groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("_votes"), F.min(F.struct(*order)).alias("_first")
    )
    rank = F.when(F.col(label).isNotNull(), F.struct((-F.col("_votes")).alias("v"), "_first"))
    won = counted.groupBy(*keys).agg(
        F.min_by(label, rank).alias("primary"),
        F.max(F.when(F.col(label).isNotNull(), F.col("_votes"))).alias("_best"),
        F.sum("_votes").alias("n_frames"),
    )
    return won.select(*keys, "primary", F.round(F.col("_best") / F.col("n_frames"), 3).alias("confidence"), "n_frames")


def speech_frames(pcm: DataFrame, level: int = 2, samples: str = "samples") -> DataFrame:
    """Energy, zero-crossing rate and the speech test of PCM frames."""
    from rushes.functions.media import is_speech

    measured = pcm.withColumns({"energy": rms(samples), "crossing_rate": zcr(samples)})
    return measured.withColumn("is_speech", is_speech("energy", "crossing_rate", level))


def speech_stats(
    frames: DataFrame, keys: Sequence[str] = ("file_id",), flag: str = "is_speech", step: float = 0.03,
    min_seconds: float = 0.5,
) -> DataFrame:
    """Speech share and seconds; ``speech`` needs half a second and more than a tenth of the frames."""
    out = frames.groupBy(*keys).agg(F.count_if(flag).alias("n_speech"), F.count(F.lit(1)).alias("n_frames"))
    seconds, share = F.col("n_speech") * step, F.col("n_speech") / F.col("n_frames")
    content = F.when((seconds >= min_seconds) & (share > 0.1), "speech").otherwise("audio")
    return out.select(
        *keys, "n_frames", F.round(share, 3).alias("speech_ratio"), seconds.alias("speech_seconds"),
        content.alias("audio_content"),
    )


def recording_stats(clips: DataFrame, keys: Sequence[str], duration: str = "duration") -> DataFrame:
    """Clips, total duration and whether the recording spans several clips."""
    out = clips.groupBy(*keys, "recording").agg(
        F.count(F.lit(1)).alias("n_clips"), F.sum(duration).alias("total_duration")
    )
    return out.withColumn("is_spanned", F.col("n_clips") > 1)


def mode_bucket(files: DataFrame, keys: Sequence[str], bucket: str = "bucket", order: Sequence[str] = ("idx",)) -> DataFrame:
    """Most common bucket per batch, the first seen on a tie."""
    counted = files.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_first"))
    return counted.groupBy(*keys).agg(
        F.min_by(bucket, F.struct((-F.col("_n")).alias("n"), "_first")).alias("common_bucket"),
        F.sum("_n").alias("n_files"),
    )


def stage_report(run_events: DataFrame) -> DataFrame:
    """Times and memory per batch, stage and file.

    ``level`` is 0 for a file in a stage, 1 for a stage, 3 for a batch, 7 for everything.  Events are summed up by file
    first, so that the ``rollup`` multiplies one row per file and not every event.
    """
    by_file = run_events.groupBy("batch_id", "extractor", "file_id").agg(
        F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("n"), F.min("started_at").alias("first"),
        F.max("started_at").alias("last"), F.max("memory_mb").alias("peak"),
    )
    return by_file.rollup("batch_id", "extractor", "file_id").agg(
        F.grouping_id().cast("long").alias("level"),
        F.round(F.sum("seconds"), 2).alias("total_seconds"),
        F.sum("n").alias("n_events"),
        F.min("first").alias("first_started"),
        F.max("last").alias("last_started"),
        F.max("peak").alias("peak_memory_mb"),
    )


def stage_timing(run_events: DataFrame) -> DataFrame:
    """Per batch and stage: elapsed seconds from first start to last end, and files processed."""
    ended = F.col("started_at") + F.col("seconds")
    return run_events.groupBy("batch_id", "extractor").agg(
        F.min("started_at").alias("started"),
        F.round(F.max(ended) - F.min("started_at"), 2).alias("duration_seconds"),
        F.count_distinct("file_id").alias("files_processed"),
    )


def predicted_rate(rates: DataFrame, n: int = 20, order: Sequence[str] = ("started_at", "idx")) -> DataFrame:
    """Mean of the last ``n`` rates per extractor and bucket.

    The ``n`` latest rows are kept by a ranked window, which Spark prunes to ``n`` per key and task
    before the shuffle.
    """
    last = last_rates(rates, n, order)
    return last.groupBy("extractor", "bucket").agg(F.avg("rate").alias("rate"), F.count(F.lit(1)).alias("n_samples"))


def last_rates(rates: DataFrame, n: int = 20, order: Sequence[str] = ("started_at", "idx")) -> DataFrame:
    w = Window.partitionBy("extractor", "bucket").orderBy(*[F.desc(c) for c in order])
    return rates.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def unit_rate(seconds: Column | str, units: Column | str) -> Column:
    """Seconds per unit; raw seconds when there are no units."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    u = F.col(units) if isinstance(units, str) else units
    return F.when(u > 0, s / u).otherwise(s)


STATUSES = ("pending", "active", "completed", "failed", "skipped")


def status_counts(df: DataFrame, keys: Sequence[str] = ("batch_id", "extractor"), names: Sequence[str] = STATUSES) -> DataFrame:
    """Status matrix: one column per status in ``names``, and ``other`` for all further ones and null (one shuffle)."""
    known = F.coalesce(F.col("status").isin(list(names)), F.lit(False))
    return df.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in names], F.count_if(~known).alias("other"))


def prefilter_report(frames: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Frames checked and skipped by the text prefilter; ``frames`` has ``has_text``."""
    out = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames_checked"), F.count_if(~F.col("has_text")).alias("frames_skipped")
    )
    return out.withColumn("skip_pct", F.round(F.col("frames_skipped") / F.col("frames_checked") * 100, 0))


def flow_stats(
    flow: DataFrame, keys: Sequence[str] = ("file_id", "frame"), sizes: DataFrame | None = None
) -> DataFrame:
    """Mean x, y, magnitude and radial divergence of a flow field given as ``(x, y, fx, fy)`` rows.

    The centre is ``(width // 2, height // 2)``; the field size comes from ``sizes`` or from columns
    ``width`` and ``height`` of ``flow``.
    """
    if sizes is not None:
        flow = flow.join(sizes, [c for c in sizes.columns if c not in ("width", "height")])
    rx = F.col("x") - F.floor(F.col("width") / 2)
    ry = F.col("y") - F.floor(F.col("height") / 2)
    reach = F.sqrt(rx * rx + ry * ry) + 1e-7
    return flow.groupBy(*keys).agg(
        F.avg("fx").alias("mean_x"),
        F.avg("fy").alias("mean_y"),
        F.avg(F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))).alias("magnitude"),
        F.avg((F.col("fx") * rx + F.col("fy") * ry) / reach).alias("divergence"),
    )


def dominant_channel(energy: DataFrame, keys: Sequence[str] = ("file_id", "segment")) -> DataFrame:
    """Loudest channel per segment and its ratio to the second loudest (infinite when that is silent)."""
    # The two loudest channels survive each merge: the best row, and the best that is not it.
    w = Window.partitionBy(*keys).orderBy(F.desc("rms"), "channel")
    ranked = energy.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2)
    out = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.col("channel"))).alias("channel"),
        F.max(F.when(F.col("_r") == 1, F.col("rms"))).alias("_top"),
        F.max(F.when(F.col("_r") == 2, F.col("rms"))).alias("_second"),
    )
    ratio = F.when(F.coalesce("_second", F.lit(0.0)) > 0, F.col("_top") / F.col("_second")).otherwise(
        F.lit(float("inf"))
    )
    return out.select(*keys, "channel", ratio.alias("ratio"))


def channel_mode(dominant: DataFrame, keys: Sequence[str] = ("file_id",), threshold: float = 1.5) -> DataFrame:
    """Use channels as speakers when the mean ratio exceeds the threshold."""
    return dominant.groupBy(*keys).agg(
        F.avg("ratio").alias("mean_ratio"), (F.avg("ratio") > threshold).alias("use_channels")
    )


def active_channels(
    channels: DataFrame, keys: Sequence[str] = ("file_id", "channel"), min_ratio: float = 0.1
) -> DataFrame:
    """Channels whose speech ratio exceeds ``min_ratio``."""
    return channels.groupBy(*keys).agg(F.avg(F.col("is_speech").cast("double")).alias("speech_ratio")).withColumn(
        "is_active", F.col("speech_ratio") > min_ratio
    )


def channel_correlation(waves: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Correlation of two channels' samples (``a``, ``b``): near 1 means one microphone on both."""
    return waves.groupBy(*keys).agg(F.corr("a", "b").alias("correlation"))


def telemetry_header(points: DataFrame, source: str, interval: float = 1.0, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.lit(source).alias("source"),
        F.lit(1.0 / interval).alias("sample_rate"),
        F.max("t").alias("duration"),
        F.count(F.lit(1)).alias("n_points"),
    )


def top_labels(tracks: DataFrame, k: int = 15) -> DataFrame:
    """Labels by number of tracks, the first ``k``."""
    counted = tracks.groupBy("label").agg(F.count(F.lit(1)).alias("n_tracks"))
    return counted.orderBy(F.desc("n_tracks"), "label").limit(k)


def run_series_report(
    runs: DataFrame, keys: Sequence[str] = ("series",), order: Sequence[str] = ("idx",), min_runs: int = 5,
    growth_limit: float = 20.0, **slicing,
) -> DataFrame:
    """Success rate, durations, memory and memory growth of a series of repeated runs.

    Statistics cover successful runs; memory readings of zero or less are left out.  Growth compares the mean
    peak of the later half with that of the first ``n // 2`` readings and is flagged above ``growth_limit``
    percent when there are at least ``min_runs`` readings.
    """
    df = slice_series(runs, keys, order, **slicing)
    counts = ((F.col("success")) & (F.col("peak_memory_mb") > 0)).cast("long")
    df = ordered_scan(df, keys, order, cum={"_nth": counts}, total={"_n": counts})
    ok = F.col("success")
    memory = F.when(ok & (F.col("memory_mb") > 0), F.col("memory_mb"))
    peak = F.when(ok & (F.col("peak_memory_mb") > 0), F.col("peak_memory_mb"))
    duration = F.when(ok, F.col("duration"))
    early = F.col("_nth") <= F.floor(F.col("_n") / 2)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(ok).alias("n_success"),
        F.min(duration).alias("min_duration"), F.max(duration).alias("max_duration"), F.avg(duration).alias("avg_duration"),
        F.min(memory).alias("min_memory"), F.max(memory).alias("max_memory"),
        F.min(peak).alias("min_peak"), F.max(peak).alias("max_peak"),
        F.count(peak).alias("_peaks"),
        F.avg(F.when(early, peak)).alias("_first"), F.avg(F.when(~early, peak)).alias("_second"),
    )
    growth = F.when(F.col("_first") > 0, (F.col("_second") - F.col("_first")) / F.col("_first") * 100).otherwise(0.0)
    growth = F.when(F.col("_peaks") >= min_runs, growth)
    return out.withColumns(
        {
            "success_rate": F.col("n_success") / F.col("n_runs") * 100,
            "growth_pct": growth,
            "is_growing": F.coalesce(growth > growth_limit, F.lit(False)),
        }
    ).drop("_peaks", "_first", "_second")
