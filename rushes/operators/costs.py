"""Forecasts of processing time from the rates of earlier runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushes.functions import tables
from rushes.operators.ordered import ordered_scan, slice_series


def _default_rate(stage: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in tables.DEFAULT_RATES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, stage), F.lit(1.0))


def forecast(files: DataFrame, rates: DataFrame) -> DataFrame:
    """Predicted seconds per file and stage.

    ``files`` has ``batch_id``, ``file_id``, ``stages`` (array of extractor names), ``bucket``,
    ``duration`` and, where known, ``n_frames`` and ``n_timestamps``; ``rates`` has ``extractor``, ``bucket``,
    ``rate``.  Sub-stages of the visual pass are listed by their own names.  Files without metadata count
    as one minute of 1080p.
    """
    columns = files.columns
    frames = F.col("n_frames") if "n_frames" in columns else F.lit(None).cast("long")
    stamps = F.col("n_timestamps") if "n_timestamps" in columns else F.lit(None).cast("long")
    duration = F.coalesce(F.col("duration"), F.lit(60.0))
    bucket = F.coalesce(F.col("bucket"), F.lit("1080p"))
    per_stage = files.select(
        "batch_id", "file_id", bucket.alias("bucket"), duration.alias("duration"),
        F.coalesce(
            F.when(frames > 0, frames),
            F.least(F.lit(50), F.greatest(F.lit(10), (duration / 2).cast("int"))),
        ).alias("_frames"),
        F.coalesce(F.when(stamps > 0, stamps), F.lit(5)).alias("_stamps"),
        F.explode("stages").alias("extractor"),
    )
    # Several rates of one stage and bucket count by their mean.  Adaptive execution ships the means where they turn out
    # small, and splits the files of a stage over tasks where they don't.
    known = rates.groupBy("extractor", "bucket").agg(F.avg("rate").alias("rate"))
    joined = per_stage.join(known, ["extractor", "bucket"], "left")
    rate = F.coalesce("rate", _default_rate(F.col("extractor")))
    units = (
        F.when(F.col("extractor").isin("vad", "transcript"), F.col("duration") / 60.0)
        .when(F.col("extractor").isin("frame_decode", "objects", "faces", "ocr", "clip"), F.col("_frames"))
        .when(F.col("extractor") == "visual", F.col("_stamps"))
        .otherwise(1.0)
    )
    return joined.select("batch_id", "file_id", "extractor", "bucket", (rate * units).alias("seconds"))


def batch_forecast(forecasts: DataFrame) -> DataFrame:
    return forecasts.groupBy("batch_id").agg(
        F.sum("seconds").alias("total_seconds"), F.count_distinct("file_id").alias("n_files")
    )


def enabled_stages(flags: Column | str) -> Column:
    """Extractor names that run for an array of requested features, with frame decoding where it is needed."""
    on = F.col(flags) if isinstance(flags, str) else flags
    decode = F.arrays_overlap(on, F.array(*[F.lit(x) for x in ("objects", "faces", "ocr", "clip")]))
    always = F.array(F.lit("metadata"), F.lit("telemetry"))
    return F.array_distinct(F.concat(always, on, F.when(decode, F.array(F.lit("frame_decode"))).otherwise(F.array().cast("array<string>"))))


def _stage(extractor: Column) -> Column:
    return F.when(extractor.isin(tables.VISUAL_PARTS), "visual_processing").otherwise(extractor)


def remaining_cost(runs: DataFrame, forecasts: DataFrame, **slicing) -> DataFrame:
    """Seconds left per running batch.

    ``runs``: ``batch_id``, ``current_stage``, ``current_file`` (1 for the first, 0 before it),
    ``stage_elapsed``.  ``forecasts`` is the result of ``forecast`` with ``file_no`` from 1.  Left are half of
    the current file, the later files of this stage, and all files of the later stages.
    """
    order = F.create_map(*[F.lit(x) for n, s in enumerate(tables.STAGE_ORDER) for x in (s, n)])
    staged = forecasts.withColumn("_order", F.try_element_at(order, _stage(F.col("extractor"))))
    current = runs.withColumn("_now", F.try_element_at(order, F.col("current_stage")))
    joined = current.join(staged, "batch_id", "left")
    here = F.col("_order") == F.col("_now")
    out = joined.groupBy("batch_id").agg(
        F.first("current_file").alias("current_file"),
        F.first("stage_elapsed").alias("stage_elapsed"),
        F.sum(F.when(here & (F.col("file_no") == F.col("current_file")), F.col("seconds"))).alias("_this"),
        F.sum(F.when(here & (F.col("file_no") > F.col("current_file")), F.col("seconds"))).alias("_later_files"),
        F.sum(F.when(F.col("_order") > F.col("_now"), F.col("seconds"))).alias("_later_stages"),
    )
    by_mean = F.col("stage_elapsed") / F.nullif(F.col("current_file") - 1, F.lit(0)) * 0.5
    half = F.when((F.col("stage_elapsed") > 0) & (F.col("current_file") > 1), F.greatest(F.lit(0.0), by_mean)).otherwise(
        F.coalesce("_this", F.lit(0.0)) * 0.5
    )
    stage = F.round(half + F.coalesce("_later_files", F.lit(0.0)), 1)
    total = F.round(stage + F.coalesce("_later_stages", F.lit(0.0)), 1)
    return out.select("batch_id", stage.alias("stage_seconds"), total.alias("total_seconds"))


def number_files(files: DataFrame, keys: Sequence[str] = ("batch_id",), order: Sequence[str] = ("file_id",), **slicing) -> DataFrame:
    """``file_no`` from 1 in request order."""
    df = slice_series(files, keys, order, **slicing)
    return ordered_scan(df, keys, order, position="_no").withColumn("file_no", F.col("_no") + 1).drop("_no")
