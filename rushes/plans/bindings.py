"""Observation tables as views over the driver tables, once for Spark and once as SQL text.

A user of ``events`` is a file and an event is what was seen in one of its frames; ten hours of event
time count as one second, which gives files of about 72 seconds with gaps around every threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rushes.functions.media import box


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros_since(ts: Column, start: str) -> Column:
    """Microseconds from ``start`` to a timestamp without zone."""
    return F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp_ntz").cast("timestamp"))


def days_since(ts: Column, start: str) -> Column:
    return F.datediff(ts.cast("date"), F.lit(start).cast("date")).cast("long")


MOTION = {"view": "static", "click": "pan_left", "purchase": "tilt_up", "signup": "push_in", "error": "handheld"}


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id, t, idx, label, intensity, props``: one observation per event."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("file_id"),
        (micros_since(F.col("ts"), "2024-01-01").cast("double") / 3.6e10).alias("t"),
        F.col("event_id").alias("idx"),
        F.col("event_type").alias("label"),
        (F.col("value") / F.when(F.col("user_id") % 4 == 0, 97).when(F.col("user_id") % 4 == 1, 31).otherwise(7)).alias("intensity"),
        "props",
    )


OBS = """obs AS (
  SELECT user_id AS file_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))::DOUBLE / 3.6e10 AS t,
         event_id AS idx, event_type AS label, value / CASE user_id % 4 WHEN 0 THEN 97 WHEN 1 THEN 31 ELSE 7 END AS intensity, props
  FROM events)"""


def motion_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations whose label is a camera motion."""
    pairs = [F.lit(x) for kv in MOTION.items() for x in kv]
    obs = observations(spark, sf_dir).drop("props")
    return obs.withColumn("label", F.element_at(F.create_map(*pairs), F.col("label")))


FRAMES = OBS + """, frames AS (
  SELECT file_id, t, idx, intensity,
         CASE label WHEN 'view' THEN 'static' WHEN 'click' THEN 'pan_left' WHEN 'purchase' THEN 'tilt_up'
                    WHEN 'signup' THEN 'push_in' ELSE 'handheld' END AS label
  FROM obs)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with a box and a confidence."""
    e = F.col("idx")
    return observations(spark, sf_dir).select(
        "file_id", "t", "idx", "label",
        (F.lit(0.4) + (e * 7 % 60) / F.lit(100.0)).alias("confidence"),
        box(e * 37 % 120, e * 53 % 90, e % 120 + 60, e % 90 + 60).alias("bbox"),
    )


DETS = OBS + """, dets AS (
  SELECT file_id, t, idx, label, 0.4::DOUBLE + (idx * 7 % 60) / 100.0::DOUBLE AS confidence,
         (idx * 37 % 120) AS x, (idx * 53 % 90) AS y, (idx % 120 + 60) AS w, (idx % 90 + 60) AS h
  FROM obs)"""


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id, duration, width, height``: how long each file is, and its frame size."""
    per_file = observations(spark, sf_dir).groupBy("file_id").agg((F.max("t") + 0.2).alias("duration"))
    f = F.col("file_id")
    return per_file.withColumns({"width": (f % 8 * 1000 + 640).cast("int"), "height": (f % 8 * 560 + 360).cast("int")})


FILES = """files AS (
  SELECT file_id, max(t) + 0.2 AS duration, (file_id % 8 * 1000 + 640)::INT AS width,
         (file_id % 8 * 560 + 360)::INT AS height
  FROM obs GROUP BY file_id)"""


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with the embedding of a vector chosen by event number."""
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()
    det = detections(spark, sf_dir).withColumn("vec_id", F.col("idx") % n)
    return det.join(vectors.select("vec_id", "embedding"), "vec_id").drop("vec_id")


def label_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector per label: ``label, idx, embedding``."""
    vectors = table(spark, sf_dir, "embeddings")
    dims = vectors.select("label", F.posexplode("embedding").alias("d", "x"))
    means = dims.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # One value per dimension: the list is as long as a vector, whatever the table holds.
    packed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("_l"))
    return packed.select(
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("label"),
        F.col("label").cast("long").alias("idx"),
        F.transform("_l", lambda s: s["m"]).alias("embedding"),
    )


CENTRES = """centres AS (
  SELECT 'label ' || label AS label, label::BIGINT AS idx, list(m ORDER BY d) AS embedding
  FROM (SELECT label, d, avg(embedding[d]::DOUBLE) AS m
        FROM embeddings, range(1, 65) r(d) GROUP BY label, d)
  GROUP BY label)"""
