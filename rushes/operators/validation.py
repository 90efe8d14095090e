"""Checks of result documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate(docs: DataFrame, enabled: Sequence[str], keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """One row per warning.

    ``docs`` has ``status``, ``error``, a map ``present`` of extractor to ``result``, ``null`` or nothing, and
    the checked values ``duration``, ``width``, ``fps``, ``has_audio`` (null: no metadata), ``face_count``,
    ``face_detections``, ``clip_segments`` and ``payload_keys`` (map of extractor to the array of its keys).
    """
    done = F.col("status") == "completed"
    has_meta = F.coalesce(F.try_element_at("present", F.lit("metadata")) == "result", F.lit(False))

    def state(name: str) -> Column:
        return F.try_element_at("present", F.lit(name))

    checks: list[Column] = [
        F.when(F.col("status") == "failed", F.concat(F.lit("file failed - "), F.coalesce("error", F.lit("unknown error")))),
        F.when(
            ~F.coalesce(F.col("status").isin("failed", "completed"), F.lit(False)),
            F.concat(F.lit("unexpected status '"), F.coalesce("status", F.lit("None")), F.lit("'")),
        ),
    ]
    for name in enabled:
        asked = done if name != "transcript" else done & F.coalesce("has_audio", F.lit(True))
        checks.append(F.when(asked & state(name).isNull(), f"missing '{name}' results"))
        checks.append(F.when(asked & (state(name) == "null"), f"'{name}' returned None"))
    meta = done & has_meta
    for field, col in (("duration", "duration"), ("resolution", "width"), ("fps", "fps")):
        checks.append(F.when(meta & F.col(col).isNull(), f"metadata missing '{field}'"))
    checks.append(
        F.when(meta & (F.coalesce("duration", F.lit(0.0)) <= 0),
               F.concat(F.lit("invalid duration "), F.coalesce("duration", F.lit(0.0)).cast("string")))
    )
    # Key each payload must have.
    required = {"objects": "summary", "faces": "detections", "ocr": "detections", "clip": "segments",
                "visual": "summary", "transcript": "segments"}
    for name, key in required.items():
        has_key = F.array_contains(F.try_element_at("payload_keys", F.lit(name)), key)
        filled = done & (state(name) == "result")
        checks.append(F.when(filled & ~F.coalesce(has_key, F.lit(False)), f"{name} missing '{key}'"))
    some_faces = done & (state("faces") == "result") & (F.col("face_count") > 0) & (F.col("face_detections") == 0)
    checks.append(
        F.when(some_faces, F.concat(F.lit("faces count="), F.col("face_count").cast("string"), F.lit(" but no detections")))
    )
    checks.append(
        F.when(done & (state("clip") == "result") & (F.col("clip_segments") == 0), "clip has no segments (all frames failed?)")
    )
    return docs.select(*keys, F.explode(F.array_compact(F.array(*checks))).alias("warning"))


def warning_counts(warnings: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent warnings."""
    counted = warnings.groupBy("warning").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "warning").limit(k)
