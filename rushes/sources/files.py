"""Inventories and text scans.  Sources read lazily; nothing is listed or read on the driver."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rushes.functions import tags as tg
from rushes.functions.media import file_name, media_type, parent_dir, stem, suffix
from rushes.operators.metadata import exposure_points, has_position, srt_points
from rushes.operators.sampling import sample_every
from rushes.schemas import PROBE


def _path() -> "F.Column":
    """Path of the file a row came from, without the scheme."""
    return F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), r"^[a-z0-9]+:/+", "/")


def scan_media(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``file_id, name, dir, size, size_mb, modified, media_type`` of the files below a path; dot files are skipped.

    Only the listing is read: the content column is never selected.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    listed = files.select("path", "length", "modificationTime")
    return media_files(listed.select(
        F.regexp_replace("path", r"^[a-z0-9]+:/+", "/").alias("file_id"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
    ))


def media_files(listing: DataFrame) -> DataFrame:
    """Media columns for a listing of ``file_id`` (path), ``size`` and ``modified``."""
    out = listing.withColumns(
        {
            "name": file_name("file_id"),
            "dir": parent_dir("file_id"),
            "stem": stem("file_id"),
            "media_type": media_type("file_id"),
            "size_mb": F.round(F.col("size") / (1024 * 1024), 1),
        }
    )
    return out.filter(~F.col("name").startswith("."))


def scan_probe(spark: SparkSession, path: str) -> DataFrame:
    """Probe documents, one JSON file each; a document that does not parse is a row with ``error``."""
    docs = (
        spark.read.schema(f"{PROBE}, _corrupt string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("multiLine", "true")
        .json(path)
    )
    return docs.select(
        _path().alias("file_id"), "format", "streams",
        F.when(F.col("_corrupt").isNotNull(), "unreadable probe document").alias("error"),
    )


def probe_documents(texts: DataFrame) -> DataFrame:
    """Probe documents of ``file_id, text`` rows, for very many documents kept together in few files, as ``scan_probe``."""
    schema = f"{PROBE}, _corrupt string"
    doc = F.from_json("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # exploded, so that nothing that reads or filters the fields parses the text again
    docs = texts.select("file_id", F.explode_outer(F.array(doc)).alias("_d"))
    return docs.select(
        "file_id", "_d.format", "_d.streams",
        F.when(F.col("_d").isNull() | F.col("_d._corrupt").isNotNull(), "unreadable probe document").alias("error"),
    )


def scan_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ``file_id, dir, stem, text``."""
    return spark.read.text(path, wholetext=True).select(
        _path().alias("file_id"), F.col("value").alias("text")
    ).withColumns({"dir": parent_dir("file_id"), "stem": stem("file_id")})


def scan_srt(spark: SparkSession, path: str, interval: float | None = 1.0) -> DataFrame:
    """Drone telemetry points from subtitle files, sampled every ``interval`` seconds.

    A block without a position uses up its sampling slot and is then dropped.
    """
    points = srt_points(scan_texts(spark, path))
    if interval is None:
        return points.filter(has_position())
    return sample_every(points, interval=interval, valid=has_position())


def scan_exposure_srt(spark: SparkSession, path: str, interval: float | None = 1.0) -> DataFrame:
    """Exposure settings from subtitle files; a block needs an aperture or an ISO value."""
    points = exposure_points(scan_texts(spark, path))
    useful = F.col("aperture").isNotNull() | F.col("iso").isNotNull()
    return points.filter(useful) if interval is None else sample_every(points, interval=interval, valid=useful)


def scan_sony_xml(spark: SparkSession, path: str) -> DataFrame:
    """Professional-disc sidecars with the ``dir`` and ``stem`` of their video and a candidate ``priority``."""
    texts = scan_texts(spark, path)
    marked = F.col("stem").rlike("M01$")
    exact = suffix("file_id").isNotNull() & F.col("file_id").endswith(".XML")
    return texts.select(
        "dir",
        F.when(marked, F.regexp_replace("stem", "M01$", "")).otherwise(F.col("stem")).alias("stem"),
        F.when(~marked & exact, 0).when(marked & exact, 1).when(marked, 2).alias("priority"),
        tg.parse_sony_xml("text").alias("_x"),
    ).filter(F.col("priority").isNotNull()).select("dir", "stem", "priority", "_x.*")


def scan_canon_xml(spark: SparkSession, path: str) -> DataFrame:
    """Clip sidecars with the ``dir`` and ``stem`` of their video; upper-case suffix first."""
    texts = scan_texts(spark, path)
    priority = F.when(F.col("file_id").endswith(".XML"), 0).otherwise(1)
    return texts.select("dir", "stem", priority.alias("priority"), tg.parse_canon_xml("text").alias("_x")).select(
        "dir", "stem", "priority", "_x.*"
    )


def scan_event_json(spark: SparkSession, path: str) -> DataFrame:
    """Dashcam event files, one per directory: ``dir, latitude, longitude, reason``; a zero coordinate voids both."""
    docs = spark.read.schema("est_lat string, est_lon string, reason string").option("multiLine", "true").json(path)
    rows = docs.select(parent_dir(_path()).alias("dir"), "est_lat", "est_lon", "reason")
    return event_positions(rows)


def event_positions(events: DataFrame) -> DataFrame:
    """Estimated position as numbers, null unless both are readable and not zero."""
    lat, lon = F.col("est_lat").try_cast("double"), F.col("est_lon").try_cast("double")
    both = F.coalesce((lat != 0) & (lon != 0), F.lit(False))
    rest = [c for c in events.columns if c not in ("est_lat", "est_lon")]
    return events.select(
        *rest, F.when(both, lat).alias("latitude"), F.when(both, lon).alias("longitude"),
        (F.col("est_lat").isNotNull() | F.col("reason").isNotNull()).alias("has_dashcam_event"),
    )


def scan_keyframes(spark: SparkSession, path: str) -> DataFrame:
    """Keyframe times, one number per line; other lines are skipped."""
    lines = spark.read.text(path).select(_path().alias("file_id"), F.col("value").alias("line"))
    return keyframe_times(lines)


def keyframe_times(lines: DataFrame) -> DataFrame:
    t = F.trim("line").try_cast("double")
    return lines.select("file_id", t.alias("t")).filter(F.col("t").isNotNull())


def scan_pcm(spark: SparkSession, path: str, frame_ms: int = 30, max_s: float | None = None) -> DataFrame:
    """Frames of mono 16-bit WAV files: ``file_id, i, samples, error``.

    The trailing partial frame is dropped; ``max_s`` may limit the seconds that are read.  A file that is no mono
    16-bit WAV is one row with ``error``.
    """
    files = spark.read.format("binaryFile").load(path)
    files = files.select(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/").alias("file_id"), "content")

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file_id, content in zip(pdf["file_id"], pdf["content"]):
                yield _wav_frames(file_id, content, frame_ms, max_s)

    return files.mapInPandas(frames, "file_id string, i long, samples array<smallint>, error string")


def _wav_frames(file_id: str, content: bytes, frame_ms: int, max_s: float | None) -> pd.DataFrame:
    try:
        with wave.open(io.BytesIO(content), "rb") as wav:
            if wav.getnchannels() != 1 or wav.getsampwidth() != 2:
                raise ValueError("not mono 16-bit audio")
            size = int(wav.getframerate() * frame_ms / 1000)
            most = wav.getnframes() if max_s is None else size * int(max_s * 1000 / frame_ms)
            samples = np.frombuffer(wav.readframes(most), dtype="<i2")
    except (ValueError, EOFError, wave.Error) as e:
        return pd.DataFrame({"file_id": [file_id], "i": [None], "samples": [None], "error": [str(e)]})
    n = len(samples) // size if size else 0
    rows = list(samples[: n * size].reshape(n, size)) if n else []
    return pd.DataFrame({"file_id": file_id, "i": np.arange(n), "samples": rows, "error": None})


def tail_log(lines: DataFrame, n: int = 100, level: str | None = None, order: str = "line_no", text: str = "line") -> DataFrame:
    """The last ``n`` lines, of one level if it is given."""
    if level is not None:
        lines = lines.filter(F.col(text).contains(f" {level.upper()} "))
    return lines.orderBy(F.desc(order)).limit(n)
