"""Scalar expressions over file, stream, detection and audio columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushes.functions import tables


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def none_if_empty(col: Column | str) -> Column:
    return F.nullif(_c(col), F.lit(""))


# --- files -----------------------------------------------------------------------------------------------

def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def parent_dir(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def suffix(path: Column | str) -> Column:
    """Lower-cased suffix without the dot, null when there is none (a leading dot does not start one)."""
    return F.lower(none_if_empty(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1)))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def media_type(path: Column | str) -> Column:
    """video, image, audio or unknown, from the suffix."""
    ext = suffix(path)
    return (
        F.when(ext.isin(tables.VIDEO_SUFFIXES), "video")
        .when(ext.isin(tables.IMAGE_SUFFIXES), "image")
        .when(ext.isin(tables.AUDIO_SUFFIXES), "audio")
        .otherwise("unknown")
    )


def resolution_bucket(width: Column | str, height: Column | str) -> Column:
    pixels = _c(width).cast("long") * _c(height).cast("long")
    ladder = F.when(pixels.isNull(), "unknown")
    for limit, name in tables.RESOLUTION_BUCKETS:
        ladder = ladder.when(pixels <= limit, name)
    return ladder.otherwise("8k+")


def frame_skip(width: Column | str, height: Column | str) -> Column:
    """Frames to skip between analysed frames: 4 above 5K, 2 above 4K, 1 above 1080p."""
    pixels = _c(width).cast("long") * _c(height).cast("long")
    return (
        F.when(pixels > tables.PIXELS_5K, 4)
        .when(pixels > tables.PIXELS_4K, 2)
        .when(pixels > tables.PIXELS_1080P, 1)
        .otherwise(0)
    )


def date_from_filename(path: Column | str) -> Column:
    """Date after an ``H`` in the file name, six digits YYMMDD; years below 70 are 20yy."""
    digits = F.regexp_extract(stem(path), r"(?i)H([0-9]{6})", 1)
    year = F.substring(digits, 1, 2).try_cast("int")
    century = F.when(year < 70, 2000).otherwise(1900)
    iso = F.concat_ws(
        "-", (century + year).cast("string"), F.substring(digits, 3, 2), F.substring(digits, 5, 2)
    )
    return F.when(digits != "", iso).try_cast("date")


# --- streams ---------------------------------------------------------------------------------------------

def _ratio(rate: Column) -> Column:
    fields = F.split(rate, "/")
    num = F.get(fields, F.lit(0)).try_cast("long")
    den = F.get(fields, F.lit(1)).try_cast("long")
    return F.when(F.size(fields) == 2, F.round(num / F.nullif(den, F.lit(0)), 2))


def parse_fps(avg_frame_rate: Column | str, r_frame_rate: Column | str) -> Column:
    """``num/den`` of the average rate, else of the nominal one; a zero denominator is skipped."""
    return F.coalesce(_ratio(_c(avg_frame_rate)), _ratio(_c(r_frame_rate)))


def bit_depth(bits_per_raw_sample: Column | str, pix_fmt: Column | str) -> Column:
    fmt = _c(pix_fmt)
    trailing = F.regexp_extract(fmt, r"([0-9]+)(?:le|be)?$", 1).try_cast("int")
    # Formats without a number in their name that hold 8 bits.
    eight = fmt.isin("yuv420p", "yuv422p", "yuv444p", "yuvj420p", "yuvj422p")
    return F.coalesce(
        _c(bits_per_raw_sample).try_cast("int"),
        F.when(trailing.isin(10, 12, 16), trailing).when(eight, 8),
    )


def shift_timecode(
    hours: Column | str, minutes: Column | str, seconds: Column | str, frames: Column | str, fps: Column | float,
    by: int = 2,
) -> Column:
    """Timecode ``by`` frames earlier, borrowing through seconds, minutes and hours; hours do not wrap."""
    rate = F.lit(fps) if isinstance(fps, (int, float)) else fps
    f = _c(frames) - by
    borrow_s = (f < 0).cast("int")
    s = _c(seconds) - borrow_s
    borrow_m = (s < 0).cast("int")
    m = _c(minutes) - borrow_m
    borrow_h = (m < 0).cast("int")
    h = _c(hours) - borrow_h
    return F.format_string(
        "%02d:%02d:%02d:%02d",
        h.cast("int"),
        (m + borrow_h * 60).cast("int"),
        (s + borrow_m * 60).cast("int"),
        (f + borrow_s * F.round(rate).cast("int")).cast("int"),
    )


def bcd_to_int(byte: Column | str) -> Column:
    """Two decimal digits packed in one byte."""
    b = _c(byte)
    return F.shiftright(b, 4) * 10 + b.bitwiseAND(F.lit(15))


def rational(b0: Column | str, b1: Column | str, b2: Column | str, b3: Column | str) -> Column:
    """Two big-endian 16-bit numbers as a fraction; a zero denominator leaves the numerator."""
    num = (_c(b0) * 256 + _c(b1)).cast("double")
    den = _c(b2) * 256 + _c(b3)
    return F.when(den > 0, num / den).otherwise(num)


def is_log_footage(transfer: Column | str) -> Column:
    """True for log and HDR transfer names."""
    name = F.replace(F.replace(F.lower(_c(transfer)), F.lit("_"), F.lit("-")), F.lit(" "), F.lit(""))
    words = reduce(lambda a, b: a | b, [name.contains(w) for w in tables.LOG_WORDS])
    return F.coalesce(name.isin(tables.LOG_TRANSFERS) | words, F.lit(False))


# --- detections ------------------------------------------------------------------------------------------

def box(x: Column | str, y: Column | str, width: Column | str, height: Column | str) -> Column:
    return F.struct(
        _c(x).cast("int").alias("x"), _c(y).cast("int").alias("y"),
        _c(width).cast("int").alias("width"), _c(height).cast("int").alias("height"),
    )


def box_iou(a: Column | str, b: Column | str) -> Column:
    """Intersection over union of two boxes, 0 when they do not overlap."""
    a, b = _c(a), _c(b)
    across = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    down = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    shared = across.cast("long") * down.cast("long")
    both = a["width"].cast("long") * a["height"] + b["width"].cast("long") * b["height"]
    return F.when((across > 0) & (down > 0), shared / (both - shared)).otherwise(0.0)


def near_edge(b: Column | str, frame_width: Column | str, frame_height: Column | str, margin: float = 0.05) -> Column:
    b, w, h = _c(b), _c(frame_width), _c(frame_height)
    mx, my = F.floor(w * margin), F.floor(h * margin)
    return (b["x"] < mx) | (b["y"] < my) | (b["x"] + b["width"] > w - mx) | (b["y"] + b["height"] > h - my)


def pad_box(b: Column | str, frame_width: Column | str, frame_height: Column | str, pad: float = 0.3) -> Column:
    """Crop corners ``x1, y1, x2, y2`` with padding on each side, inside the frame."""
    b = _c(b)
    px, py = F.floor(b["width"] * pad), F.floor(b["height"] * pad)
    return F.struct(
        F.greatest(F.lit(0), b["x"] - px).cast("int").alias("x1"),
        F.greatest(F.lit(0), b["y"] - py).cast("int").alias("y1"),
        F.least(_c(frame_width), b["x"] + b["width"] + px).cast("int").alias("x2"),
        F.least(_c(frame_height), b["y"] + b["height"] + py).cast("int").alias("y2"),
    )


def polygon_to_box(points: Column | str) -> Column:
    """Bounding box of an array of ``{x, y}`` points, corners truncated to int."""
    xs = F.transform(_c(points), lambda p: p["x"].cast("double"))
    ys = F.transform(_c(points), lambda p: p["y"].cast("double"))
    x, y = F.array_min(xs).cast("int"), F.array_min(ys).cast("int")
    return F.struct(
        x.alias("x"), y.alias("y"),
        (F.array_max(xs) - x).cast("int").alias("width"), (F.array_max(ys) - y).cast("int").alias("height"),
    )


def keep_detections(df: DataFrame, min_conf: float = 0.6, min_side: int = 0) -> DataFrame:
    """Confidence and size filter (objects 0.6/50, faces 0.5/80, text 0.5/0)."""
    kept = df.filter(F.col("confidence") >= min_conf)
    if min_side:
        kept = kept.filter((F.col("bbox.width") >= min_side) & (F.col("bbox.height") >= min_side))
    return kept


def emit_rounding(df: DataFrame, t: str | None = "t", confidence: str = "confidence") -> DataFrame:
    """Timestamps to 2 and confidences to 3 decimals; pass ``t=None`` for text detections."""
    out = df.withColumn(confidence, F.round(confidence, 3))
    return out.withColumn(t, F.round(t, 2)) if t else out


def text_like(width: Column | str, height: Column | str) -> Column:
    """A region shaped and sized like text."""
    w, h = _c(width), _c(height)
    aspect = w / F.nullif(h, F.lit(0))
    return F.coalesce(aspect.between(0.2, 15) & (w.cast("long") * h).between(100, 50000), F.lit(False))


def text_frames(regions: DataFrame, keys: Sequence[str] = ("file_id", "t"), min_regions: int = 3) -> DataFrame:
    """Per frame: number of regions, of text-like ones, and whether the frame passes the text prefilter."""
    counted = regions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_regions"), F.count_if(text_like("width", "height")).alias("n_text_like")
    )
    passes = (F.col("n_regions") >= min_regions) & (F.col("n_text_like") >= min_regions)
    return counted.withColumn("has_text", passes)


# --- motion ----------------------------------------------------------------------------------------------

def classify_flow(
    mean_x: Column | str, mean_y: Column | str, magnitude: Column | str, divergence: Column | str
) -> Column:
    """Camera motion from the means of a flow field."""
    mx, my, mag, div = _c(mean_x), _c(mean_y), _c(magnitude), _c(divergence)
    ax, ay = F.abs(mx), F.abs(my)
    pans = (ax > ay) & (ax > 2.0) & (ax / (mag + 1e-7) > 0.7)
    tilts = (ay > ax) & (ay > 2.0) & (ay / (mag + 1e-7) > 0.7)
    return (
        F.when(mag < 0.5, "static")
        .when(F.abs(div) > 0.3 * mag, F.when(div > 0, "push_in").otherwise("pull_out"))
        .when(pans, F.when(mx > 0, "pan_left").otherwise("pan_right"))
        .when(tilts, F.when(my > 0, "tilt_up").otherwise("tilt_down"))
        .when(mag > 2.0, "handheld")
        .otherwise("static")
    )


def face_fps(intensity: Column | str) -> Column:
    v = F.coalesce(_c(intensity), F.lit(0.0))
    return F.when(v >= 10, 3.0).when(v >= 6, 2.0).when(v >= 2, 1.5).otherwise(1.0)


# --- audio and text --------------------------------------------------------------------------------------

def rms(samples: Column | str) -> Column:
    """Root mean square of PCM samples, 0 for an empty frame."""
    s = _c(samples)
    squares = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.when(F.size(s) == 0, 0.0).otherwise(F.sqrt(squares / F.nullif(F.size(s), F.lit(0))))


def zcr(samples: Column | str) -> Column:
    """Share of neighbouring samples with different sign (0 counts as positive)."""
    s = _c(samples)
    n = F.size(s)
    steps = F.zip_with(
        F.slice(s, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(s, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: ((a >= 0) != (b >= 0)).cast("int"),
    )
    crossings = F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)
    return F.when(n < 2, 0.0).otherwise(crossings / F.nullif(n - 1, F.lit(0)))


def is_speech(energy: Column | str, crossing_rate: Column | str, level: int = 2) -> Column:
    low, high = tables.SPEECH_ZCR
    loud = _c(energy) >= tables.SPEECH_ENERGY.get(level, 350.0)
    return loud & _c(crossing_rate).between(low, high)


def choose_language(
    forced: Column | str, detected: Column | str, confidence: Column | str, duration: Column | str,
    fallback: Column | str,
) -> Column:
    """Struct ``language``, ``fallback_applied``: a short clip with an unsure detection takes the fallback."""
    forced_c = _c(forced)
    unsure = forced_c.isNull() & (_c(confidence) < 0.7) & (_c(duration) < 15)
    unsure = F.coalesce(unsure, F.lit(False))
    language = F.coalesce(forced_c, F.when(unsure, _c(fallback)).otherwise(_c(detected)))
    return F.struct(language.alias("language"), unsure.alias("fallback_applied"))


def query_gate(text: Column | str, lang: Column | str) -> Column:
    """Struct ``source_lang``, ``needs_translation``: short, unknown and English queries stay as they are."""
    source = F.when(F.length(F.trim(_c(text))) >= 3, _c(lang))
    needs = F.coalesce(source != "en", F.lit(False))
    return F.struct(source.alias("source_lang"), needs.alias("needs_translation"))


def stage_gate(enabled: Column | str) -> Column:
    """Map of stage to ``pending`` or ``skipped`` from the array of enabled extractor names."""
    on = _c(enabled)
    decode = F.arrays_overlap(on, F.array(*[F.lit(x) for x in ("objects", "faces", "ocr", "clip")]))
    pairs = []
    for stage in tables.STATUS_ORDER:
        runs = {"telemetry": F.lit(True), "frame_decode": decode}.get(stage, F.array_contains(on, stage))
        pairs += [F.lit(stage), F.when(runs, "pending").otherwise("skipped")]
    return F.create_map(*pairs)
