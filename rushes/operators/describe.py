"""The whole metadata step: probe documents and sidecars to one described row per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushes.functions.media import date_from_filename, parent_dir, stem
from rushes.functions.tags import parse_embedded_xml, parse_iso6709, tag
from rushes.operators.joins import pick_candidate
from rushes.operators.metadata import base_metadata, lower_tags
from rushes.operators.rules import RuleBook, attribute_device, comment_color

_PLACE = "struct<latitude:double,longitude:double,altitude:double>"
_COLOR = "struct<transfer:string,primaries:string,matrix:string>"


def _attach(df: DataFrame, side: DataFrame | None, keys: Sequence[str], name: str, fields: str) -> DataFrame:
    """Left-join a side table as one struct column; a missing table gives nulls of the same shape."""
    if side is None:
        return df.withColumn(name, F.lit(None).cast(f"struct<{fields}>"))
    body = [c for c in side.columns if c not in keys]
    return df.join(side.select(*keys, F.struct(*body).alias(name)), list(keys), "left")


def _when(rule: str, value: Column) -> Column:
    return F.when(F.col("rule") == rule, value)


def describe_files(
    probe: DataFrame,
    srt: DataFrame | None = None,
    sony: DataFrame | None = None,
    canon: DataFrame | None = None,
    events: DataFrame | None = None,
    book: RuleBook | None = None,
) -> DataFrame:
    """Base metadata, device and everything the device's sidecars add.

    ``probe``: ``file_id, format, streams``.  ``srt``: the result of ``srt_summary`` with ``dir`` and ``stem``; ``sony``
    and ``canon``: their scans (all candidates); ``events``: one row per ``dir``.  Sidecars win over embedded
    tags and those over base values, except that a recording time in the file comes first.
    """
    rows = lower_tags(probe).withColumns({"dir": parent_dir("file_id"), "stem": stem("file_id")})
    out = base_metadata(rows, keep=["tags", "streams", "dir", "stem"])
    by_name = ["dir", "stem"]
    out = _attach(
        out, srt, by_name, "_srt",
        f"transfer:string,focal_length:double,aperture:double,gps:{_PLACE},n_track_points:bigint,is_drone:boolean")
    out = _attach(
        out, None if sony is None else pick_candidate(sony, by_name), by_name, "_sony",
        f"make:string,model:string,gps:{_PLACE},transfer:string,primaries:string,matrix:string,lut_file:string,"
        "focal_length:double,focal_length_35mm:double,aperture:double,focus_distance:double,iris:string")
    out = _attach(
        out, None if canon is None else pick_candidate(canon, by_name), by_name, "_canon",
        f"make:string,model:string,created_at:timestamp_ntz,gps:{_PLACE},is_canon:boolean")
    out = _attach(out, events, ["dir"], "_event", "latitude:double,longitude:double,reason:string,has_dashcam_event:boolean")

    srt_c, sony_c, canon_c, event_c = (F.col(c) for c in ("_srt", "_sony", "_canon", "_event"))
    no = F.lit(False)
    flagged = out.withColumns(
        {
            "has_drone_srt": F.coalesce(srt_c["is_drone"], no),
            "has_sony_xml": F.coalesce(sony_c["make"].contains("Sony"), no),
            "has_canon_xml": F.coalesce(canon_c["is_canon"], no),
            "has_dashcam_event": F.coalesce(event_c["has_dashcam_event"], no),
            "has_gps": srt_c["gps"].isNotNull() | F.col("gps").isNotNull(),
            "_embedded": F.when(
                sony_c.isNull() & tag("tags", "com.sony.bprl.mxf.nrtmetadata").isNotNull(),
                parse_embedded_xml(tag("tags", "com.sony.bprl.mxf.nrtmetadata"))),
        }
    )
    named = attribute_device(flagged, book)

    def device(source: Column) -> Column:
        """Make and model of a source that has either."""
        pair = F.struct(source["make"].alias("make"), source["model"].alias("model"))
        return F.when(source["make"].isNotNull() | source["model"].isNotNull(), pair)

    own = F.struct("make", "model")
    best = F.coalesce(
        _when("sony", F.coalesce(device(sony_c), device(F.col("_embedded")))), _when("canon", device(canon_c)), own
    )
    at_event = F.struct(
        event_c["latitude"].alias("latitude"), event_c["longitude"].alias("longitude"), F.lit(None).cast("double").alias("altitude")
    )
    place = F.coalesce(
        _when("dji", srt_c["gps"]), _when("sony", sony_c["gps"]), _when("canon", canon_c["gps"]),
        _when("tesla", F.when(event_c["latitude"].isNotNull(), at_event)),
        _when("apple", parse_iso6709(tag("tags", "com.apple.quicktime.location.iso6709"))), F.col("gps"),
    )
    mode = F.coalesce(srt_c["transfer"], comment_color(tag("tags", "comment")))
    none = F.lit(None).cast("string")
    drone_color = F.when(mode.isNotNull(), F.struct(mode.alias("transfer"), none.alias("primaries"), none.alias("matrix")))
    sony_color = F.when(
        F.coalesce(sony_c["transfer"], sony_c["primaries"], sony_c["matrix"], sony_c["lut_file"]).isNotNull(),
        F.struct(sony_c["transfer"].alias("transfer"), sony_c["primaries"].alias("primaries"), sony_c["matrix"].alias("matrix")),
    )
    color = F.coalesce(_when("dji", drone_color), _when("sony", sony_color), F.col("color_space").cast(_COLOR))
    from_name = date_from_filename("file_id").cast("timestamp_ntz")
    created = F.coalesce("created_at", _when("canon", F.coalesce(canon_c["created_at"], from_name)))
    described = named.withColumns(
        {
            "_device": best, "gps": place, "color_space": color, "created_at": created,
            "lut_file": _when("sony", sony_c["lut_file"]),
            "focal_length": F.coalesce(_when("dji", srt_c["focal_length"]), _when("sony", sony_c["focal_length"])),
            "aperture": F.coalesce(_when("dji", srt_c["aperture"]), _when("sony", sony_c["aperture"])),
            "lens_model": _when("sony", F.col("_embedded")["lens_model"]),
            "n_track_points": F.coalesce(_when("dji", srt_c["n_track_points"]), F.lit(0)),
        }
    )
    described = described.withColumns({"make": F.col("_device.make"), "model": F.col("_device.model")})
    return described.drop(
        "tags", "streams", "dir", "stem", "_srt", "_sony", "_canon", "_event", "_embedded", "_device",
        "has_drone_srt", "has_sony_xml", "has_canon_xml", "has_dashcam_event", "has_gps",
    )
