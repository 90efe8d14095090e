"""Reading tags, streams and sidecar text of probe documents."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rushes.functions.media import none_if_empty


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tag(tags: Column | str, *names: str) -> Column:
    """First non-empty value among tag names; ``tags`` has lower-case keys."""
    t = _c(tags)
    return F.coalesce(*[none_if_empty(F.try_element_at(t, F.lit(n))) for n in names])


def first_stream(streams: Column | str, kind: str) -> Column:
    return F.get(F.filter(_c(streams), lambda s: s["codec_type"] == kind), F.lit(0))


def video_streams(streams: Column | str) -> Column:
    return F.filter(_c(streams), lambda s: s["codec_type"] == "video")


# --- time ------------------------------------------------------------------------------------------------

_DAY, _CLOCK = r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}:\d{1,2}:\d{1,2}"
# Date layouts that are rewritten as year-month-day, each with its replacement.
_LAYOUTS = [
    (rf"^(\d{{4}})([:/])(\d{{1,2}})\2(\d{{1,2}}) (?={_CLOCK})", "$1-$3-$4 "),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) (?={_CLOCK})", "$3-$2-$1 "),
]


def parse_time(text: Column | str) -> Column:
    """Timestamp without zone from the date formats cameras write; an offset is removed, not applied.

    Fractions count only in the ``T`` form; a bare or otherwise unreadable time leaves the date.
    """
    plain = F.regexp_replace(F.trim(_c(text)), r"[+-]\d{2}:?\d{2}$", "")

    def read(p: Column) -> Column:
        iso = p
        for pattern, replacement in _LAYOUTS:
            iso = F.regexp_replace(iso, pattern, replacement)
        full = F.regexp_extract(iso, rf"^{_DAY}(?:T{_CLOCK}(?:\.\d{{1,6}}(?=Z*$))?| {_CLOCK})", 0)
        day = F.regexp_extract(p, f"^{_DAY}", 0)
        return F.coalesce(full.try_cast("timestamp_ntz"), day.try_cast("date").cast("timestamp_ntz"))

    return let(plain, read)


def creation_time(tags: Column | str, stream_tags: Column | str | None = None) -> Column:
    """Recording time from format tags, then from video-stream tags (both with lower-case keys)."""
    text = tag(
        tags, "creation_time", "date", "com.apple.quicktime.creationdate", "date_recorded", "date-eng",
        "modification_date",
    )
    if stream_tags is not None:
        text = F.coalesce(text, tag(stream_tags, "creation_time", "date"))
    return parse_time(text)


def timecode(tags: Column | str, streams: Column | str) -> Column:
    """Start timecode: format tag, video-stream tag, then the first stream that has one.

    Stream tags have lower-case keys.
    """
    coded = F.filter(
        F.transform(_c(streams), lambda s: tag(s["tags"], "timecode")), lambda x: x.isNotNull()
    )
    return F.coalesce(
        tag(tags, "timecode"), tag(first_stream(streams, "video")["tags"], "timecode"), F.get(coded, F.lit(0))
    )


# --- place -----------------------------------------------------------------------------------------------

def parse_iso6709(text: Column | str) -> Column:
    """Struct ``latitude, longitude, altitude`` from signed numbers such as ``+59.74+010.20+125.0/``."""
    found = F.regexp_extract_all(_c(text), F.lit(r"([+-]\d+\.?\d*)"), F.lit(1))

    def place(numbers: Column) -> Column:
        number = [F.get(numbers, F.lit(i)).try_cast("double") for i in range(3)]
        return F.when(
            F.size(numbers) >= 2,
            F.struct(number[0].alias("latitude"), number[1].alias("longitude"), number[2].alias("altitude")),
        )

    return let(found, place)


def dms_to_decimal(text: Column | str, ref: Column | str) -> Column:
    """``degrees;minutes;seconds`` to degrees, negative for S and W.

    Anything but three parts is read as a plain number, whose sign the hemisphere does not change.
    """
    t = _c(text)
    parts = F.split(F.replace(t, F.lit(":"), F.lit(";")), ";")
    number = [F.get(parts, F.lit(i)).try_cast("double") for i in range(3)]
    degrees = number[0] + number[1] / 60 + number[2] / 3600
    signed = F.when(_c(ref).isin("S", "W"), -degrees).otherwise(degrees)
    return F.when(F.size(parts) == 3, signed).otherwise(t.try_cast("double"))


def gps_from_tags(tags: Column | str) -> Column:
    """Struct ``latitude, longitude, altitude`` from location tags, else from separate tags; altitude 0 is null."""
    coded = parse_iso6709(tag(tags, "location", "com.apple.quicktime.location.iso6709", "gps"))
    lat = tag(tags, "gps_latitude", "location-latitude").try_cast("double")
    lon = tag(tags, "gps_longitude", "location-longitude").try_cast("double")
    raw_altitude = F.try_element_at(_c(tags), F.lit("gps_altitude"))
    altitude = raw_altitude.try_cast("double")
    readable = raw_altitude.isNull() | altitude.isNotNull()
    separate = F.struct(
        lat.alias("latitude"), lon.alias("longitude"), F.nullif(altitude, F.lit(0.0)).alias("altitude")
    )
    return F.coalesce(coded, F.when(lat.isNotNull() & lon.isNotNull() & readable, separate))


def valid_gps(lat: Column | str, lon: Column | str) -> Column:
    """Coordinates in range with a latitude other than 0."""
    return _c(lat).between(-90, 90) & _c(lon).between(-180, 180) & (_c(lat) != 0)


# --- picture ---------------------------------------------------------------------------------------------

def color_space(stream: Column | str, tags: Column | str) -> Column:
    """Struct ``transfer, primaries, matrix``; a custom-gamma tag names the transfer; null when all are."""
    s = _c(stream)
    gamma = F.element_at(F.split(tag(tags, "com.apple.proapps.customgamma"), r"\."), -1)
    transfer = F.coalesce(gamma, s["color_transfer"])
    any_set = [none_if_empty(x).isNotNull() for x in (transfer, s["color_primaries"], s["color_space"])]
    return F.when(
        any_set[0] | any_set[1] | any_set[2],
        F.struct(transfer.alias("transfer"), s["color_primaries"].alias("primaries"), s["color_space"].alias("matrix")),
    )


def stereo_mode(streams: Column | str, tags: Column | str) -> Column:
    """``mvc``, ``side_by_side``, ``top_bottom`` or null."""
    videos = video_streams(streams)
    a, b = F.get(videos, F.lit(0)), F.get(videos, F.lit(1))
    paired = (
        (a["codec_name"] == "h264") & (b["codec_name"] == "h264")
        & (F.coalesce(a["width"], F.lit(0)) > 0) & (F.coalesce(b["width"], F.lit(0)) == 0)
    )
    mode = F.lower(tag(tags, "stereo_mode", "stereo3d"))
    return (
        F.when((F.size(videos) >= 2) & paired, "mvc")
        .when(mode.rlike("side|sbs"), "side_by_side")
        .when(mode.rlike("top|over|tab"), "top_bottom")
    )


# --- embedded and sidecar XML ----------------------------------------------------------------------------

# Each text is parsed once, in an Arrow function that reads out what is needed; XPath functions of SQL would parse it once
# for each path.  A text that is no XML gives nulls.

def _by_name(el: ET.Element) -> dict[str, list[ET.Element]]:
    """An element and those below it by their local names, in document order."""
    found: dict[str, list[ET.Element]] = {}
    for e in el.iter():
        found.setdefault(e.tag.rpartition("}")[2], []).append(e)
    return found


def _attribute(elements: list[ET.Element], key: str) -> str | None:
    """An attribute of the first element that has it."""
    return next((e.get(key) for e in elements if e.get(key) is not None), None) or None


def _text(el: ET.Element | None) -> str | None:
    return "".join(el.itertext()) or None if el is not None else None


def _items(elements: list[ET.Element]) -> list[dict[str, str]]:
    """``{name, value}`` of the elements that have both."""
    return [{"name": e.get("name"), "value": e.get("value")} for e in elements if e.get("name") is not None and e.get("value") is not None]


def _read_all(xml: pa.Array, read: Callable[[ET.Element], dict], fields: T.StructType) -> pa.Array:
    out = []
    for text in xml.to_pylist():
        try:
            out.append(read(ET.fromstring(text)) if text else {})
        except ET.ParseError:
            out.append({})
    return pa.array(out, to_arrow_type(fields))


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


_ITEMS = T.ArrayType(_strings("name", "value"))
_EMBEDDED = _strings("make", "model", "serial_number", "lens_model")
_SONY = T.StructType([*_strings("make", "model", "lut_file").fields, T.StructField("items", _ITEMS), T.StructField("gps", _ITEMS)])
_CANON = _strings("manufacturer", "model", "creation", "start", "date", "latitude", "longitude", "altitude")


def _embedded(root: ET.Element) -> dict:
    found = _by_name(root)
    device = found.get("Device", [])
    return {
        "make": _attribute(device, "manufacturer"), "model": _attribute(device, "modelName"),
        "serial_number": _attribute(device, "serialNo"), "lens_model": _attribute(found.get("Lens", []), "modelName"),
    }


def _sony(root: ET.Element) -> dict:
    found = _by_name(root)
    device, groups = found.get("Device", []), found.get("Group", [])
    place = next((g for kind in ("ExifGPS", "GPSinExif") for g in groups if g.get("name") == kind), None)
    below = _by_name(place).get("Item", []) if place is not None else []
    return {
        "make": _attribute(device, "manufacturer"), "model": _attribute(device, "modelName"),
        "lut_file": _attribute([e for e in found.get("RelatedTo", []) if e.get("rel") == "LUT"], "file"),
        "items": _items(found.get("Item", [])), "gps": _items(below),
    }


def _canon(root: ET.Element) -> dict:
    found = _by_name(root)

    def first(name: str) -> ET.Element | None:
        return found[name][0] if name in found else None

    def inside(parent: str, name: str) -> str | None:
        """The text of the first child with a name in the first element with the parent's."""
        children = first(parent) if parent in found else ()
        return _text(next((c for c in children if c.tag.rpartition("}")[2] == name), None))

    return {
        "manufacturer": inside("Device", "Manufacturer"), "model": inside("Device", "ModelName"), "creation": _text(first("CreationDate")),
        "start": _text(first("StartDate")), "date": _text(first("Date")), "latitude": inside("Location", "Latitude"),
        "longitude": inside("Location", "Longitude"), "altitude": inside("Location", "Altitude"),
    }


def _reader(read: Callable[[ET.Element], dict], fields: T.StructType) -> Callable[[Column], Column]:
    def run(xml: pa.Array) -> pa.Array:
        return _read_all(xml, read, fields)

    return F.arrow_udf(run, fields)


def parse_embedded_xml(text: Column | str) -> Column:
    """Struct ``make, model, serial_number, lens_model`` of an XML fragment in a tag."""
    t = F.trim(_c(text))
    xml = F.when(t.startswith("<?xml"), t).otherwise(F.concat(F.lit("<root>"), t, F.lit("</root>")))
    return _reader(_embedded, _EMBEDDED)(xml)


def _position(lat: Column, lon: Column, altitude: Column, valid: Column | None = None) -> Column:
    """Struct of a position whose parts are computed once; null unless both coordinates are readable."""
    parts = F.struct(
        lat.alias("latitude"), lon.alias("longitude"), altitude.alias("altitude"),
        (F.lit(True) if valid is None else valid).alias("valid"),
    )

    def build(p: Column) -> Column:
        height = p["altitude"].try_cast("double")
        readable = p["altitude"].isNull() | height.isNotNull()
        known = p["latitude"].isNotNull() & p["longitude"].isNotNull() & p["valid"]
        place = F.struct(
            p["latitude"].alias("latitude"), p["longitude"].alias("longitude"), height.alias("altitude")
        )
        return F.when(known & readable, place)

    return let(parts, build)


def parse_sony_xml(xml: Column | str) -> Column:
    """Struct of device, place, colour and lens of a professional-disc sidecar.

    Of repeated items the last counts; of the two names for the position group, the first that exists.
    """
    def build(s: Column) -> Column:
        def value(items: str, name: str) -> Column:
            named = F.filter(s[items], lambda i: i["name"] == name)
            return none_if_empty(F.try_element_at(named, F.lit(-1))["value"])

        def item(name: str) -> Column:
            return value("items", name)

        def angle(name: str) -> Column:
            pair = F.struct(value("gps", name).alias("text"), value("gps", f"{name}Ref").alias("ref"))
            return let(pair, lambda p: dms_to_decimal(p["text"], p["ref"]))

        valid = F.coalesce(value("gps", "Status") != "V", F.lit(True))
        focal_35mm = F.coalesce(item("FocalLength35mm"), item("FocalLengthIn35mmFilm"))
        return F.struct(
            s["make"].alias("make"),
            s["model"].alias("model"),
            _position(angle("Latitude"), angle("Longitude"), value("gps", "Altitude"), valid).alias("gps"),
            item("CaptureGammaEquation").alias("transfer"),
            item("CaptureColorPrimaries").alias("primaries"),
            item("CodingEquations").alias("matrix"),
            s["lut_file"].alias("lut_file"),
            item("FocalLength").try_cast("double").alias("focal_length"),
            focal_35mm.try_cast("double").alias("focal_length_35mm"),
            item("FNumber").try_cast("double").alias("aperture"),
            item("FocusDistance").try_cast("double").alias("focus_distance"),
            item("Iris").alias("iris"),
        )

    return let(_reader(_sony, _SONY)(_c(xml)), build)


# A root element in the maker's namespace.
_CANON_ROOT = r"(?i)^(?:\s*<[?!][^>]*>)*\s*<[^>]*canon\.com"


def parse_canon_xml(xml: Column | str) -> Column:
    """Struct ``make, model, created_at, gps`` of a clip sidecar with element texts."""
    x = _c(xml)

    def when(text: Column) -> Column:
        def read(text: Column) -> Column:
            day = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
            return F.when(text.contains("T") | day, parse_time(F.regexp_replace(text, "Z$", "")))

        return let(F.trim(text), read)

    s = _reader(_canon, _CANON)(x)
    return F.struct(
        s["manufacturer"].alias("make"),
        s["model"].alias("model"),
        F.coalesce(when(s["creation"]), when(s["start"]), when(s["date"])).alias("created_at"),
        _position(s["latitude"].try_cast("double"), s["longitude"].try_cast("double"), s["altitude"]).alias("gps"),
        F.coalesce(x.rlike(_CANON_ROOT) | s["manufacturer"].contains("Canon"), x.rlike(_CANON_ROOT), F.lit(False)).alias("is_canon"),
    )


# --- subtitle telemetry ----------------------------------------------------------------------------------

def srt_blocks(text: Column | str) -> Column:
    """Subtitle blocks, separated by blank lines."""
    return F.split(_c(text), r"\n\n+")


def _first(block: Column, pattern: str, group: int = 1) -> Column:
    return none_if_empty(F.regexp_extract(block, pattern, group))


def block_time(block: Column | str) -> Column:
    """Start of a subtitle block in seconds, null without one."""
    return clock_seconds(block_clock(block))


def block_clock(block: Column | str) -> Column:
    """Start of a subtitle block as ``hh:mm:ss,mmm``, null without one."""
    return _first(_c(block), r"(\d{2}:\d{2}:\d{2},\d{3})\s*-->")


def clock_seconds(clock: Column | str) -> Column:
    """Seconds of ``hh:mm:ss,mmm``."""
    h, m, s, ms = [F.substring(_c(clock), at, n).try_cast("int") for at, n in ((1, 2), (4, 2), (7, 2), (10, 3))]
    return (h * 3600 + m * 60 + s + ms / 1000).cast("double")


def telemetry_point(block: Column | str) -> Column:
    """Struct of the telemetry a drone writes into one subtitle block."""
    return F.struct(*telemetry_columns(block))


def telemetry_columns(block: Column | str) -> list[Column]:
    """The telemetry of one subtitle block as columns, so that unused ones are never computed."""
    b = _c(block)
    shutter = _first(b, r"\[shutter:\s*1/([\d.]+)\]").try_cast("double")
    recorded = _first(b, r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)")
    return [
        parse_time(F.regexp_replace(recorded, r"\s+", "T")).alias("recorded_at"),
        _first(b, r"\[latitude:\s*([-\d.]+)\]").try_cast("double").alias("latitude"),
        _first(b, r"\[longitude:\s*([-\d.]+)\]").try_cast("double").alias("longitude"),
        _first(b, r"abs_alt:\s*([-\d.]+)").try_cast("double").alias("altitude"),
        _first(b, r"rel_alt:\s*([-\d.]+)").try_cast("double").alias("relative_altitude"),
        _first(b, r"\[iso:\s*(\d+)\]").try_cast("int").alias("iso"),
        (F.lit(1.0) / F.nullif(shutter, F.lit(0.0))).alias("shutter"),
        _first(b, r"\[fnum:\s*([\d.]+)\]").try_cast("double").alias("aperture"),
        _first(b, r"\[focal_len:\s*([\d.]+)\]").try_cast("double").alias("focal_length"),
        _first(b, r"\[color_md\s*:\s*(\w+)\]").alias("color_mode"),
    ]


def exposure_point(block: Column | str) -> Column:
    """Struct ``aperture, shutter, iso`` of an exposure subtitle such as ``F/1.8, SS 293.11, ISO 110``."""
    b = _c(block)
    speed = _first(b, r"SS\s+([\d.]+)").try_cast("double")
    return F.struct(
        _first(b, r"F/([\d.]+)").try_cast("double").alias("aperture"),
        (F.lit(1.0) / F.nullif(speed, F.lit(0.0))).alias("shutter"),
        _first(b, r"ISO\s+(\d+)").try_cast("int").alias("iso"),
    )


# --- decoded camera tags ---------------------------------------------------------------------------------

GPS_TAGS = {"lat_ref": 0xB1, "lat_deg": 0xB2, "lat_min": 0xB3, "lat_sec": 0xB4, "lon_ref": 0xB5, "lon_deg": 0xB6,
            "lon_min": 0xB7, "lon_sec": 0xB8, "altitude": 0xBA, "status": 0xBE}
DATE_TAG, TIME_TAG = 0x18, 0x19
