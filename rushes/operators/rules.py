"""Device rules: which camera made a file.

A rule is a predicate and field expressions over a prepared probe row.  The ordered rules are compiled into
one ``CASE``; the first that holds names the row's rule, and the fields follow from that name.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushes.functions.media import file_name, none_if_empty, stem, suffix
from rushes.functions.tags import video_streams

FIELDS = ("make", "model", "software", "device_type", "confidence")
# Columns a sidecar join may provide; absent ones count as false.
SIDECAR_FLAGS = ("has_drone_srt", "has_canon_xml", "has_sony_xml", "has_dashcam_event", "has_gps")


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: Column
    fields: dict[str, Column] = field(default_factory=dict)


class RuleBook:
    """Rules in order of precedence, with the generic fallback last."""

    def __init__(self, rules: list[Rule]):
        self.rules = list(rules)

    def register(self, name: str, predicate: Column, fields: dict[str, Column]) -> RuleBook:
        """A new book with the rule added behind the existing ones and before the fallback."""
        unknown = set(fields) - set(FIELDS)
        if unknown:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        return RuleBook([*self.rules[:-1], Rule(name, predicate, fields), self.rules[-1]])

    def names(self) -> list[str]:
        return [r.name for r in self.rules]


def _any(conditions: list[Column]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, conditions), F.lit(False))


def _t(*names: str) -> Column:
    """First non-empty of the named tags, as one parsed expression: rules read dozens of tags."""
    return F.expr("coalesce(" + ", ".join(f"nullif(try_element_at(tags, '{n}'), '')" for n in names) + ")")


def _upper_has(value: Column, *words: str) -> Column:
    return F.coalesce(F.upper(value).rlike("|".join(words)), F.lit(False))


def _stream_tag(name: str) -> Column:
    """Values of a tag over all streams."""
    found = F.transform("streams", lambda s: none_if_empty(F.try_element_at(s["tags"], F.lit(name))))
    return F.filter(found, lambda v: v.isNotNull())


def prepare(df: DataFrame) -> DataFrame:
    """Add what the rules read.  ``df`` has ``file_id`` (a path), ``tags`` and ``streams`` with lower-case tag keys."""
    for flag in SIDECAR_FLAGS:
        if flag not in df.columns:
            df = df.withColumn(flag, F.lit(False))
    values = F.concat(
        F.map_values("tags"), F.flatten(F.transform("streams", lambda s: F.coalesce(F.map_values(s["tags"]), F.array().cast("array<string>"))))
    )
    return df.withColumns(
        {
            "_name": file_name("file_id"),
            "_suffix": F.coalesce(suffix("file_id"), F.lit("")),
            "_stem": stem("file_id"),
            "_parts": F.split(F.upper("file_id"), "/"),
            "_all_values": F.lower(F.array_join(values, " ")),
            "_handlers": _stream_tag("handler_name"),
            "_stream_encoders": _stream_tag("encoder"),
            "_videos": video_streams("streams"),
            "_encoder": F.coalesce(_t("encoder"), F.lit("")),
        }
    )


# --- fixed values ----------------------------------------------------------------------------------------

ARRI_MODELS = {
    "alexa35": "ALEXA 35", "alexa 35": "ALEXA 35", "alexamini": "ALEXA Mini", "alexa mini": "ALEXA Mini",
    "minilf": "ALEXA Mini LF", "mini lf": "ALEXA Mini LF", "alexalf": "ALEXA LF", "alexa lf": "ALEXA LF",
    "alexa65": "ALEXA 65", "alexa 65": "ALEXA 65", "amira": "AMIRA", "alexa": "ALEXA",
}
PANORAMA_PATTERNS = [
    "INS", "Insta360", "Q360_", "QooCam", "Kandao", "GoPro MAX", "GPMAX", "RICOH THETA", "THETA", "Gear 360",
    "SM-R210", "SM-C200",
]
PANORAMA_SUFFIXES = {"insv": "Insta360", "insp": "Insta360", "360": "GoPro"}
PANORAMA_KEYS = ["spherical", "spherical-video", "projection_type", "stereo_mode", "stitching_software"]
DRONE_WORDS = ["mavic", "phantom", "inspire", "mini", "air", "fpv", "avata", "matrice", "agras"]
GIMBAL_WORDS = ["pocket", "osmo", "action", "ronin"]
GOPRO_FIRMWARE = {
    "HD5": "HERO5 Black", "HD6": "HERO6 Black", "HD7": "HERO7 Black", "HD8": "HERO8 Black", "HD9": "HERO9 Black",
    "H10": "HERO10 Black", "H11": "HERO11 Black", "H12": "HERO12 Black", "H13": "HERO13 Black",
    "H21": "HERO Session", "H22": "HERO5 Session", "HX": "MAX", "H19": "MAX", "FS": "Fusion",
}
DRONE_MAKERS = ["DJI", "PARROT", "AUTEL", "SKYDIO", "YUNEEC", "GOPRO KARMA"]
DASHCAM_NAME = r"^\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}-(front|back|left_repeater|right_repeater)\.mp4$"
DASHCAM_VIEWS = {"-front": "front", "-back": "rear", "-left_repeater": "left", "-right_repeater": "right"}


def _case(pairs: list[tuple[Column, str | Column]], otherwise: Column | str | None = None) -> Column:
    out = None
    for cond, value in pairs:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def _device(make, model, kind, confidence=1.0, software=None) -> dict[str, Column]:
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v).cast("string")

    return {
        "make": lit(make), "model": lit(model), "software": lit(software), "device_type": lit(kind),
        "confidence": F.lit(float(confidence)),
    }


# --- rules -----------------------------------------------------------------------------------------------

def rule_apple() -> Rule:
    model = _t("com.apple.quicktime.model", "model")
    seen = _t("model", "com.apple.quicktime.model")
    branded = _t("com.apple.quicktime.make", "com.apple.quicktime.model").isNotNull()
    predicate = _any(
        [
            _upper_has(_t("make", "com.apple.quicktime.make"), "APPLE"),
            _upper_has(seen, "IPHONE", "IPAD"),
            _t("com.apple.quicktime.creationdate").isNotNull() & branded,
        ]
    )
    kind = F.when(_upper_has(model, "MAC") & ~_upper_has(model, "IPHONE", "IPAD"), "camera").otherwise("phone")
    make = F.coalesce(_t("com.apple.quicktime.make", "make"), F.lit("Apple"))
    return Rule("apple", predicate, _device(make, model, kind, software=_t("com.apple.quicktime.software", "software")))


def rule_arri() -> Rule:
    text = F.col("_all_values")
    model = _case([(text.contains(k), v) for k, v in ARRI_MODELS.items()])
    predicate = _any([F.col("_suffix").isin("ari", "arx"), text.contains("arri")])
    return Rule("arri", predicate, _device("ARRI", model, "cinema_camera"))


def rule_blackmagic() -> Rule:
    predicate = _any(
        [
            F.col("_suffix") == "braw",
            _upper_has(_t("com.apple.proapps.manufacturer"), "BLACKMAGIC"),
            _upper_has(_t("make", "manufacturer"), "BLACKMAGIC"),
            _upper_has(_t("com.apple.proapps.customgamma"), "BLACKMAGIC"),
        ]
    )
    make = F.coalesce(_t("com.apple.proapps.manufacturer", "make"), F.lit("Blackmagic Design"))
    model = _t("com.apple.proapps.cameraname", "model")
    return Rule("blackmagic", predicate, _device(make, model, "cinema_camera", software=_t("software")))


def _insta_model() -> Column:
    """Model by the size of the first video stream that is large enough for one."""
    def at_least(n):
        return F.exists("_videos", lambda s: (s["width"] >= n) | (s["height"] >= n))

    first = F.get(
        F.filter(F.transform("_videos", lambda s: F.greatest(s["width"], s["height"])), lambda x: x >= 1920), F.lit(0)
    )
    return F.when(at_least(1920), _case([(first >= 3840, "X3/X4"), (first >= 2880, "ONE RS")], "ONE X/X2"))


def _qoocam_model() -> Column:
    wide = F.get(F.filter("_videos", lambda s: s["width"] >= 2880), F.lit(0))
    return _case(
        [
            ((wide["width"] >= 3840) & (wide["codec_name"] == "hevc"), "8K"),
            (wide["width"] >= 3840, "8K/3"),
            (wide["width"] >= 2880, "3"),
        ]
    )


def rule_camera_360() -> Rule:
    pattern = "(?i)" + "|".join(PANORAMA_PATTERNS)
    make, model = _t("make", "manufacturer"), _t("model")
    squares = F.size(F.filter("_videos", lambda s: (s["width"] > 0) & (s["width"] == s["height"])))
    side_data = F.exists(
        "streams", lambda s: F.coalesce(F.lower(s["side_data"]).contains("spherical"), F.lit(False))
    )
    predicate = _any(
        [
            F.col("_suffix").isin(list(PANORAMA_SUFFIXES)),
            F.col("_name").rlike(pattern),
            F.concat_ws(" ", make, model).rlike(pattern),
            F.exists("_handlers", lambda h: h.rlike(pattern)),
            F.arrays_overlap(F.map_keys("tags"), F.array(*[F.lit(k) for k in PANORAMA_KEYS])),
            side_data,
            squares >= 2,
        ]
    )
    by_suffix = _case([(F.col("_suffix") == s, b) for s, b in PANORAMA_SUFFIXES.items()])
    in_name = F.col("_name").contains("Q360_")
    insta_handler = F.exists("_handlers", lambda h: F.upper(h).contains("INS"))
    brand = _case(
        [
            (_upper_has(make, "INSTA"), "Insta360"), (_upper_has(make, "GOPRO"), "GoPro"),
            (_upper_has(make, "RICOH", "THETA"), "Ricoh"), (_upper_has(make, "SAMSUNG"), "Samsung"),
            (_upper_has(make, "KANDAO", "QOOCAM"), "Kandao"),
        ],
        make,
    )
    by_brand = _case(
        [
            (brand == "Insta360", F.coalesce(model, _insta_model())), (brand == "GoPro", F.coalesce(model, F.lit("MAX"))),
            (brand == "Kandao", F.coalesce(model, _qoocam_model())),
        ],
        model,
    )
    out_make = _case(
        [
            (by_suffix.isNotNull(), by_suffix), (in_name, "Kandao"), (make.isNotNull(), brand),
            (insta_handler, "Insta360"),
        ],
        F.lit("Unknown 360 Camera"),
    )
    out_model = _case(
        [
            (by_suffix == "Insta360", _insta_model()), (by_suffix.isNotNull(), F.lit(None).cast("string")),
            (in_name, _qoocam_model()), (make.isNotNull(), by_brand), (insta_handler, _insta_model()),
        ]
    )
    software = F.when(squares >= 2, "unstitched dual-fisheye")
    return Rule("camera_360", predicate, _device(out_make, out_model, "360_camera", software=software))


def rule_canon() -> Rule:
    predicate = _any([_upper_has(_t("make", "manufacturer", "company_name"), "CANON"), F.col("has_canon_xml")])
    make = F.coalesce(_t("make", "manufacturer"), F.lit("Canon"))
    return Rule("canon", predicate, _device(make, _t("model", "model_name"), "camera", software=_t("software")))


def drone_model(encoder: Column | str) -> Column:
    """Model in an encoder name: prefix removed, spaces before numbers and inner capitals."""
    e = F.col(encoder) if isinstance(encoder, str) else encoder
    bare = F.trim(F.regexp_replace(e, "(?i)^DJI", ""))
    spaced = F.regexp_replace(F.regexp_replace(bare, r"(\D)(\d)", "$1 $2"), "([a-z])([A-Z])", "$1 $2")
    return none_if_empty(F.trim(spaced))


def comment_color(comment: Column | str) -> Column:
    """Colour mode after ``DE=`` in a comment tag."""
    c = F.col(comment) if isinstance(comment, str) else comment
    mode = none_if_empty(F.trim(F.regexp_extract(c, "DE=([^,]+)", 1)))
    return _case([(F.lower(mode) == "d-clike", "D-Cinelike"), (F.lower(mode) == "d-log", "D-Log")], mode)


def rule_dji() -> Rule:
    encoder = F.col("_encoder")
    video_handlers = F.transform("_videos", lambda s: F.upper(F.try_element_at(s["tags"], F.lit("handler_name"))))
    predicate = _any(
        [
            _upper_has(_t("make", "manufacturer"), "DJI"),
            F.upper(encoder).startswith("DJI"),
            F.exists(video_handlers, lambda h: F.coalesce(h.contains("DJI"), F.lit(False))),
            F.upper("_name").startswith("DJI_"),
            F.col("has_drone_srt"),
        ]
    )
    model = F.coalesce(_t("model", "model_name"), F.when(F.upper(encoder).startswith("DJI"), drone_model(encoder)))
    by_gps = F.when(F.col("has_gps"), "drone").otherwise("action_camera")
    kind = _case(
        [(F.lower(model).rlike("|".join(GIMBAL_WORDS)), "action_camera"), (F.lower(model).rlike("|".join(DRONE_WORDS)), "drone")],
        by_gps,
    )
    make = F.coalesce(_t("make", "manufacturer"), F.lit("DJI"))
    return Rule("dji", predicate, _device(make, model, kind, software=_t("software")))


def rule_dv() -> Rule:
    encoder = F.lower("_encoder")

    def is_tape(s: Column) -> Column:
        named = F.exists(F.map_values(s["tags"]), lambda v: F.lower(v).contains("hdv"))
        hdv = (F.lower(s["codec_name"]) == "mpeg2video") & (encoder.contains("hdv") | F.coalesce(named, F.lit(False)))
        return F.coalesce((F.lower(s["codec_name"]) == "dvvideo") | hdv, F.lit(False))

    first = F.get("_videos", F.lit(0))
    codec, w, h = F.lower(first["codec_name"]), first["width"], first["height"]
    hdv_format = _case(
        [
            (F.col("_encoder").contains("1080"), "HDV 1080i"), (F.col("_encoder").contains("720"), "HDV 720p"),
            ((w == 1440) & (h == 1080), "HDV 1080i"), ((w == 1280) & (h == 720), "HDV 720p"),
        ],
        F.lit("HDV"),
    )
    name = _case(
        [
            ((codec == "dvvideo") & (h == 576), "DV PAL"), ((codec == "dvvideo") & (h == 480), "DV NTSC"),
            (codec == "mpeg2video", hdv_format),
        ],
        F.lit("DV"),
    )
    return Rule("dv", F.exists("_videos", is_tape), _device(None, F.concat(name, F.lit(" Camcorder")), "camera", 0.9))


def rule_ffmpeg() -> Rule:
    encoder = F.col("_encoder")
    return Rule("ffmpeg", encoder.startswith("Lavf"), _device("FFmpeg", encoder, "unknown", 0.8, encoder))


def rule_gopro() -> Rule:
    firmware = _t("firmware")
    model = _case([(F.upper(firmware).startswith(p), m) for p, m in GOPRO_FIRMWARE.items()])
    predicate = _any(
        [
            model.isNotNull(),
            F.exists("_handlers", lambda h: h.contains("GoPro")),
            F.exists("_stream_encoders", lambda h: h.contains("GoPro")),
            F.upper("_stem").rlike("^(GH|GX|GOPR)"),
        ]
    )
    kind = F.when(F.coalesce(model.contains("MAX"), F.lit(False)), "360_camera").otherwise("action_camera")
    return Rule("gopro", predicate, _device("GoPro", model, kind, software=firmware))


def rule_red() -> Rule:
    in_folder = F.exists("_parts", lambda p: p.rlike(r"\.(RDM|RDC)$"))
    return Rule("red", _any([F.col("_suffix") == "r3d", in_folder]), _device("RED", None, "cinema_camera", 0.8))


def rule_sony() -> Rule:
    parts = F.col("_parts")
    in_card = F.array_contains(parts, "AVCHD") & F.array_contains(parts, "BDMV") & F.array_contains(parts, "STREAM")
    predicate = _any(
        [
            _upper_has(_t("make", "manufacturer"), "SONY"),
            F.upper(_t("major_brand")) == "XAVC",
            F.array_contains(F.map_keys("tags"), "com.sony.bprl.mxf.nrtmetadata"),
            F.col("_suffix").isin("mts", "m2ts") & in_card,
            F.col("has_sony_xml"),
        ]
    )
    make = F.coalesce(_t("make", "manufacturer"), F.lit("Sony"))
    return Rule("sony", predicate, _device(make, _t("model", "model_name"), "camera", software=_t("software")))


def rule_tesla() -> Rule:
    view = _case([(F.lower("_name").contains(k), v) for k, v in DASHCAM_VIEWS.items()])
    model = F.when(view.isNull(), "Dashcam").otherwise(F.concat(F.lit("Dashcam ("), view, F.lit(")")))
    predicate = _any([F.col("_name").rlike(DASHCAM_NAME), F.col("has_dashcam_event")])
    return Rule("tesla", predicate, _device("Tesla", model, "dashcam"))


def rule_generic() -> Rule:
    make = _t("make", "manufacturer", "com.apple.quicktime.make", "com.apple.proapps.manufacturer")
    model = _t("model", "model_name", "com.apple.quicktime.model", "com.apple.proapps.cameraname")
    encoder = F.col("_encoder")
    coded = make.isNull() & model.isNull() & F.upper(encoder).startswith("DJI")
    make = F.when(coded, "DJI").otherwise(make)
    model = F.when(coded, F.when(F.length(encoder) > 3, F.substring(encoder, 4, 1000)).otherwise(encoder)).otherwise(model)
    known = make.isNotNull() | model.isNotNull()
    kind = _case(
        [
            (F.upper(make).isin(DRONE_MAKERS), "drone"), (_upper_has(make, "GOPRO"), "action_camera"),
            (_upper_has(model, "IPHONE", "IPAD", "PIXEL", "GALAXY"), "phone"),
            (_upper_has(model, "GOPRO", "HERO", "OSMO", "ACTION"), "action_camera"),
        ],
        F.lit("camera"),
    )
    fields = _device(make, model, kind, 0.8, _t("software", "com.apple.quicktime.software"))
    return Rule("generic", F.lit(True), {k: F.when(known, v) for k, v in fields.items()})


def default_rules() -> RuleBook:
    return RuleBook(
        [
            rule_apple(), rule_arri(), rule_blackmagic(), rule_camera_360(), rule_canon(), rule_dji(), rule_dv(),
            rule_ffmpeg(), rule_gopro(), rule_red(), rule_sony(), rule_tesla(), rule_generic(),
        ]
    )


def attribute_device(probe: DataFrame, book: RuleBook | None = None) -> DataFrame:
    """Add ``rule`` and the device fields of the first rule that holds.

    A narrow map over probe rows: no join, no shuffle.
    """
    book = book or default_rules()
    columns = [c for c in probe.columns if c not in ("rule", *FIELDS)]
    named = prepare(probe).withColumn(
        "rule", _case([(F.coalesce(r.predicate, F.lit(False)), r.name) for r in book.rules])
    )
    out = {}
    for name in FIELDS:
        out[name] = _case([(F.col("rule") == r.name, r.fields[name]) for r in book.rules if name in r.fields])
    return named.withColumns(out).select(*columns, "rule", *FIELDS)
