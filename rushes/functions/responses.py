"""Model responses: repairing almost-JSON text, reading it, and recovering what is left of a broken one.

Built-in expressions only, in named steps, so that each text is repaired and parsed once per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# Patterns and replacements, applied in this order.
REPAIRS = [
    (r"```json", ""),
    (r"```", ""),
    (r"^\s+|\s+$", ""),
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""),
    (r'\\":', '":'),
    (r'"\*+:', '":'),
    (r"(\w)\*+:", r'$1":'),
    (r"'(\w+)'(\s*):", r'"$1"$2:'),
    (r":\s*'([^']*)'", r': "$1"'),
    (r",(\s*[\]\}])", r"$1"),
]


def repair_json(text: Column | str) -> Column:
    """Strip fences and control characters, fix quoting of keys and values, drop trailing commas."""
    out = _c(text)
    for pattern, replacement in REPAIRS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def _between(text: Column, opening: str, closing: str) -> Column:
    """From the first ``opening`` to the last ``closing``; null without either."""
    start = F.instr(text, opening)
    length = F.length(text) - F.instr(F.reverse(text), closing) + 1 - start + 1
    return F.when((start > 0) & (F.instr(text, closing) > 0) & (length > 0), F.substring(text, start, length))


def _text(value: Column) -> Column:
    """A JSON string, or null for any other kind of value."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _filled(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _member(root: Column, name: str) -> Column:
    return F.try_variant_get(root, f"$.{name}", "variant")


def _object_name(item: Column) -> Column:
    """Name of an object given as a string or as ``{name}``, or ``{label}`` when the name is missing or empty."""
    name = _member(item, "name")
    missing = name.isNull() | F.schema_of_variant(name).isin("VOID") | (_text(name) == "")
    named = F.when(F.coalesce(missing, F.lit(False)), _text(_member(item, "label"))).otherwise(_text(name))
    return F.when(F.schema_of_variant(item).startswith("OBJECT"), named).otherwise(_text(item))


def _names(items: Column) -> Column:
    names = F.transform(items, _object_name)
    return F.filter(names, lambda n: n.isNotNull() & (F.length(n) < 100) & (F.trim(n) != ""))


_NO_NAMES = "array<string>"


def _answer(objects: Column, description: Column | None = None) -> Column:
    words = F.lit(None).cast("string") if description is None else description
    return F.struct(F.coalesce(objects, F.array().cast(_NO_NAMES)).alias("objects"), words.alias("description"))


def _parse_one(json: Column) -> Column:
    """The single JSON value in a text as a variant; null when there is none or something follows it."""
    wrapped = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), json, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(wrapped) == 1, F.get(wrapped, F.lit(0)))


def _with_root(df: DataFrame, response: str) -> DataFrame:
    """``_root``: the repaired text from its first to its last brace as a variant, null when that is no JSON."""
    fixed = df.withColumn("_fixed", repair_json(response))
    cut = fixed.withColumn("_json", _between(F.col("_fixed"), "{", "}"))
    return cut.withColumn("_root", _parse_one(F.col("_json"))).drop("_fixed", "_json")


def _description() -> Column:
    root = F.col("_root")
    parts = [_filled(_text(_member(root, k))) for k in ("action", "description", "continues")]
    change = F.concat(F.lit("Change: "), _filled(_text(_member(root, "change"))))
    return F.nullif(F.concat_ws(" ", *parts, change), F.lit(""))


def _parsed() -> Column:
    names = _names(F.try_variant_get(F.col("_root"), "$.objects", "array<variant>"))
    return F.when(F.col("_root").isNotNull(), _answer(names, _description()))


def parse_response(df: DataFrame, response: str = "response") -> DataFrame:
    """Add ``answer`` (``objects``, ``description``); null when the response is not valid JSON with an object root."""
    rooted = _with_root(df, response)
    return rooted.withColumn("answer", _parsed()).drop("_root")


def split_lines(text: Column | str) -> Column:
    """Names from plain text: short lines without brackets or colons, split at commas."""
    lines = F.split(_c(text), "\n")
    bare = F.transform(
        lines,
        lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.trim(s), r"^-+|-+$", ""), r"^\*+|\*+$", "")),
    )
    bare = F.filter(bare, lambda s: ~s.rlike(r'^$|^[{}]|^```|^"objects"'))
    # A fully quoted line loses its quotes, and then commas at its end.
    bare = F.transform(
        bare,
        lambda s: F.when(
            s.rlike(r'(?s)^".*"$') & (F.length(s) > 1), F.regexp_replace(F.regexp_replace(s, r'^"|"$', ""), r",+$", "")
        ).otherwise(s),
    )
    bare = F.filter(bare, lambda s: (F.length(s) <= 50) & ~s.contains("[") & ~s.contains(":"))
    pieces = F.flatten(F.transform(bare, lambda s: F.split(s, ",")))
    clean = F.transform(
        pieces, lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), r'^"+|"+$', ""), r"^'+|'+$", "")
    )
    return F.filter(clean, lambda p: (p != "") & (F.length(p) < 50))


def _with_traces(df: DataFrame, response: str) -> DataFrame:
    """What patterns find in a broken response: ``_named``, ``_listed``, ``_said``."""
    text = F.col(response)
    named = F.regexp_extract_all(text, F.lit(r'"name"\s*:\s*"([^"]+)"'), F.lit(1))
    inside = F.regexp_extract(text, r'"objects"\s*:\s*\[([^\]]*)', 1)
    listed = F.regexp_extract_all(inside, F.lit(r'"([^"]+)"'), F.lit(1))
    return df.withColumns(
        {
            "_named": F.filter(named, lambda n: (F.length(n) < 100) & (F.trim(n) != "")),
            "_listed": F.filter(
                listed, lambda i: (F.length(i) < 100) & (F.trim(i) != "") & ~i.isin("name", "color", "location")
            ),
            "_said": _filled(F.regexp_extract(text, r'"description["*]*\s*:\s*"([^"]+)"', 1)),
        }
    )


def _recovered() -> Column:
    return F.when(F.size("_named") > 0, _answer(F.col("_named"))).when(
        F.col("_said").isNotNull() | (F.size("_listed") > 0), _answer(F.col("_listed"), F.col("_said"))
    )


def recover_response(df: DataFrame, response: str = "response") -> DataFrame:
    """Add ``answer`` from a response that does not parse: names by pattern, else short lines."""
    traced = _with_traces(df, response)
    answer = F.coalesce(_recovered(), _answer(split_lines(response)))
    return traced.withColumn("answer", answer).drop("_named", "_listed", "_said")


def read_response(df: DataFrame, response: str = "response") -> DataFrame:
    """Add ``answer``: parsed if it can be, else recovered by pattern, else read like a single-frame response."""
    framed = parse_frame_response(df, response).withColumnRenamed("answer", "_framed")
    rooted = _with_traces(_with_root(framed, response), response)
    by_pattern = F.when(F.col(response).contains("{"), _recovered())
    out = rooted.withColumn("answer", F.coalesce(_parsed(), by_pattern, F.col("_framed")))
    return out.drop("_root", "_named", "_listed", "_said", "_framed")


def parse_frame_response(df: DataFrame, response: str = "response") -> DataFrame:
    """Add ``answer`` for a single-frame response with an object or array root.

    A description needs more than ten characters.  Text that is not JSON falls back to its lines.
    """
    fixed = df.withColumn("_fixed", repair_json(response))
    text = F.col("_fixed")
    bracket, brace = F.instr(text, "["), F.instr(text, "{")
    is_array = (bracket > 0) & ((brace == 0) | (bracket < brace))
    cut = fixed.withColumn("_json", F.when(is_array, _between(text, "[", "]")).otherwise(_between(text, "{", "}")))
    rooted = cut.withColumn("_root", _parse_one(F.col("_json")))
    root = F.col("_root")

    def long_text(value: Column) -> Column:
        words = _text(value)
        return F.when(F.length(words) > 10, F.trim(words))

    def read(item: Column) -> Column:
        names = _names(F.try_variant_get(item, "$.objects", "array<variant>"))
        return _answer(names, long_text(_member(item, "description")))

    items = F.try_variant_get(root, "$", "array<variant>")
    members = F.transform(F.filter(items, lambda i: F.schema_of_variant(i).startswith("OBJECT")), read)
    rooted = rooted.withColumn("_members", F.when(F.schema_of_variant(root).startswith("ARRAY"), members))
    words = F.filter(F.transform("_members", lambda m: m["description"]), lambda d: d.isNotNull())
    answer = (
        F.when(
            F.col("_members").isNotNull(),
            _answer(F.flatten(F.transform("_members", lambda m: m["objects"])), F.get(words, F.lit(0))),
        )
        .when(root.isNotNull(), read(root))
        .otherwise(_answer(split_lines(response)))
    )
    return rooted.withColumn("answer", answer).drop("_fixed", "_json", "_root", "_members")


def named_objects(answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per object named in ``answer``.

    The outer form keeps Spark from copying the whole reading of a response into a filter on its array.
    """
    named = answers.select(*keys, F.explode_outer("answer.objects").alias("label"))
    return named.filter(F.col("label").isNotNull())


def lower_keys(tags: Column | str) -> Column:
    """Map with lower-cased keys; of keys that differ only in case the last one stays."""
    entries = F.map_entries(_c(tags))
    renamed = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(
        renamed,
        lambda e, i: ~F.exists(F.slice(renamed, i + 2, F.greatest(F.size(renamed), F.lit(1))), lambda later: later["key"] == e["key"]),
    )
    return F.map_from_entries(last)
