"""Prompts for description models, built from a context map.

The wording is fixed by the models that read it and given as templates; rows only fill the gaps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rushes.functions import tables


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# Fixed wording.
FRAME_FORMAT = '{"objects": ["object1", "object2"], "description": "scene description"}'
CONTEXT_HEADER = "Known context about this video:"
PERSON_RULE = (
    '\nIMPORTANT: The person in this video is "%1$s".\n'
    '- In objects list: use "%1$s" instead of "person", "man", or "woman"\n'
    '- In description: refer to them as "%1$s", not "a person" or "someone"\n'
)
LANDMARK_RULE = (
    "\nIMPORTANT: This location has these nearby landmarks: %1$s\n"
    "- If you see any of these landmarks, use their PROPER NAME in the description\n"
)
LOG_RULE = "\nNOTE: %1$s\n- Focus on describing the content and action, not the color grading\n"
TOPIC_RULE = '\nIMPORTANT: This video shows "%1$s". Use this context to interpret the action.\n'
ASK = "Look at this image carefully and describe what you see."
ASK_BATCH = "These %1$d frames are from a video."
PREVIOUS = (
    "\nPrevious frame showed: %1$s\n\nDescribe what's happening NOW and how it relates to the previous frame.\n"
)
JSON_ONLY = "Respond with JSON only."


def _title(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def context_lines(context: Column | str, labels: dict[str, str], skip: tuple[str, ...]) -> Column:
    """``- Label: value`` lines for the non-empty entries of a context map, in map order, under a header.

    Null when nothing is left.
    """
    entries = F.filter(
        F.map_entries(_c(context)), lambda e: (F.coalesce(e["value"], F.lit("")) != "") & ~e["key"].isin(*skip)
    )
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    lines = F.transform(
        entries,
        lambda e: F.concat(
            F.lit("- "), F.coalesce(F.try_element_at(known, e["key"]), _title(e["key"])), F.lit(": "), e["value"]
        ),
    )
    return F.when(
        F.size(lines) > 0, F.concat(F.lit(CONTEXT_HEADER + "\n"), F.array_join(lines, "\n"))
    )


def _value(context: Column, key: str) -> Column:
    return F.nullif(F.try_element_at(context, F.lit(key)), F.lit(""))


def _rule(template: str, value: Column) -> Column:
    return F.coalesce(F.when(value.isNotNull(), F.format_string(template, value)), F.lit(""))


def build_prompt(context: Column | str, previous: Column | str | None = None) -> Column:
    """Single-frame prompt: context lines, rules for person, landmarks, log footage and topic, then the question.

    ``previous`` adds what the frame before showed.
    """
    ctx = _c(context)
    topic = F.coalesce(_value(ctx, "topic"), _value(ctx, "activity"))
    known = context_lines(ctx, tables.CONTEXT_LABELS, ("log_footage_note",))
    rules = F.concat(
        _rule(PERSON_RULE, _value(ctx, "person")),
        _rule(LANDMARK_RULE, _value(ctx, "nearby_landmarks")),
        _rule(LOG_RULE, _value(ctx, "log_footage_note")),
        _rule(TOPIC_RULE, topic),
    )
    before = F.lit("") if previous is None else _rule(PREVIOUS, F.nullif(_c(previous), F.lit("")))
    ask = F.lit(f"{ASK}\n\nJSON format:\n{FRAME_FORMAT}\n\n{JSON_ONLY}")
    return F.concat(F.coalesce(F.concat(known, F.lit("\n")), F.lit("")), rules, before, ask)


def build_batch_prompt(context: Column | str, n_frames: Column | int) -> Column:
    """Prompt for several frames of one file at once."""
    ctx = _c(context)
    n = F.lit(n_frames) if isinstance(n_frames, int) else n_frames
    # Later of topic and activity in map order wins.
    hints = F.filter(F.map_entries(ctx), lambda e: e["key"].isin("topic", "activity") & (e["value"] != ""))
    topic = F.try_element_at(F.transform(hints, lambda e: e["value"]), F.lit(-1))
    known = context_lines(ctx, tables.BATCH_CONTEXT_LABELS, ("log_footage_note", "color_transfer"))
    person = _rule('Use "%1$s" instead of "person" in objects and description.\n', _value(ctx, "person"))
    return F.concat(
        F.coalesce(F.concat(known, F.lit("\n\n")), F.lit("")),
        F.format_string(ASK_BATCH + "\n", n.cast("int")),
        person,
        _rule(TOPIC_RULE, topic),
        F.lit(f"\nJSON format:\n{FRAME_FORMAT}\n\n{JSON_ONLY}"),
    )
