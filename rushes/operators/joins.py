"""Interval, nearest-time, embedding and lookup joins.

Range joins carry an equality on the series and on a time bucket, so one long file is spread over many keys
and no pair outside neighbouring buckets is formed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rushes.functions import tables
from rushes.functions.media import box_iou, media_type
from rushes.operators.ordered import drop_slice, ordered_scan, slice_series
from rushes.operators.similarity import SCORE_BYTES, unit_rows


def _bucket(t: Column, width: float) -> Column:
    return F.floor(t / F.lit(width)).cast("long")


def _spread(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """One copy of an interval per bucket it touches."""
    buckets = F.sequence(_bucket(F.col(start), width), _bucket(F.greatest(F.col(start), F.col(end)), width))
    return df.withColumn("_b", F.explode(buckets))


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys])


def _once(width: float, a_start: str = "a.start", b_start: str = "b.start") -> Column:
    """Two intervals share several buckets; count the pair only in the first one they share."""
    return F.col("a._b") == F.greatest(_bucket(F.col(a_start), width), _bucket(F.col(b_start), width))


def assign_by_overlap(
    segs: DataFrame,
    turns: DataFrame,
    keys: Sequence[str] = ("file_id",),
    label: str = "speaker",
    width: float = 60.0,
) -> DataFrame:
    """Give each segment the label of the turn it overlaps most; ties go to the earliest turn, none to null.

    ``segs`` and ``turns`` have ``start``, ``end`` and a unique ``idx``.  Touching intervals do not overlap.
    """
    a = _spread(segs, "start", "end", width).alias("a")
    b = _spread(turns.select(*keys, "idx", "start", "end", label), "start", "end", width).alias("b")
    overlap = F.least("a.end", "b.end") - F.greatest("a.start", "b.start")
    on = _same("a", "b", keys) & (F.col("a._b") == F.col("b._b")) & _once(width) & (overlap > 0)
    rank = F.when(F.col("b.idx").isNotNull(), F.struct(overlap.alias("o"), (-F.col("b.idx")).alias("i")))
    rest = [c for c in segs.columns if c not in (*keys, "idx")]
    return (
        a.join(b, on, "left")
        .groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.idx").alias("idx"))
        .agg(
            F.first(F.struct(*[F.col(f"a.{c}").alias(c) for c in rest])).alias("_seg"),
            F.max_by(F.col(f"b.{label}"), rank).alias(label),
            F.max(rank)["o"].alias("overlap"),
        )
        .select(*keys, "idx", "_seg.*", label, "overlap")
    )


def interval_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = ("file_id",), width: float = 60.0
) -> DataFrame:
    """Overlapping pairs of two interval tables with the length of the overlap.

    All columns of both sides, right ones prefixed ``r_``.
    """
    a = _spread(left, "start", "end", width).alias("a")
    b = _spread(right, "start", "end", width).alias("b")
    overlap = F.least("a.end", "b.end") - F.greatest("a.start", "b.start")
    on = _same("a", "b", keys) & (F.col("a._b") == F.col("b._b")) & _once(width) & (overlap > 0)
    return a.join(b, on, "inner").select(
        *[F.col(f"a.{c}") for c in left.columns],
        *[F.col(f"b.{c}").alias(f"r_{c}") for c in right.columns if c not in keys],
        overlap.alias("overlap"),
    )


def cross_reference(faces: DataFrame, turns: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Seconds each person is on screen while each speaker talks.

    ``faces``: ``person``, ``start``, ``end``; ``turns``: ``speaker``, ``start``, ``end``.
    """
    pairs = interval_pairs(faces.select(*keys, "person", "start", "end"), turns.select(*keys, "speaker", "start", "end"), keys)
    return pairs.groupBy(*keys, "person", F.col("r_speaker").alias("speaker")).agg(
        F.sum("overlap").alias("seconds"), F.count(F.lit(1)).alias("n_overlaps")
    )


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    tol: float | None = 0.05,
    keys: Sequence[str] = ("file_id",),
    t: str = "t",
    **slicing,
) -> DataFrame:
    """The frame nearest to each target time as ``frame_t``; ties go to the earlier frame.

    ``left`` has distinct ``(keys, t)``.  With a tolerance, frames further than ``tol`` do not match
    (``frame_t`` null).  Without one the nearest frame before and after are read off one ordered pass.
    """
    if tol is None:
        both = (
            left.select(*keys, t, F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_frame"))
            .unionByName(right.select(*keys, t, F.lit(0).alias("_kind"), F.col(t).cast("double").alias("_frame")).distinct())
        )
        both = slice_series(both, keys, t, **slicing)
        seen = ordered_scan(both, keys, [t, "_kind"], ffill={"_lo": "_frame"}, bfill={"_hi": "_frame"})
        closer = F.when(
            F.col("_hi").isNull() | (F.col(t) - F.col("_lo") <= F.col("_hi") - F.col(t)), F.col("_lo")
        ).otherwise(F.col("_hi"))
        return drop_slice(seen.filter(F.col("_kind") == 1)).select(*keys, t, closer.alias("frame_t"))

    width = 2 * tol
    a = left.select(*keys, t, _bucket(F.col(t), width).alias("_b")).alias("a")
    near = F.array(*[_bucket(F.col(t), width) + d for d in (-1, 0, 1)])
    b = right.select(*keys, t).distinct().withColumn("_b", F.explode(near)).alias("b")
    gap = F.abs(F.col(f"a.{t}") - F.col(f"b.{t}"))
    on = _same("a", "b", keys) & (F.col("a._b") == F.col("b._b")) & (gap <= tol)
    rank = F.when(F.col(f"b.{t}").isNotNull(), F.struct(gap, F.col(f"b.{t}")))
    return (
        a.join(b, on, "left")
        .groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{t}").alias(t))
        .agg(F.min_by(F.col(f"b.{t}"), rank).alias("frame_t"))
    )


def subset_frames(
    targets: DataFrame, frames: DataFrame, tol: float = 0.05, keys: Sequence[str] = ("file_id",), t: str = "t"
) -> DataFrame:
    """Distinct frames that serve the target times."""
    matched = asof_nearest(targets, frames, tol, keys, t)
    return matched.filter(F.col("frame_t").isNotNull()).select(*keys, F.col("frame_t").alias(t)).distinct()


def split_reusable(
    targets: DataFrame, frames: DataFrame, tol: float = 0.35, keys: Sequence[str] = ("file_id",), t: str = "t"
) -> DataFrame:
    """Targets with ``reusable``: an already decoded frame lies within ``tol``."""
    matched = asof_nearest(targets, frames, tol, keys, t)
    return matched.select(*keys, t, F.col("frame_t").isNotNull().alias("reusable"))


def match_known(
    det: DataFrame, known: DataFrame, thr: float = 0.5, keys: Sequence[str] = ("file_id",), block_rows: int = 20_000
) -> DataFrame:
    """Detections with an embedding, flagged ``is_known`` when some known embedding of their series is nearer than ``thr``.

    Both tables are read once, besides a count of rows by series: a series of many detections is dealt to blocks of about
    ``block_rows``, each of which meets the known embeddings of its series in products of bounded bytes.
    """
    keys = list(keys)
    a = det.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    blocks = a.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_blocks"))
    left = a.join(blocks, keys).withColumn("_block", F.pmod(F.xxhash64(*[c for c in a.columns if c not in keys]), F.col("_blocks"))).drop("_blocks")
    right = known.filter(F.size("embedding") > 0).select(*keys, "embedding").join(blocks, keys)
    right = right.select(*[F.col(k).alias(f"_known_{k}") for k in keys], F.col("embedding").alias("_v"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_with"))
    schema = T.StructType([*a.schema.fields, T.StructField("is_known", T.BooleanType())])

    def flag(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        mine = mine.drop(columns="_block")
        if not len(mine):
            return mine.assign(is_known=pd.Series(dtype=bool))
        hit = np.zeros(len(mine), bool)
        if len(theirs):
            m, other = unit_rows(mine["embedding"]), unit_rows(theirs["_v"])
            step = max(1, SCORE_BYTES // (8 * len(other)))
            for i in range(0, len(m), step):
                hit[i : i + step] = (1.0 - m[i : i + step] @ other.T < thr).any(axis=1)
        return mine.assign(is_known=hit)

    grouped = left.groupBy(*keys, "_block").cogroup(right.groupBy(*[f"_known_{k}" for k in keys], "_with"))
    return grouped.applyInPandas(flag, schema)


def all_known(matched: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Per series: are all detections known, and how many are not."""
    return matched.groupBy(*keys).agg(
        F.bool_and("is_known").alias("all_known"), F.count_if(~F.col("is_known")).alias("n_new")
    )


def in_window(
    times: DataFrame, windows: DataFrame, keys: Sequence[str] = ("file_id",), t: str = "t", width: float = 60.0
) -> DataFrame:
    """Times with the windows ``[start, end)`` that hold them."""
    a = times.withColumn("_b", _bucket(F.col(t), width)).alias("a")
    b = _spread(windows, "start", "end", width).alias("b")
    inside = (F.col(f"a.{t}") >= F.col("b.start")) & (F.col(f"a.{t}") < F.col("b.end"))
    return a.join(b, _same("a", "b", keys) & (F.col("a._b") == F.col("b._b")) & inside, "inner").select(
        *[F.col(f"a.{c}") for c in times.columns],
        *[F.col(f"b.{c}") for c in windows.columns if c not in keys],
    )


def track_edges(
    det: DataFrame,
    gap: float = 5.0,
    iou: float = 0.3,
    keys: Sequence[str] = ("file_id", "label"),
    t: str = "t",
) -> DataFrame:
    """Pairs of detections at most ``gap`` seconds apart whose boxes overlap by at least ``iou``.

    Columns: keys, ``idx_a``, ``t_a``, ``idx_b``, ``t_b``, ``iou``; ``a`` comes first in ``(t, idx)`` order.
    """
    cols = [*keys, t, "idx", "bbox"]
    bucket = _bucket(F.col(t), gap)
    a = det.select(*cols).withColumn("_b", F.explode(F.array(bucket, bucket + 1))).alias("a")
    b = det.select(*cols).withColumn("_b", bucket).alias("b")
    later = (F.col(f"a.{t}") < F.col(f"b.{t}")) | ((F.col(f"a.{t}") == F.col(f"b.{t}")) & (F.col("a.idx") < F.col("b.idx")))
    close = F.col(f"b.{t}") - F.col(f"a.{t}") <= gap
    shared = box_iou("a.bbox", "b.bbox")
    on = _same("a", "b", keys) & (F.col("a._b") == F.col("b._b")) & later & close & (shared >= iou)
    return a.join(b, on, "inner").select(
        *[F.col(f"b.{k}") for k in keys],
        F.col("a.idx").alias("idx_a"), F.col(f"a.{t}").alias("t_a"),
        F.col("b.idx").alias("idx_b"), F.col(f"b.{t}").alias("t_b"),
        shared.alias("iou"),
    )


def enrich(
    base: DataFrame,
    sources: Sequence[tuple[DataFrame, Sequence[str]]],
    fields: Sequence[str],
    prefer_base: Sequence[str] = (),
) -> DataFrame:
    """Left-join each source on its own keys and take every field from the first source that has it.

    Sources come in order of precedence and are unique on their keys; ``base`` is last, except for
    ``prefer_base`` fields, where it is first.
    """
    out = base
    for n, (source, keys) in enumerate(sources):
        present = [f for f in fields if f in source.columns]
        side = source.select(*keys, *[F.col(f).alias(f"_s{n}_{f}") for f in present])
        out = out.join(side, list(keys), "left")
    merged = {}
    for f in fields:
        found = [F.col(f"_s{n}_{f}") for n, (s, _) in enumerate(sources) if f in s.columns]
        own = [F.col(f)] if f in base.columns else []
        merged[f] = F.coalesce(*(own + found if f in prefer_base else found + own))
    return out.withColumns(merged).select(*base.columns, *[f for f in fields if f not in base.columns])


def pick_candidate(sidecars: DataFrame, keys: Sequence[str], priority: str = "priority") -> DataFrame:
    """One sidecar per key: the candidate with the lowest priority number."""
    rest = [c for c in sidecars.columns if c not in keys]
    best = sidecars.groupBy(*keys).agg(F.min_by(F.struct(*rest), priority).alias("_row"))
    return best.select(*keys, "_row.*")


def with_probe(files: DataFrame, probe: DataFrame) -> DataFrame:
    """Every requested file with its probe result or an error."""
    out = files.join(probe.withColumn("_found", F.lit(True)), "file_id", "left")
    missing = F.when(F.col("_found").isNull(), "no probe result")
    error = F.coalesce(F.col("error"), missing) if "error" in probe.columns else missing
    return out.withColumn("error", error).drop("_found")


def with_options(files: DataFrame, options: DataFrame, defaults: dict[str, str | None]) -> DataFrame:
    """One column per option key; files without a value get the default.

    ``options`` has ``file_id``, ``key``, ``value``.
    """
    picked = options.groupBy("file_id").agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in defaults]
    )
    joined = files.join(picked, "file_id", "left")
    return joined.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})


def drop_failed(df: DataFrame, failed: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    return df.join(failed.select(*keys), list(keys), "left_anti")


def audio_gate(files: DataFrame, meta: DataFrame) -> DataFrame:
    """``audio_state`` per file: ``no_audio`` for images and files known to have none, else ``has_audio``.

    ``meta`` has ``file_id`` and ``audio_codec``; a file without metadata counts as having audio.
    """
    known = meta.select("file_id", F.col("audio_codec").isNotNull().alias("_has"))
    silent = (media_type("file_id") == "image") | ~F.coalesce("_has", F.lit(True))
    return files.join(known, "file_id", "left").withColumn(
        "audio_state", F.when(silent, "no_audio").otherwise("has_audio")
    ).drop("_has")


def siblings(
    recordings: DataFrame, keys: Sequence[str], member: str = "file_id", index: str = "file_index", part_rows: int = 1000
) -> DataFrame:
    """For every file the other files of its recording, in clip order, as ``sibling_files``.

    Member lists are built in parts of at most ``part_rows`` clips, so a recording of any length is no single
    oversized array; a file of a longer recording has one row per part.
    """
    part = F.floor(F.col(index) / part_rows).alias("part")
    lists = recordings.groupBy(*keys, part).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(index, member))), lambda x: x[member]).alias("_members")
    )
    joined = recordings.select(*keys, member, index).join(lists, list(keys), "inner")
    others = F.filter("_members", lambda x: x != F.col(member))
    return joined.select(*keys, member, index, "part", others.alias("sibling_files"))


def map_label(df: DataFrame, label: str = "label", name: str = "shot_type") -> DataFrame:
    """Shot type of a descriptive label, ``unknown`` for others; a constant map, no join."""
    pairs = [F.lit(x) for kv in tables.SHOT_LABELS.items() for x in kv]
    return df.withColumn(name, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(label)), F.lit("unknown")))
