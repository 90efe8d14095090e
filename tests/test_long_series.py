"""A series cut into slices must give what the uncut series gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rushes.operators import aggregates, joins, sampling, segments, tracking
from rushes.operators.ordered import SLICE, WHOLE, ordered_scan, slice_series

SMALL = {"rows_per_slice": 9}


@pytest.fixture(scope="module")
def series(spark):
    """One long file, one short one, repeated times and nulls."""
    rnd = random.Random(7)
    rows = []
    for file_id, n in (("long", 160), ("mid", 25), ("short", 4)):
        t = 0.0
        for i in range(n):
            t += rnd.choice([0.0, 0.1, 0.2, 0.4, 0.9, 1.5, 7.0])
            rows.append((file_id, round(t, 3), i, rnd.choice("aab") if rnd.random() > 0.1 else "static", rnd.random() * 8,
                         rnd.choice([None, rnd.randint(0, 9)])))
    df = spark.createDataFrame(rows, "file_id string, t double, idx long, label string, intensity double, v int")
    return df.repartition(3).cache()


def rows(df, digits=9):
    def plain(x):
        return round(x, digits) if isinstance(x, float) else x

    return sorted((tuple(plain(v) for v in r) for r in df.drop(SLICE).collect()), key=repr)


def same(make, series, digits=9):
    whole, cut = make(series, {}), make(series, SMALL)
    assert whole.drop(SLICE).columns == cut.drop(SLICE).columns
    assert rows(whole, digits) == rows(cut, digits)


def test_slices_cover_long_series_only(series):
    cut = slice_series(series, ["file_id"], "t", **SMALL)
    n = {r.file_id: r.n for r in cut.groupBy("file_id").agg(F.count_distinct(SLICE).alias("n")).collect()}
    assert n["short"] == 1 and n["mid"] > 1 and n["long"] > 8
    assert cut.filter("file_id = 'short'").first()[SLICE] == WHOLE
    assert slice_series(series, ["file_id"], "t") is series


def test_ordered_scan(series):
    def scan(df, slicing):
        df = slice_series(df, ["file_id"], "t", **slicing) if slicing else df
        return ordered_scan(
            df, ["file_id"], ["t", "idx"], prev={"p": "v"}, nxt={"x": "v"}, cum={"c": F.col("intensity")},
            ffill={"f": "v"}, bfill={"b": "v"}, total={"s": F.col("idx")}, position="pos")

    same(scan, series, 6)


@pytest.mark.parametrize("name", ["run_segments", "absorb", "summary"])
def test_segments(series, name):
    def make(df, slicing):
        segs = segments.run_segments(df, **slicing)
        if name == "run_segments":
            return segs
        merged = segments.absorb_short(segs)
        return merged if name == "absorb" else segments.motion_summary(merged)

    same(make, series, 6)


def test_row_operators(series):
    order = ["t", "idx"]
    same(lambda d, s: segments.drop_consecutive(d, ["file_id"], order, ["label"], **s), series)
    same(lambda d, s: segments.successive_gap(d, ["file_id"], order, **s), series)
    same(lambda d, s: segments.rolling_last_n(d, ["file_id"], order, "intensity", n=5, **s), series, 6)
    same(lambda d, s: segments.batch_rows(d, ["file_id"], order, k=3, overlap=True, **s), series)
    same(lambda d, s: segments.previous_text(d, ["file_id"], order, "v", **s), series)
    same(lambda d, s: segments.position_in_group(d, ["file_id"], order, **s), series)
    same(lambda d, s: sampling.limit_per_file(d, 11, **s), series)
    same(lambda d, s: aggregates.keyframe_stats(d, order=order, **s), series)
    clips = series.withColumn("duration", F.lit(0.3))
    same(lambda d, s: segments.continuity_groups(d, ["file_id"], order, "t", "duration", 0.5, **s), clips)


def test_rolling_blocks_meet(series, monkeypatch):
    monkeypatch.setattr(segments, "_BLOCK", 16)
    same(lambda d, s: segments.rolling_last_n(d, ["file_id"], ["t", "idx"], "intensity", n=5, **s), series, 6)


def test_true_runs(series):
    flags = segments.frame_index(series.dropDuplicates(["file_id", "t"]), ["file_id"]).select(
        "file_id", F.col("frame_index").alias("i"), (F.col("intensity") > 3).alias("is_speech"))
    same(lambda d, s: segments.true_runs(d, **s), flags)


def test_scenes(series):
    frames = series.dropDuplicates(["file_id", "t"]).withColumn("score", F.col("intensity") * 4)
    same(lambda d, s: segments.scenes_from_scores(d, **s), frames)


@pytest.mark.parametrize("interval", [0.05, 0.3, 1.0, 4.0, 50.0])
def test_greedy_sampling(series, interval):
    same(lambda d, s: sampling.sample_every(d, interval=interval, order=["t", "idx"], **s), series)
    kept = sampling.sample_every(series, interval=interval, order=["t", "idx"], **SMALL).collect()
    for file_id in ("long", "mid", "short"):
        times = sorted((r.t, r.idx) for r in series.filter(F.col("file_id") == file_id).collect())
        want, last = [], None
        for t, i in times:
            if last is None or t - last >= interval:
                want.append(i)
                last = t
        assert sorted(r.idx for r in kept if r.file_id == file_id) == sorted(want)


def test_nearest_time(series):
    targets = series.filter("label = 'a'").select("file_id", "t").distinct()
    frames = series.filter("label <> 'a'").select("file_id", "t").distinct()
    same(lambda d, s: joins.asof_nearest(targets, frames, None, **s), series)


def test_object_tracks(series):
    boxes = series.withColumn(
        "bbox", F.struct((F.col("idx") * 7 % 30).cast("int").alias("x"), F.lit(0).alias("y"), F.lit(40).alias("width"), F.lit(40).alias("height")))
    same(lambda d, s: tracking.track_objects(d, **s), boxes)


def test_run_series(series):
    runs = series.select(
        F.col("file_id").alias("series"), "idx", (F.col("label") != "b").alias("success"), F.col("intensity").alias("duration"),
        F.col("idx").alias("memory_mb"), (F.col("idx") * 3 % 11).alias("peak_memory_mb"))
    same(lambda d, s: aggregates.run_series_report(d, **s), runs, 6)


def sizes(df, order, n):
    cut = slice_series(df, ["file_id"], order, rows_per_slice=n)
    return [r["count"] for r in cut.groupBy("file_id", SLICE).count().collect()]


def test_slices_hold_under_bursts_ties_and_text(spark):
    burst = spark.range(20_000).select(
        F.lit("f").alias("file_id"), F.when(F.col("id") < 19_800, F.col("id") / 1e6).otherwise(F.col("id").cast("double")).alias("t"), F.col("id").alias("idx")
    )
    equal = burst.withColumn("t", F.lit(1.0))
    text = burst.withColumn("name", F.concat(F.lit("clip/"), F.sha2(F.col("idx").cast("string"), 256)))
    for df, order in ((burst, ["t", "idx"]), (equal, ["t", "idx"]), (text, ["name"])):
        found = sizes(df, order, 1000)
        assert sum(found) == 20_000 and max(found) <= 2000


def test_text_order_numbers_files(spark):
    from rushes.operators.costs import number_files

    files = spark.createDataFrame([("b", f"clip/{i:03d}.mov") for i in range(50)], "batch string, file_id string")
    got = number_files(files, ["batch"], ["file_id"], rows_per_slice=10).orderBy("file_id").collect()
    assert [r.file_no for r in got] == list(range(1, 51))


def test_persons_of_a_long_file(spark):
    from rushes.operators import tracking
    from rushes.plans.bindings import faces

    det = faces(spark, "/root/testdata/sf0.001")
    for emb in (0.5, 0.8):
        whole = tracking.track_persons(det, emb=emb, rows_per_slice=None).select("file_id", "idx", "person").collect()
        sliced = tracking.track_persons(det, emb=emb, rows_per_slice=10, seconds=7.0).select("file_id", "idx", "person").collect()
        assert sorted(map(tuple, whole)) == sorted(map(tuple, sliced)) and whole


def test_live_boxes_find_what_all_pairs_find():
    import random

    from rushes.operators.tracking import _iou, _LiveBoxes

    rng, live, seen = random.Random(3), _LiveBoxes(2.0, 0.2), []
    for n in range(400):
        t, box = n * 0.1, (rng.randint(-50, 400), rng.randint(-50, 300), rng.randint(0, 150), rng.randint(0, 150))
        want = {m for at, other, m in seen if t - at <= 2.0 and _iou(box, other) >= 0.2}
        assert set(live.nodes(t, box)) == want
        live.add(t, box, n)
        seen.append((t, box, n))
