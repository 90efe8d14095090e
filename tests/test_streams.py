"""Streaming twins give what their batch operators give."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from rushes.operators import sampling, tracking
from rushes.operators.tracking import PLAN, FaceScan
from rushes.plans.catalog import QUERIES
from rushes.streaming import streams

SF = "/root/testdata/sf0.001"


def test_face_scan_equals_batch(spark):
    batch = sorted(tuple(r) for r in QUERIES["plan_face_scan"](spark, SF).collect())
    stream = sorted(tuple(r) for r in QUERIES["stream_face_scan"](spark, SF).collect())
    assert batch == stream and batch


def test_face_scan_goes_on_over_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    rng = np.random.default_rng(3)
    vectors, rows = rng.normal(size=(4, 8)), []
    for f, n in (("f", 120), ("g", 30)):
        for i, t in enumerate(np.sort(np.round(rng.random(n) * 150, 2))):
            e = None if i % 11 == 0 else vectors[rng.integers(0, 1 + int(t // 40))].tolist()
            rows.append((f, 155.0, float(t), i, None if i % 7 == 0 else float(rng.random()), tuple(map(int, rng.integers(20, 200, 4))), e))
        rows.append((f, 155.0, 154.9, 999, .5, (500, 500, 9, 9), None))
    schema = "file_id string, duration double, t double, idx long, confidence double, bbox struct<x:int,y:int,width:int,height:int>, embedding array<double>"
    batches = [[r for r in rows if r[2] // 52 == n] for n in range(3)]
    out = streams.run_to_table(streams.stream_face_scan(arrive(spark, tmp_path / "in", batches, schema), ttl=None), "f", path=str(tmp_path / "out"))
    det = spark.createDataFrame(rows, schema)
    whole = sorted(map(tuple, tracking.plan_face_scan(det.select("file_id", "duration").distinct(), det.drop("duration")).collect()))
    # The last row shows that windows up to 154.9 - 0.35 are over.
    assert sorted(map(tuple, out.collect())) == [r for r in whole if r[3] < 154.9 - 0.35] and len(whole) > 10


def test_whole_files_ask_little_of_the_state():
    class Value:
        calls, held = 0, None

        def get(self):
            self.calls += 1
            return self.held

        def update(self, v):
            self.calls, self.held = self.calls + 1, v

    class Handle:
        values = {}

        def getValueState(self, name, *_):
            return self.values.setdefault(name, Value())

    scanner = streams._FaceScanner(lambda d: FaceScan(d, 30.0, 10.0, 0.5, 2), 0.35, (5.0, 0.2, 0.5), ["file_id", *PLAN_NAMES], True, None, "<f8")
    scanner.init(Handle())  # no lists
    packed = struct.pack(streams._HEAD, 5.0, 0.9, 1, 0, 0, 10, 10) + np.array([1.0, 0.0]).tobytes()
    rows = list(scanner.handleInputRows(("f",), iter([{"duration": 65.0, "detection": packed}]), None))
    assert [(r.window, r.n_faces, r.n_new) for r in rows] == [(0, 1, 1), (1, 0, 0), (2, 0, 0)]
    assert sum(v.calls for v in Handle.values.values()) == 2
    assert list(scanner.handleInputRows(("f",), iter([{"duration": 65.0, "detection": packed}]), None)) == []


PLAN_NAMES = [f.split()[0] for f in PLAN.split(", ")]


def test_sampling_goes_on_over_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    rows = [("f", i * 0.4, i) for i in range(40)] + [("g", i * 0.7, i) for i in range(20)]
    schema = "file_id string, t double, idx long"
    for n in range(4):
        part = [r for r in rows if r[2] // 10 == n]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    stream = streams.read_files(
        spark, str(tmp_path / "in/*"), spark.createDataFrame(rows, schema).schema, maxFilesPerTrigger="1", latestFirst="false")
    out = streams.run_to_table(streams.stream_sample(stream, 1.0, ttl=None), "t", path=str(tmp_path / "out"))
    want = sampling.sample_every(spark.createDataFrame(rows, schema), interval=1.0)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    def batch(n, seconds):
        rows = spark.createDataFrame([("s", float(x)) for x in seconds], "extractor string, seconds double")
        rows = rows.withColumn("started_at", F.timestamp_seconds(F.lit(86400) + F.col("seconds")))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
        return rows.schema

    for n, seconds in enumerate([(0, 10), (7200,), (7300,), (5,), (90000,)]):
        schema = batch(n, seconds)
    stream = streams.read_files(spark, str(tmp_path / "in/*"), schema, maxFilesPerTrigger="1")
    metrics = streams.stream_run_metrics(stream, "10 minutes", "1 hour")
    out = streams.run_to_table(metrics, "m", path=str(tmp_path / "out")).orderBy("window_start").collect()
    assert [r.n_runs for r in out] == [2, 2]


AHEAD = 4102444800


def arrive(spark, path, batches, schema):
    """One file for each batch; times are seconds of a day after the first, since Spark takes the first moment as late."""
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        times = {c: F.timestamp_seconds(F.col(c) + 86400) for c in df.columns if c in ("start", "end", "at")}
        df.withColumns(times).coalesce(1).write.parquet(f"{path}/{n:03d}")
    shape = df.withColumns(times).schema
    return streams.read_files(spark, f"{path}/*", shape, maxFilesPerTrigger="1")


def test_assign_keeps_unmatched_segments_and_long_turns(spark, tmp_path):
    # Segment 9 comes after the watermark has passed it.
    segs = [
        [("a", 0, 100, 110), ("b", 0, 100, 110)], [("a", 1, 20_000, 20_005), ("a", 2, 30_000, 30_000)],
        [("a", 3, 40_000, 47_300)], [("a", 9, 95, 99)], [("-", None, AHEAD, AHEAD + 1)],
    ]
    turns = [
        [("a", 0, 90, 30_500, "long"), ("a", 1, 105, 110, "short")], [("a", 2, 20_001, 20_004, "inside")],
        [("a", 3, 40_000, 43_000, "first"), ("a", 4, 43_000, 47_300, "second")], [("z", 0, 47_000, 47_010, "other")], [("-", None, AHEAD, AHEAD + 1, None)],
    ]
    left = arrive(spark, tmp_path / "segs", segs, "file_id string, idx long, start long, end long")
    right = arrive(spark, tmp_path / "turns", turns, "file_id string, idx long, start long, end long, speaker string")
    found, late = streams.run_and_count(streams.stream_assign(left, right, watermark="1 hour"), "a", path=str(tmp_path / "out"))
    got = {(r.file_id, r.idx): (r.speaker, r.overlap_us) for r in streams.pick_assignments(found).where("file_id <> '-'").collect()}
    million = 1_000_000
    assert got == {
        ("a", 0): ("long", 10 * million), ("b", 0): (None, None), ("a", 1): ("long", 5 * million), ("a", 2): (None, None),
        ("a", 3): ("second", 4300 * million),
    }
    assert late == 1


def test_ordered_sampling_waits_for_the_watermark(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    rows = [("f", i * 0.4, i, 1000 + 10 * i) for i in range(40)] + [("g", i * 0.7, i, 1000 + 10 * i) for i in range(20)]
    mixed = [[r for r in rows if r[2] * 5 % 3 == n] for n in range(3)]
    batches = [*mixed, [("-", 0.0, 0, 5000)], [("f", 0.0, 99, 900)], [("-", 0.0, 1, AHEAD)]]
    stream = arrive(spark, tmp_path / "in", batches, "file_id string, t double, idx long, at long")
    sampled = streams.stream_sample(stream, 1.0, at="at", watermark="10 minutes")
    out, late = streams.run_and_count(sampled, "s", path=str(tmp_path / "out"))
    plain = spark.createDataFrame([r[:3] for r in rows], "file_id string, t double, idx long")
    want = sampling.sample_every(plain, interval=1.0)
    assert sorted(map(tuple, out.where("file_id <> '-'").collect())) == sorted(map(tuple, want.collect()))
    assert late == 1


def test_tables_may_be_folders(spark, tmp_path):
    for name in ("documents", "events", "customer"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("stream_first_seen", "stream_enrich"):
        want = sorted(map(tuple, QUERIES[name](spark, SF).collect()), key=repr)
        assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()), key=repr) == want and want
