"""Hand-worked values."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rushes.functions import arrays, media, prompts, responses
from rushes.functions import tags as tg
from rushes.operators import aggregates, costs, joins, sampling, segments, similarity, timeplans, tracking
from rushes.operators.rules import attribute_device, default_rules
from rushes.plugins import apply_encoder, apply_model, gate_queries, register_language_detector


def one(spark, col, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(col.alias("x")).first()["x"]


def lit_map(d):
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string,string>")


@pytest.mark.parametrize("path,want", [
    ("/a/B.MP4", "video"), ("/a/x.CR2", "image"), ("/a/x.opus", "audio"), ("/a/noext", "unknown"), ("/a/.mp4", "unknown"), ("/a/x.txt", "unknown")])
def test_media_type(spark, path, want):
    assert one(spark, media.media_type(F.lit(path))) == want


@pytest.mark.parametrize("text,want", [
    ("2024-06-15T10:30:00.123456Z", dt.datetime(2024, 6, 15, 10, 30, 0, 123456)),
    ("2024-06-15T10:30:00+02:00", dt.datetime(2024, 6, 15, 10, 30)),
    ("2024-06-15 10:30:00-0500", dt.datetime(2024, 6, 15, 10, 30)),
    ("2024:06:15 10:30:00", dt.datetime(2024, 6, 15, 10, 30)),
    ("2024/06/15 10:30:00", dt.datetime(2024, 6, 15, 10, 30)),
    ("15/06/2024 10:30:00", dt.datetime(2024, 6, 15, 10, 30)),
    ("2024-06-15", dt.datetime(2024, 6, 15)),
    ("2024-13-15", None), ("soon", None)])
def test_creation_time(spark, text, want):
    assert one(spark, tg.creation_time(lit_map({"date": text}))) == want


def test_creation_time_falls_back_to_stream_tags(spark):
    col = tg.creation_time(lit_map({"date": ""}), lit_map({"creation_time": "2020-01-02"}))
    assert one(spark, col) == dt.datetime(2020, 1, 2)


@pytest.mark.parametrize("text,ref,want", [
    ("63;6;38.880", "N", 63.1108), ("63;6:38.880", "S", -63.1108), ("-12.5", "S", -12.5), ("12.5", "S", 12.5), ("a;b;c", "N", None)])
def test_dms(spark, text, ref, want):
    got = one(spark, tg.dms_to_decimal(F.lit(text), F.lit(ref)))
    assert got == want if want is None else math.isclose(got, want, abs_tol=1e-9)


def test_timecode_borrows(spark):
    args = [F.lit(x) for x in (0, 0, 0, 1)]
    assert one(spark, media.shift_timecode(*args, 25.0)) == "-1:59:59:24"
    assert one(spark, media.shift_timecode(F.lit(1), F.lit(0), F.lit(0), F.lit(1), 25.0)) == "00:59:59:24"


def test_boxes(spark):
    a, b = media.box(F.lit(0), F.lit(0), F.lit(10), F.lit(10)), media.box(F.lit(5), F.lit(0), F.lit(10), F.lit(10))
    c = media.box(F.lit(10), F.lit(0), F.lit(10), F.lit(10))
    assert math.isclose(one(spark, media.box_iou(a, b)), 50 / 150)
    assert one(spark, media.box_iou(a, c)) == 0
    assert one(spark, media.near_edge(c, F.lit(200), F.lit(100))) is True


def test_audio(spark):
    def frame(xs):
        return F.array(*[F.lit(x) for x in xs]).cast("array<smallint>")

    assert one(spark, media.rms(F.array().cast("array<smallint>"))) == 0
    assert one(spark, media.rms(frame([3, -4, 3, -4]))) == pytest.approx(math.sqrt(12.5))
    assert one(spark, media.zcr(frame([1, -1, 1, -1]))) == 1
    assert one(spark, media.zcr(frame([0, 1, 2]))) == 0
    assert one(spark, media.zcr(frame([5]))) == 0


@pytest.mark.parametrize("n,k", [(6, 3), (7, 5), (100, 7), (3, 5), (59, 60), (381, 59)])
def test_picks(spark, n, k):
    values = F.sequence(F.lit(0), F.lit(n - 1))
    lin = list(range(n)) if n <= k else [int(i) for i in np.linspace(0, n - 1, k, dtype=int)]
    stp = list(range(n)) if n <= k else [int(i * (n / k)) for i in range(k)]
    assert one(spark, arrays.linspace_pick(values, k)) == lin
    assert one(spark, arrays.step_pick(values, k)) == stp


def test_responses(spark):
    texts = {
        "fenced": '```json\n{"objects": ["a", {"name": "b"}, {"name": "", "label": "c"}, 5], "action": "run ", "description": "d", "change": "z",}\n```',
        "truncated": '{"objects": [{"name": "q"}, {"name":',
        "two roots": '{"objects": ["m"]}, {"objects": ["n"]}',
        "plain": "- cat, dog\n* bird\nnote: no",
        "array": '[{"objects": ["m"], "description": "short"}, {"objects": ["n"], "description": "a long enough text"}]',
    }
    df = spark.createDataFrame(list(texts.items()), "k string, response string")
    got = {r.k: r.answer for r in responses.read_response(df).collect()}
    assert (got["fenced"].objects, got["fenced"].description) == (["a", "b", "c"], "run d Change: z")
    assert (got["truncated"].objects, got["truncated"].description) == (["q"], None)
    assert got["two roots"].objects == ["m"]
    assert got["plain"].objects == ["cat", "dog", "bird"]
    framed = {r.k: r.answer for r in responses.parse_frame_response(df).collect()}
    assert (framed["array"].objects, framed["array"].description) == (["m", "n"], "a long enough text")


def test_lower_keys_last_wins(spark):
    assert one(spark, responses.lower_keys(lit_map({"Make": "a", "MAKE": "b", "x": "c"}))) == {"make": "b", "x": "c"}


def test_prompts(spark):
    ctx = lit_map({"person": "Bo", "topic": "", "my_key": "v", "activity": "ski"})
    text = one(spark, prompts.build_prompt(ctx, F.lit("snow")))
    assert text.startswith("Known context about this video:\n- Person identified: Bo\n- My Key: v\n- Activity: ski\n")
    assert 'shows "ski"' in text and "Previous frame showed: snow" in text
    assert one(spark, prompts.build_batch_prompt(lit_map({}), 3)).startswith("These 3 frames")


def segs(spark, rows):
    data = [("f", i, float(a), float(b), label, float(v), 1, float(v)) for i, (a, b, label, v) in enumerate(rows)]
    return spark.createDataFrame(data, "file_id string, seg long, start double, end double, label string, intensity double, n_rows long, value_sum double")


def test_absorb_short(spark):
    df = segs(spark, [(0, .2, "a", 1), (.2, .5, "b", 3), (.5, .6, "a", 5), (.6, 2, "c", 7), (2, 2.1, "a", 9)])
    got = [(r.start, r.end, r.label, r.intensity) for r in segments.absorb_short(df).orderBy("start").collect()]
    assert got == [(0, .6, "b", 3.5), (.6, 2.1, "c", 8)]


def test_long_chain_of_short_segments(spark):
    df = segs(spark, [(i * .25, i * .25 + .25, "ab"[i % 2], 1) for i in range(3000)])
    merged = segments.absorb_short(df).collect()
    assert len(merged) == 1 and merged[0].intensity == pytest.approx(1) and merged[0].label == "b"


def test_summary_without_frames(spark):
    files = spark.createDataFrame([("f", 9.0), ("g", 4.0)], "file_id string, duration double")
    s = {r.file_id: r for r in segments.motion_summary(segs(spark, [(0, 9, "handheld", 8)]), files=files).collect()}
    assert not s["f"].is_stable and s["g"].is_stable and s["g"].primary_label == "static" and s["g"].mean_intensity == 0


def test_adaptive_plan_cases(spark):
    summary = spark.createDataFrame(
        [("calm", 8.0, True, .5, 1), ("still", 20.0, True, .5, 1), ("slow", 45.0, True, 1.5, 1), ("bare", 5.0, False, 9.0, 0), ("f", 10.0, False, 9.0, 2)],
        "file_id string, duration double, is_stable boolean, mean_intensity double, n_segments long")
    df = segs(spark, [(0, .1, "a", 9), (.1, 3, "b", 5)])
    plan = {}
    for r in timeplans.adaptive_plan(summary, df).orderBy("file_id", "sample_no").collect():
        plan.setdefault(r.file_id, []).append(round(r.t, 6))
    assert plan == {
        "calm": [4.0], "still": [3.0, 10.0, 17.0], "slow": [9.0, 18.0, 27.0, 36.0], "bare": [.1, 2.1, 4.1], "f": [.1, .2, 1.2, 2.2]}


def test_overlap_assignment(spark):
    s = spark.createDataFrame([("f", 0, 0.0, 10.0), ("f", 1, 10.0, 12.0), ("f", 2, 500.0, 501.0)], "file_id string, idx long, start double, end double")
    t = spark.createDataFrame(
        [("f", 0, 0.0, 4.0, "A"), ("f", 1, 5.0, 9.0, "B"), ("f", 2, 12.0, 90.0, "C"), ("g", 3, 0.0, 99.0, "D")],
        "file_id string, idx long, start double, end double, speaker string")
    for width in (1.0, 60.0):
        got = {r.idx: r.speaker for r in joins.assign_by_overlap(s, t, width=width).collect()}
        assert got == {0: "A", 1: None, 2: None}


def test_nearest_is_brute_force(spark):
    rnd = random.Random(3)
    a = sorted({round(rnd.random() * 20, 2) for _ in range(80)})
    b = sorted({round(rnd.random() * 20, 2) for _ in range(60)})
    left, right = [spark.createDataFrame([("f", x) for x in xs], "file_id string, t double") for xs in (a, b)]
    for tol in (.05, .35, None):
        got = {r.t: r.frame_t for r in joins.asof_nearest(left, right, tol).collect()}
        for t in a:
            best = min(b, key=lambda x: (abs(t - x), x))
            assert got[t] == (best if tol is None or abs(t - best) <= tol else None)


def vectors(spark, n, name, seed, dim=8):
    rnd = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rnd.normal(size=dim)]) for i in range(n)]
    return {i: np.array(v) / np.linalg.norm(v) for i, v in rows}, spark.createDataFrame(rows, f"{name} long, embedding array<double>")


@pytest.mark.parametrize("limit", [10**9, 0])
def test_similarity_is_brute_force(spark, limit):
    big, big_df = vectors(spark, 90, "vec_id", 1)
    small, small_df = vectors(spark, 23, "query_id", 2)
    near = similarity.nearest_of(big_df, small_df, "vec_id", "query_id", broadcast_bytes=limit, block_rows=7).collect()
    assert {r.vec_id: r.query_id for r in near} == {i: max(small, key=lambda j: v @ small[j]) for i, v in big.items()}
    found = similarity.search(small_df, big_df, 4, broadcast_bytes=limit, block_rows=7).collect()
    for j, q in small.items():
        want = sorted(big, key=lambda i: -(big[i] @ q))[:4]
        assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == j] == want


def test_similarity_without_vectors(spark):
    _, big_df = vectors(spark, 5, "vec_id", 1)
    none = spark.createDataFrame([], "query_id long, embedding array<double>")
    assert similarity.nearest_of(big_df, none, "vec_id", "query_id").count() == 0
    assert similarity.search(none, big_df).count() == 0


def test_match_known(spark):
    det = spark.createDataFrame([("f", 1, [1.0, 0.0]), ("f", 2, [0.0, 1.0]), ("f", 3, []), ("g", 4, [1.0, 0.0])], "file_id string, idx long, embedding array<double>")
    known = spark.createDataFrame([("f", [0.9, 0.1])], "file_id string, embedding array<double>")
    got = joins.match_known(det, known)
    assert {r.idx: r.is_known for r in got.collect()} == {1: True, 2: False, 4: False}
    assert {r.file_id: (r.all_known, r.n_new) for r in joins.all_known(got).collect()} == {"f": (False, 1), "g": (False, 1)}


def boxes(spark, rows):
    data = [("f", float(t), i, "x", .9, (x, 0, 10, 10), e) for i, (t, x, e) in enumerate(rows)]
    return spark.createDataFrame(
        data, "file_id string, t double, idx long, label string, confidence double, bbox struct<x:int,y:int,width:int,height:int>, embedding array<double>")


def test_object_tracks(spark):
    # Gap 5.0 still joins, 5.01 does not; a track is compared by its last box only.
    df = boxes(spark, [(0, 0, None), (5, 4, None), (6, 8, None), (11.01, 8, None), (11.02, 0, None)])
    got = {r.idx: r.track for r in tracking.track_objects(df).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2}


def test_person_tracks(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    # Position beats the embedding; later the embedding decides; without either a new person.
    df = boxes(spark, [(0, 0, a), (1, 1, b), (20, 500, b), (40, 900, None), (60, 0, a)])
    got = {r.idx: r.person for r in tracking.track_persons(df).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0}


def test_face_scan(spark):
    files = spark.createDataFrame([("f", 200.0), ("short", 60.0), ("empty", 100.0)], "file_id string, duration double")
    a, b = [1.0, 0.0], [0.0, 1.0]
    det = boxes(spark, [(t, 0, a) for t in (1, 35, 65, 95.1)] + [(100, 900, b), (115.2, 900, b)])
    plan = tracking.plan_face_scan(files, det).orderBy("file_id", "window").collect()
    got = [(r.window, r.start, r.end, r.mode, r.n_faces, r.n_new) for r in plan if r.file_id == "f"]
    # New face, two consistent windows, then probes at 95 and 105; the face at 115.2 is new and turns it dense.
    assert got[:6] == [
        (0, 0, 30, "dense", 1, 1), (1, 30, 60, "dense", 1, 0), (2, 60, 90, "dense", 1, 0), (3, 90, 100, "sparse", 1, 0),
        (4, 100, 110, "sparse", 0, 0), (5, 110, 120, "sparse", 1, 1)]
    assert got[6][1:4] == (120, 150, "dense")
    assert [r.mode for r in plan if r.file_id == "empty"] == ["dense", "dense", "sparse", "sparse", "sparse", "sparse"]
    assert not [r for r in plan if r.file_id == "short"]


def test_face_scan_of_long_files_in_blocks(spark):
    rng = np.random.default_rng(5)
    vectors, rows = rng.normal(size=(6, 8)), []
    for f, (length, n) in enumerate([(400, 500), (95, 60), (60.5, 20), (700, 8), (250, 0), (180, 300)]):
        for i, t in enumerate(np.round(rng.random(n) * (length + 10) - 2, 2)):
            person = max(0, min(5, int(t // 100)))
            e = [None, [], vectors[rng.integers(0, person + 1)].tolist()][min(2, rng.integers(0, 12))]
            rows.append((f, float(t), i, [None, .5, float(rng.random())][min(2, rng.integers(0, 6))], tuple(map(int, rng.integers(0, 200, 4) + 20)), e))
    rows.append((None, 1.0, 0, .5, (1, 1, 9, 9), [1.0] * 8))
    det = spark.createDataFrame(rows, "file_id long, t double, idx long, confidence double, bbox struct<x:int,y:int,width:int,height:int>, embedding array<double>")
    files = spark.createDataFrame([(0, 400.0), (1, 95.0), (2, 60.5), (3, 700.0), (4, 250.0), (5, 180.0)], "file_id long, duration double")
    whole = sorted(map(tuple, tracking.plan_face_scan(files, det).collect()))
    assert {r[0] for r in whole} == set(range(6)) and {r[4] for r in whole} == {"dense", "sparse"}
    for options in ({"seconds": 30.0}, {"seconds": 100.0}, {"seconds": 60.0, "tol": 6.0, "sparse": 10.0}):
        rest = {k: v for k, v in options.items() if k != "seconds"}
        want = sorted(map(tuple, tracking.plan_face_scan(files, det, **rest).collect())) if rest else whole
        assert sorted(map(tuple, tracking.plan_face_scan(files, det, **options).collect())) == want


def test_face_scan_shuffles_embeddings_once(spark):
    det, files = boxes(spark, [(1, 0, [1.0, 0.0])]), spark.createDataFrame([("f", 100.0)], "file_id string, duration double")
    plan = tracking.plan_face_scan(files, det)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # the rows, then what windows found


def test_review_of_a_single_face(spark):
    best = spark.createDataFrame([("f", 0, .2, (0, 0, 9, 9), 1)], "file_id string, person long, confidence double, bbox struct<x:int,y:int,width:int,height:int>, n_detections long")
    flagged = aggregates.review_flags(best.withColumns({"frame_width": F.lit(100), "frame_height": F.lit(100)}))
    assert flagged.first()["review_reason"] == "single_detection"


def test_keyframes(spark):
    rows = [("one", 1.0), ("same", 2.0), ("same", 2.0)] + [("fixed", float(i)) for i in range(6)] + [("odd", x) for x in (0.0, 1.0, 5.0, 5.5)]
    df = spark.createDataFrame(rows, "file_id string, t double")
    got = {r.file_id: (r.n_keyframes, r.is_fixed_interval, r.avg_interval) for r in aggregates.keyframe_stats(df).collect()}
    assert got == {"one": (1, False, None), "same": (2, False, 0.0), "fixed": (6, True, 1.0), "odd": (4, False, 1.833)}


def test_vote_ties_and_blanks(spark):
    df = spark.createDataFrame([("f", 1.0, "b"), ("f", 2.0, "a"), ("f", 3.0, None), ("g", 1.0, None)], "file_id string, t double, label string")
    got = {r.file_id: (r.primary, r.confidence) for r in aggregates.vote(df).collect()}
    assert got == {"f": ("b", .333), "g": (None, None)}


def test_dominant_channel(spark):
    df = spark.createDataFrame([("f", 0, 0, 3.0), ("f", 0, 1, 2.0), ("f", 1, 0, 1.0), ("f", 1, 1, 0.0)], "file_id string, segment int, channel int, rms double")
    got = {r.segment: (r.channel, r.ratio) for r in aggregates.dominant_channel(df).collect()}
    assert got == {0: (0, 1.5), 1: (0, float("inf"))}


def test_forecast_defaults(spark):
    files = spark.createDataFrame([("b", "x", ["metadata", "vad", "visual", "objects"], None, None)], "batch_id string, file_id string, stages array<string>, bucket string, duration double")
    rates = spark.createDataFrame([("vad", "1080p", 2.0)], "extractor string, bucket string, rate double")
    got = {r.extractor: r.seconds for r in costs.forecast(files, rates).collect()}
    assert got == {"metadata": 1.0, "vad": 2.0, "visual": 25.0, "objects": pytest.approx(9.0)}


def test_expired_runs(spark):
    df = spark.createDataFrame([(1, "completed", 0.0), (2, "completed", 5000.0), (3, "active", None), (4, "failed", 0.0)], "id long, status string, completed_at double")
    assert [r.id for r in sampling.drop_expired(df, F.lit(5000.0)).collect()] == [2, 3]


def device(spark, path, tags=None, streams=(), **flags):
    schema = "file_id string, tags map<string,string>, streams array<struct<codec_type:string,codec_name:string,width:int,height:int,side_data:string,tags:map<string,string>>>"
    df = spark.createDataFrame([(path, tags or {}, list(streams))], schema)
    return attribute_device(df.withColumns({k: F.lit(v) for k, v in flags.items()})).first()


@pytest.mark.parametrize("path,tags,flags,rule,make,model,kind", [
    ("/a.mov", {"make": "Apple", "model": "iPhone 15"}, {}, "apple", "Apple", "iPhone 15", "phone"),
    ("/a.ari", {"x": "ALEXA Mini LF"}, {}, "arri", "ARRI", "ALEXA Mini", "cinema_camera"),
    ("/a.mp4", {"stereo_mode": "mono"}, {}, "camera_360", "Unknown 360 Camera", None, "360_camera"),
    ("/a.mp4", {"make": "Canon", "encoder": "Lavf58"}, {}, "canon", "Canon", None, "camera"),
    ("/DJI_1.mp4", {"encoder": "DJIMini3Pro"}, {}, "dji", "DJI", "Mini 3Pro", "drone"),
    ("/DJI_1.mp4", {}, {"has_gps": True}, "dji", "DJI", None, "drone"),
    ("/GH01.mp4", {"encoder": "Lavf58"}, {}, "ffmpeg", "FFmpeg", "Lavf58", "unknown"),
    ("/x.mp4", {"firmware": "H19.01"}, {}, "gopro", "GoPro", "MAX", "360_camera"),
    ("/A.RDM/b.mp4", {}, {}, "red", "RED", None, "cinema_camera"),
    ("/PRIVATE/AVCHD/BDMV/STREAM/1.MTS", {}, {}, "sony", "Sony", None, "camera"),
    ("/2023-01-02_03-04-05-back.mp4", {}, {}, "tesla", "Tesla", "Dashcam (rear)", "dashcam"),
    ("/x.mp4", {}, {"has_dashcam_event": True}, "tesla", "Tesla", "Dashcam", "dashcam"),
    ("/x.mp4", {"make": "Skydio"}, {}, "generic", "Skydio", None, "drone"),
    ("/x.mp4", {}, {}, "generic", None, None, None)])
def test_devices(spark, path, tags, flags, rule, make, model, kind):
    got = device(spark, path, tags, **flags)
    assert (got.rule, got.make, got.model, got.device_type) == (rule, make, model, kind)


def test_tape_and_panorama_streams(spark):
    def video(codec, w, h, tags=None):
        return ("video", codec, w, h, None, tags or {})

    assert device(spark, "/x.avi", {}, [video("dvvideo", 720, 576)]).model == "DV PAL Camcorder"
    assert device(spark, "/x.mpg", {"encoder": "hdv 720"}, [video("mpeg2video", 1, 1)]).model == "HDV 720p Camcorder"
    got = device(spark, "/x.mp4", {"make": "Insta"}, [video("h264", 3000, 3000), video("h264", 3000, 3000)])
    assert (got.make, got.model, got.software) == ("Insta360", "ONE RS", "unstitched dual-fisheye")


def test_user_rules(spark):
    book = default_rules().register("mine", F.lit(False), {"make": F.lit("me")})
    assert book.names()[-2:] == ["mine", "generic"]
    with pytest.raises(ValueError):
        book.register("odd", F.lit(True), {"colour": F.lit("red")})


def test_plugins(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "id long, text string")
    out = apply_model(df, lambda: 10, lambda m, pdf: pdf[["id"]].assign(y=pdf["id"] * m), "id long, y long")
    assert sorted(r.y for r in out.collect()) == [0, 10, 20, 30, 40]
    enc = apply_encoder(df, lambda: None, lambda m, s: [[float(len(x))] for x in s], "text", ["id"])
    assert enc.filter("id = 3").first().embedding == [6.0]
    import pandas as pd

    def detect(texts: pd.Series) -> pd.Series:
        return texts.str.contains("3").map({True: "de", False: "en"})

    register_language_detector("toy", detect)
    assert {r.id for r in gate_queries(df, "toy").filter("needs_translation").collect()} == {3}


def test_forecast_uses_every_rate(spark):
    files = spark.createDataFrame([("b", "f", 60.0, "1080p", ["color_grade"])], "batch_id string, file_id string, duration double, bucket string, stages array<string>")
    rates = spark.createDataFrame([("color_grade", "1080p", 7.0), ("color_grade", "1080p", 8.0)], "extractor string, bucket string, rate double")
    assert [r.seconds for r in costs.forecast(files, rates).collect()] == [7.5]


def test_status_counts_keep_other_names(spark):
    rows = spark.createDataFrame([("b", "e", "queued"), ("b", "e", "completed"), ("b", "e", None)], "batch_id string, extractor string, status string")
    got = aggregates.status_counts(rows).first()
    assert (got.completed, got.other) == (1, 2)


def test_plan_reaches_the_end_of_a_file_without_segments(spark):
    summary = spark.createDataFrame([("f", 1000.0, False, 1.0, 0)], "file_id string, duration double, is_stable boolean, mean_intensity double, n_segments long")
    segments = spark.createDataFrame([], "file_id string, start double, end double, intensity double")
    times = sorted(r.t for r in timeplans.adaptive_plan(summary, segments).collect())
    assert len(times) == 100 and times[-1] > 980


def test_top_k_skips_blocks_and_keeps_the_result():
    import numpy as np

    from rushes.operators.similarity import TopK

    rng = np.random.default_rng(4)

    def unit(m):
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    centres = unit(rng.normal(size=(12, 24)))
    m = unit(centres[rng.integers(0, 12, 5000)] + rng.normal(size=(5000, 24)) * 0.02)
    m[100:120] = m[7]  # ties
    q = unit(centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 24)) * 0.02)
    q[0] = m[7]
    ids = rng.permutation(5000)
    top = TopK(q, 5, budget=200_000)
    for i in range(0, 5000, 1250):
        top.add(ids[i : i + 1250], m[i : i + 1250])
    scores = np.round(q @ m.T, 12)
    got = top.rows(np.arange(300))
    for j in range(300):
        want = sorted(zip(-scores[j], ids))[:5]
        own = got[got["small_id"] == j]
        assert np.allclose(-own["similarity"], [s for s, _ in want], atol=1e-9)
        if j == 0:
            assert set(own["big_id"]) <= {int(x) for x in ids[[7, *range(100, 120)]]}
    assert top.products < 0.6 * top.pairs
