"""Reading and writing files."""

from __future__ import annotations

import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from rushes.operators import aggregates, joins, metadata
from rushes.sinks import files as sinks
from rushes.sources import files as sources

SRT = """1
00:00:00,000 --> 00:00:00,020
<font size="28">FrameCnt: 1
2025-10-15 11:36:32.281
[iso: 400] [shutter: 1/100.0] [fnum: 2.8] [color_md : d_log] [focal_len: 24.00]
[latitude: 61.05121] [longitude: 7.81233]
[rel_alt: 47.100 abs_alt: 380.003] </font>


2
00:00:00,500 --> x
[latitude: 61.1] [longitude: 7.8]

3
00:00:01,000 --> x
[latitude: 0.0] [longitude: 0.0]

4
00:00:01,500 --> x
[latitude: 61.2] [longitude: 7.9]

no time here

5
00:00:02,250 --> x
[latitude: 61.3] [longitude: 7.9]
"""


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_media_inventory(spark, tmp_path):
    for name in ("a/B.MP4", "a/c.txt", "a/.hidden.mp4", "d.wav"):
        write(tmp_path / name, "x" * 10)
    got = {r.name: (r.media_type, r.size) for r in sources.scan_media(spark, str(tmp_path)).collect()}
    assert got == {"B.MP4": ("video", 10), "c.txt": ("unknown", 10), "d.wav": ("audio", 10)}


def test_inventory_does_not_read_contents(spark, tmp_path):
    write(tmp_path / "a.mp4", "x")
    plan = sources.scan_media(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_probe_documents(spark, tmp_path):
    good = {
        "format": {"duration": "12.5", "bit_rate": "1000", "tags": {"Make": "Sony", "location": "+59.5+010.2/"}},
        "streams": [
            {"codec_type": "audio", "codec_name": "aac", "sample_rate": "0", "tags": {"TIMECODE": "01:00:00:00"}},
            {"codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080, "avg_frame_rate": "0/0",
             "r_frame_rate": "30000/1001", "pix_fmt": "yuv420p", "tags": {"creation_time": "2024-01-02T03:04:05Z"}},
        ],
    }
    write(tmp_path / "p/a.json", json.dumps(good))
    write(tmp_path / "p/b.json", "{broken")
    probe = sources.scan_probe(spark, str(tmp_path / "p"))
    assert {r.file_id.rsplit("/", 1)[1]: r.error for r in probe.collect()} == {"a.json": None, "b.json": "unreadable probe document"}
    row = metadata.base_metadata(metadata.lower_tags(probe.filter("error IS NULL"))).first()
    assert (row.duration, row.width, row.fps, row.bit_depth, row.timecode) == (12.5, 1920, 29.97, 8, "01:00:00:00")
    assert row.sample_rate is None and row.gps.latitude == 59.5 and str(row.created_at) == "2024-01-02 03:04:05"
    files = spark.createDataFrame([(str(tmp_path / "p/a.json"),), ("/gone",)], "file_id string")
    errors = {r.file_id: r.error for r in joins.with_probe(files, probe).collect()}
    assert errors == {str(tmp_path / "p/a.json"): None, "/gone": "no probe result"}


def test_subtitle_telemetry(spark, tmp_path):
    write(tmp_path / "DJI_1.SRT", SRT)
    points = sources.scan_srt(spark, str(tmp_path)).orderBy("t").collect()
    # The block at 1.0 has no position but uses up its slot, so 1.5 is skipped.
    assert [p.t for p in points] == [0.0, 2.25]
    first = points[0]
    assert (first.iso, first.shutter, first.aperture, first.altitude, first.color_mode) == (400, 0.01, 2.8, 380.003, "d_log")
    assert first.recorded_at.microsecond == 281000
    track = metadata.srt_track(sources.scan_texts(spark, str(tmp_path))).orderBy("idx").collect()
    assert [(p.latitude, p.altitude) for p in track] == [(61.05121, 380.0), (61.1, None), (61.2, None), (61.3, None)]
    head = aggregates.telemetry_header(sources.scan_srt(spark, str(tmp_path)), "drone").first()
    assert (head.duration, head.n_points, head.sample_rate) == (2.25, 2, 1.0)


def test_exposure_subtitles(spark, tmp_path):
    write(tmp_path / "a.srt", "1\n00:00:00,000 --> x\nF/1.8, SS 200.0, ISO 110, EV\n\n2\n00:00:02,000 --> x\nnothing\n")
    rows = sources.scan_exposure_srt(spark, str(tmp_path)).collect()
    assert [(r.t, r.aperture, r.shutter, r.iso, r.latitude) for r in rows] == [(0.0, 1.8, 0.005, 110, 0.0)]


def test_sidecars(spark, tmp_path):
    sony = '<N xmlns="urn:p"><Device manufacturer="Sony" modelName="{}"/><Group name="GPSinExif"><Item name="Status" value="{}"/><Item name="LatitudeRef" value="S"/><Item name="Latitude" value="1;30:0"/><Item name="LongitudeRef" value="E"/><Item name="Longitude" value="2;0;0"/></Group></N>'
    write(tmp_path / "s/C1M01.XML", sony.format("second", "A"))
    write(tmp_path / "s/C1.XML", sony.format("first", "V"))
    write(tmp_path / "s/C2M01.xml", sony.format("third", "A"))
    rows = joins.pick_candidate(sources.scan_sony_xml(spark, str(tmp_path / "s")), ["dir", "stem"]).collect()
    got = {r.stem: (r.model, r.gps and (r.gps.latitude, r.gps.longitude)) for r in rows}
    assert got == {"C1": ("first", None), "C2": ("third", (-1.5, 2.0))}
    write(tmp_path / "c/A.XML", "<V><Device><Manufacturer>Canon</Manufacturer></Device><CreationDate>x</CreationDate><Date>2023-05-15</Date><Location><Latitude>1</Latitude><Longitude>2</Longitude><Altitude>3</Altitude></Location></V>")
    row = sources.scan_canon_xml(spark, str(tmp_path / "c")).first()
    assert (row.make, str(row.created_at), row.gps.altitude) == ("Canon", "2023-05-15 00:00:00", 3.0)
    write(tmp_path / "t/event.json", json.dumps({"est_lat": "0", "est_lon": "5", "reason": "honk"}))
    row = sources.scan_event_json(spark, str(tmp_path / "t")).first()
    assert (row.latitude, row.has_dashcam_event, row.dir) == (None, True, str(tmp_path / "t"))


def test_keyframes_and_log(spark, tmp_path):
    write(tmp_path / "k.txt", "0.5\n\nN/A\n 1.5 \n")
    assert sorted(r.t for r in sources.scan_keyframes(spark, str(tmp_path)).collect()) == [0.5, 1.5]
    lines = spark.createDataFrame([(i, f"x {'ERROR' if i % 50 == 0 else 'INFO'} y") for i in range(200)], "line_no long, line string")
    assert sources.tail_log(lines, 5).count() == 5
    assert [r.line_no for r in sources.tail_log(lines, 10, "error").collect()] == [150, 100, 50, 0]


def test_pcm_frames(spark, tmp_path):
    samples = (np.sin(np.arange(16000 * 2 // 10 + 7) / 3) * 8000).astype("<i2")
    for name, channels in (("mono.wav", 1), ("stereo.wav", 2)):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(16000)
            w.writeframes(samples.tobytes())
    rows = sources.scan_pcm(spark, str(tmp_path), max_s=0.15).collect()
    frames = sorted((r.i, r.samples) for r in rows if r.error is None)
    assert [i for i, _ in frames] == list(range(5))
    assert frames[1][1] == samples[480:960].tolist()
    assert [r.error for r in rows if "stereo" in r.file_id] == ["not mono 16-bit audio"]


def test_gpx(spark, tmp_path):
    df = spark.createDataFrame(
        [("f", float(t), 1.5, 2.5, float(t % 2)) for t in range(9)], "file_id string, t double, latitude double, longitude double, altitude double")
    df = df.withColumn("recorded_at", F.lit("2024-01-02 03:04:05.678").cast("timestamp_ntz"))
    sinks.write_gpx(df, str(tmp_path / "out"), partitions=3)
    parts = sorted((tmp_path / "out" / "file_id=f").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert text.startswith("<?xml") and text.rstrip().endswith("</gpx>")
    points = [line.strip() for line in text.splitlines() if "<trkpt" in line]
    assert len(points) == 9 and points[0] == '<trkpt lat="1.5" lon="2.5"><time>2024-01-02T03:04:05.678Z</time></trkpt>'
    assert "<ele>1.0</ele>" in points[1]


def test_documents(spark, tmp_path):
    files = spark.createDataFrame([("f", "completed"), ("g", "failed")], "file_id string, status string")
    rows = spark.createDataFrame([("f", i, f"x{i}") for i in range(7)], "file_id string, idx long, label string")
    nested = sinks.nest(rows, "objects", ["idx"], part_rows=3)
    meta = spark.createDataFrame([("f", 2.0)], "file_id string, duration double")
    docs = sinks.assemble_documents(files, {"metadata": meta}, {"objects": nested})
    sinks.write_documents(docs, str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d"))
    got = {(r.file_id, r.part): r.results.objects and [o.idx for o in r.results.objects] for r in back.collect()}
    assert got == {("f", 0): [0, 1, 2], ("f", 1): [3, 4, 5], ("f", 2): [6], ("g", 0): None}
    view = sinks.status_view(back)
    assert view.columns == ["file_id", "status", "part"]
    assert "results" not in view._jdf.queryExecution().executedPlan().toString()


def test_rate_history(spark, tmp_path):
    for start in (0, 15):
        rates = spark.createDataFrame(
            [("objects", "4k", float(i), float(i), i) for i in range(start, start + 15)],
            "extractor string, bucket string, rate double, started_at double, idx long")
        sinks.save_rates(rates, str(tmp_path / "r"))
    assert sorted(r.rate for r in sinks.load_rates(spark, str(tmp_path / "r")).collect()) == [float(i) for i in range(10, 30)]


@pytest.mark.parametrize("stop", [0, 1])
def test_bad_rows_go_to_the_error_sink(spark, tmp_path, stop):
    from rushes.streaming.streams import stream_ingest

    write(tmp_path / "in/a.json", '{"a": 1}\n{bad\n{"a": 2}\n')
    args = [str(tmp_path / x) for x in ("rows", "errors", "checkpoint")]
    stream_ingest(spark, str(tmp_path / "in"), "a long", *args).awaitTermination()
    if stop:
        write(tmp_path / "in/b.json", '{"a": 3}\n')
        stream_ingest(spark, str(tmp_path / "in"), "a long", *args).awaitTermination()
    assert sorted(r.a for r in spark.read.parquet(args[0]).collect()) == ([1, 2, 3] if stop else [1, 2])
    assert [r.value for r in spark.read.text(args[1]).filter("value <> ''").collect()] == ["{bad"]


def test_described_files(spark, tmp_path):
    from rushes.operators.describe import describe_files

    video = {"codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080}

    def probe(name, **tags):
        write(tmp_path / f"probe/{name}.json", json.dumps({"format": {"duration": "5", "tags": tags}, "streams": [video]}))

    probe("a", comment="DE=D-LOG, HQ=x")
    probe("b", **{"com.sony.bprl.mxf.nrtmetadata": '<Device manufacturer="Sony" modelName="EX1"/><Lens modelName="XT14"/>'})
    probe("c", creation_time="2020-01-01T00:00:00Z")
    probe("d")
    probe("e")
    probe("f")
    path = {"a": "/m/DJI_1.mp4", "b": "/m/b.mxf", "c": "/m/c.mxf", "d": "/m/A001H200529X.mxf", "e": "/m/e.mp4", "f": "/t/f.mp4"}
    paths = F.create_map(*[F.lit(x) for kv in path.items() for x in kv])
    docs = sources.scan_probe(spark, str(tmp_path / "probe"))
    docs = docs.withColumn("file_id", F.element_at(paths, F.regexp_extract("file_id", r"(\w)\.json", 1))).drop("error")
    srt = metadata.srt_summary(spark.createDataFrame([("/m/DJI_1.SRT", SRT)], "file_id string, text string"))
    srt = srt.withColumns({"dir": F.lit("/m"), "stem": F.lit("DJI_1")}).drop("file_id")
    canon = "<V xmlns='http://www.canon.com/ns'><Device><ModelName>C70</ModelName></Device><Date>2023-05-15</Date></V>"
    for name in ("c", "A001H200529X"):
        write(tmp_path / f"x/{name}.XML", canon if name == "c" else canon.replace("<Date>2023-05-15</Date>", ""))
    write(tmp_path / "x/eM01.XML", '<N><Device manufacturer="Sony" modelName="A7"/><Item name="CaptureGammaEquation" value="s-log3"/></N>')
    here = F.lit("/m")
    sony_x, canon_x = [f(spark, str(tmp_path / "x")).withColumn("dir", here) for f in (sources.scan_sony_xml, sources.scan_canon_xml)]
    events = spark.createDataFrame([("/t", "1.5", "2.5", "honk")], "dir string, est_lat string, est_lon string, reason string")
    out = {r.file_id: r for r in describe_files(docs, srt, sony_x, canon_x, sources.event_positions(events)).collect()}
    drone = out["/m/DJI_1.mp4"]
    assert (drone.rule, drone.device_type, drone.gps.latitude, drone.color_space.transfer, drone.n_track_points) == (
        "dji", "drone", 61.05121, "d_log", 4)
    assert (out["/m/b.mxf"].rule, out["/m/b.mxf"].model, out["/m/b.mxf"].lens_model) == ("sony", "EX1", "XT14")
    assert (out["/m/c.mxf"].rule, out["/m/c.mxf"].model, out["/m/c.mxf"].created_at.year) == ("canon", "C70", 2020)
    assert str(out["/m/A001H200529X.mxf"].created_at.date()) == "2020-05-29"
    assert (out["/m/e.mp4"].rule, out["/m/e.mp4"].make, out["/m/e.mp4"].color_space.transfer) == ("sony", "Sony", "s-log3")
    assert (out["/t/f.mp4"].rule, out["/t/f.mp4"].gps.longitude) == ("tesla", 2.5)
    bare = {r.file_id: r for r in describe_files(docs).collect()}
    assert bare["/m/DJI_1.mp4"].color_space.transfer == "D-Log" and bare["/t/f.mp4"].rule == "generic"


def test_gpx_documents_are_xml(spark, tmp_path):
    import xml.etree.ElementTree as ET

    rows = [("f", float(t), 1.5, 2.5, 3.0) for t in range(40)] + [("g", 0.0, 1.0, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "file_id string, t double, latitude double, longitude double, altitude double")
    sinks.write_gpx(df.withColumn("recorded_at", F.lit("2024-01-02 03:04:05.678").cast("timestamp_ntz")).repartition(5), str(tmp_path / "out"))
    for name, n in (("f", 40), ("g", 1)):
        (doc,) = (tmp_path / "out" / f"file_id={name}").glob("part-*")
        assert len(ET.parse(doc).getroot().findall("trk/trkseg/trkpt")) == n


def test_rate_history_does_not_grow(spark, tmp_path):
    path = str(tmp_path / "r")
    schema = "extractor string, bucket string, rate double, started_at double, idx long"
    for start in range(0, 120, 30):
        sinks.save_rates(spark.createDataFrame([("vad", "4k", float(i), float(i), i) for i in range(start, start + 30)], schema), path)
    sinks.save_rates(spark.createDataFrame([("ocr", "4k", 1.0, 1.0, 1)], schema), path)
    assert spark.read.parquet(path).count() == 21
    assert sorted(r.rate for r in sinks.load_rates(spark, path).collect()) == [1.0, *map(float, range(100, 120))]


def test_sidecars_are_parsed_once_and_broken_ones_give_nulls(spark):
    from rushes.functions import tags as tg

    sony = '<a:N xmlns:a="x"><a:Device manufacturer=""/><Device manufacturer="Z"/><Group name="GPSinExif"><Item name="Altitude" value="1"/></Group>' \
        '<Group name="ExifGPS"><Item name="Latitude" value="5"/><Item name="Latitude" value="7"/><Item name="Longitude" value="&#56;"/></Group></a:N>'
    canon = '<c:V xmlns:c="http://c"><Device/><Device><ModelName>no</ModelName></Device><Location><c:Latitude>1<!-- x -->2</c:Latitude><Longitude>3</Longitude></Location></c:V>'
    df = spark.createDataFrame([(1, sony, canon), (2, "<N>", "<V>"), (3, None, None), (4, "", "")], "id int, s string, c string")
    read = df.select("id", tg.parse_sony_xml("s").alias("s"), tg.parse_canon_xml("c").alias("c"), tg.parse_embedded_xml("s").alias("e"))
    rows = read.orderBy("id").collect()
    assert rows[0].s.make is None and tuple(rows[0].s.gps) == (7.0, 8.0, None)
    assert rows[0].c.model is None and tuple(rows[0].c.gps) == (12.0, 3.0, None) and not rows[0].c.is_canon
    assert all(r.s.gps is None and r.s.model is None and r.c.created_at is None and r.e.make is None for r in rows[1:])
    plan = df.select(tg.parse_canon_xml("c"), tg.parse_sony_xml("s"))._jdf.queryExecution().executedPlan().toString()
    assert "xpath" not in plan


def test_subtitle_texts_are_read_once_without_a_shuffle(spark):
    from rushes.operators import metadata

    point = "[latitude: {}] [longitude: {}] abs_alt: {}"
    texts = [
        (1, "\n\n".join(point.format(*p) for p in [(0, 0, 1), (1, 2, 3), (1, 2, 4), ("1-", 2, 5), (1, 3, 6), (1, 2, 7)])),
        (2, "[latitude: 1] [latitude: 2] [longitude: 1]"), (3, None), (4, "[color_md : d_log]"),
    ]
    df = spark.createDataFrame(texts, "file_id int, text string").withColumn("text", F.concat("text", F.lit("")))
    track = metadata.srt_track(df)
    assert sorted(map(tuple, track.collect())) == [(1, 1, 1.0, 2.0, 3.0), (1, 4, 1.0, 3.0, 6.0), (1, 5, 1.0, 2.0, 7.0)]
    summary = metadata.srt_summary(df)
    assert [(r.file_id, r.transfer, r.gps and tuple(r.gps), r.n_track_points) for r in summary.orderBy("file_id").collect()] == [
        (1, None, (1.0, 2.0, 3.0), 3), (4, "d_log", None, 0)]
    for out in (track, summary):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan and plan.count("concat(") == 1


def test_packed_documents_equal_one_file_each(spark, tmp_path):
    from rushes.sinks import files as sinks

    texts = ['{"format":{"duration":"1.5","tags":{"Model":"x"}},"streams":[{"codec_type":"video","width":3}]}', '{"format":{"dura', "not json"]
    (tmp_path / "p").mkdir()
    for i, text in enumerate(texts):
        (tmp_path / f"p/{i}.json").write_text(text)
    rows = [(str(tmp_path / f"p/{i}.json"), text) for i, text in enumerate(texts)]
    packed = sources.probe_documents(spark.createDataFrame([*rows, ("none", None)], "file_id string, text string"))
    one_each = sorted(map(tuple, sources.scan_probe(spark, str(tmp_path / "p")).select("file_id", "format.duration", "streams.width", "error").collect()))
    got = sorted(map(tuple, packed.select("file_id", "format.duration", "streams.width", "error").collect()))
    assert [r for r in got if r[0] != "none"] == one_each and [r[3] for r in got if r[0] == "none"] == ["unreadable probe document"]
    points = spark.createDataFrame([(f % 3, float(f * 7 % 5), 1.0, f / 4, 0.0, None) for f in range(40)],
                                   "file_id int, t double, latitude double, longitude double, altitude double, recorded_at timestamp_ntz")
    sinks.write_gpx(points, str(tmp_path / "g"))
    sinks.write_gpx_packs(points, str(tmp_path / "packs"))
    want = spark.read.text(str(tmp_path / "g"), wholetext=True).select(F.col("file_id").cast("int"), "value").collect()
    got = sinks.read_gpx_packs(spark, str(tmp_path / "packs")).collect()
    assert sorted((r.file_id, r.text) for r in got) == sorted(map(tuple, want)) and {r.n_files for r in got} == {1}
    assert len(list((tmp_path / "packs").glob("*.parquet"))) <= 4
