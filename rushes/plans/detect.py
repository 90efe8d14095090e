"""Detections: filters, boxes, tracks, people, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from rushes.functions import arrays, media
from rushes.operators import aggregates, joins, sampling, similarity, tracking
from rushes.plans.bindings import CENTRES, DETS, FILES, OBS, detections, durations, faces, label_centres, table
from rushes.plans.registry import query

IOU = """CASE WHEN least({a}.x + {a}.w, {b}.x + {b}.w) > greatest({a}.x, {b}.x)
           AND least({a}.y + {a}.h, {b}.y + {b}.h) > greatest({a}.y, {b}.y)
      THEN ((least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))
            * (least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))::DOUBLE
         / ({a}.w * {a}.h + {b}.w * {b}.h
            - (least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))
            * (least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))
      ELSE 0 END"""


@query("keep_detections", "WITH " + DETS + """
SELECT file_id, round(t, 2) AS t, idx, label, round(confidence, 3) AS confidence, w::INT AS width, h::INT AS height
FROM dets WHERE confidence >= 0.6 AND w >= 80 AND h >= 80""")
def keep_detections(spark, sf_dir):
    kept = media.emit_rounding(media.keep_detections(detections(spark, sf_dir), 0.6, 80))
    return kept.select("file_id", "t", "idx", "label", "confidence", "bbox.width", "bbox.height")


@query("box_functions", "WITH " + DETS + """, a AS (
  SELECT *, {'x': 30, 'y': 20, 'w': 100, 'h': 100} AS o FROM dets)
SELECT idx, round(""" + IOU.format(a="a", b="o") + """, 6) AS iou,
       x < 32 OR y < 18 OR x + w > 640 - 32 OR y + h > 360 - 18 AS near_edge,
       greatest(0, x - floor(w * 0.3))::INT AS x1, greatest(0, y - floor(h * 0.3))::INT AS y1,
       least(200, x + w + floor(w * 0.3))::INT AS x2, least(160, y + h + floor(h * 0.3))::INT AS y2
FROM a""")
def box_functions(spark, sf_dir):
    det = detections(spark, sf_dir)
    other = media.box(F.lit(30), F.lit(20), F.lit(100), F.lit(100))
    padded = media.pad_box("bbox", F.lit(200), F.lit(160))
    return det.select(
        "idx", F.round(media.box_iou("bbox", other), 6).alias("iou"),
        media.near_edge("bbox", F.lit(640), F.lit(360)).alias("near_edge"), padded.alias("p"),
    ).select("idx", "iou", "near_edge", "p.*")


@query("polygon_to_box", "WITH " + DETS + """
SELECT idx, x::INT AS x, trunc(y + 0.25)::INT AS y, trunc(w + 0.75)::INT AS width, trunc(y + h + 0.5 - y)::INT AS height FROM dets""")
def polygon_to_box(spark, sf_dir):
    det = detections(spark, sf_dir).select("idx", "bbox.*")
    x, y, w, h = F.col("x"), F.col("y"), F.col("width"), F.col("height")

    def point(px, py):
        return F.struct(px.cast("double").alias("x"), py.cast("double").alias("y"))

    polygon = F.array(point(x, y + 0.25), point(x + w + 0.75, y + 0.5), point(x + w, y + h + 0.5), point(x + 0.5, y + h))
    return det.select("idx", media.polygon_to_box(polygon).alias("b")).select("idx", "b.*")


@query("track_edges", "WITH " + DETS + """
SELECT a.file_id, a.label, a.idx AS idx_a, b.idx AS idx_b, round(""" + IOU.format(a="a", b="b") + """, 6) AS iou
FROM dets a JOIN dets b ON a.file_id = b.file_id AND a.label = b.label AND b.t - a.t BETWEEN 0 AND 5
  AND (a.t < b.t OR (a.t = b.t AND a.idx < b.idx))
WHERE """ + IOU.format(a="a", b="b") + " >= 0.3")
def track_edges(spark, sf_dir):
    edges = joins.track_edges(detections(spark, sf_dir))
    return edges.select("file_id", "label", "idx_a", "idx_b", F.round("iou", 6).alias("iou"))


# Tracks step by step: the state is the list of tracks with the last time and box of each.
TRACKS = "WITH RECURSIVE " + DETS + """, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY file_id, label ORDER BY t, idx) AS rn FROM dets
), walk AS (
  SELECT file_id, label, rn, idx, confidence, t, 1::BIGINT AS track,
         [{'t': t, 'x': x, 'y': y, 'w': w, 'h': h}] AS live
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT file_id, label, rn, idx, confidence, t,
         CASE WHEN hit IS NULL THEN len(live) + 1 ELSE hit END,
         CASE WHEN hit IS NULL THEN list_append(live, me)
              ELSE list_concat(list_append(live[1:hit - 1], me), live[hit + 1:]) END
  FROM (
    SELECT o.file_id, o.label, o.rn, o.idx, o.confidence, o.t, w.live,
           {'t': o.t, 'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h} AS me,
           list_position(list_transform(w.live, lambda p: o.t - p.t <= 5 AND """ + IOU.format(a="o", b="p") + """ >= 0.3), true) AS hit
    FROM walk w JOIN ordered o ON o.file_id = w.file_id AND o.label = w.label AND o.rn = w.rn + 1)
), tracks AS (SELECT file_id, label, idx, t, confidence, track - 1 AS track FROM walk)"""


@query("track_objects", TRACKS + "\nSELECT file_id, label, idx, track::BIGINT AS track FROM tracks")
def track_objects(spark, sf_dir):
    return tracking.track_objects(detections(spark, sf_dir)).select("file_id", "label", "idx", "track")


@query("object_summary", TRACKS + "\nSELECT file_id, label, count(DISTINCT track)::BIGINT AS n_tracks FROM tracks GROUP BY ALL")
def object_summary(spark, sf_dir):
    return aggregates.object_summary(tracking.track_objects(detections(spark, sf_dir)))


@query("best_of", TRACKS + """, ranked AS (
  SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY file_id, label, track) AS n
  FROM tracks WINDOW w AS (PARTITION BY file_id, label, track ORDER BY confidence DESC, t, idx))
SELECT file_id, label, track::BIGINT AS track, idx, round(confidence, 3) AS confidence, n::BIGINT AS n_detections
FROM ranked WHERE r = 1""")
def best_of(spark, sf_dir):
    tracks = tracking.track_objects(detections(spark, sf_dir))
    best = aggregates.best_of(tracks, ["file_id", "label", "track"])
    return best.select("file_id", "label", "track", "idx", F.round("confidence", 3).alias("confidence"), "n_detections")


@query("top_labels", TRACKS + """
SELECT label, count(*)::BIGINT AS n_tracks FROM (SELECT DISTINCT file_id, label, track FROM tracks) GROUP BY label
ORDER BY n_tracks DESC, label LIMIT 15""")
def top_labels(spark, sf_dir):
    tracks = tracking.track_objects(detections(spark, sf_dir)).select("file_id", "label", "track").distinct()
    return aggregates.top_labels(tracks)


@query("sort_by_time", "WITH " + DETS + "\nSELECT file_id, idx, round(t, 2) AS t, label FROM dets")
def sort_by_time(spark, sf_dir):
    return sampling.sort_by_time(detections(spark, sf_dir)).select("file_id", "idx", F.round("t", 2).alias("t"), "label")


# People step by step: every earlier face that could decide is listed first, the walk then looks up its person.
PERSONS = "WITH RECURSIVE " + DETS + """, faces AS MATERIALIZED (
  SELECT d.*, e.embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY file_id ORDER BY t, idx) AS rn
  FROM dets d JOIN embeddings e ON e.vec_id = d.idx % (SELECT count(*) FROM embeddings)
), pairs AS (
  SELECT a.file_id, a.rn, b.rn AS other, a.t - b.t <= 5 AND """ + IOU.format(a="a", b="b") + """ >= 0.2 AS placed,
         1 - list_cosine_similarity(a.v, b.v) AS dist
  FROM faces a JOIN faces b ON a.file_id = b.file_id AND b.rn < a.rn
), hints AS MATERIALIZED (
  SELECT file_id, rn, coalesce(list(other) FILTER (placed), []) AS near,
         coalesce(list({'d': dist, 'r': other}) FILTER (dist < 0.8), []) AS alike
  FROM pairs GROUP BY file_id, rn
), walk AS (
  SELECT file_id, rn, idx, t, confidence, x, y, w, h, [0::BIGINT] AS persons, 0::BIGINT AS person
  FROM faces WHERE rn = 1
  UNION ALL
  SELECT file_id, rn, idx, t, confidence, x, y, w, h, list_append(persons, p), p
  FROM (
    SELECT f.file_id, f.rn, f.idx, f.t, f.confidence, f.x, f.y, f.w, f.h, k.persons,
           coalesce(list_min(list_transform(g.near, lambda r: k.persons[r])),
                    list_sort(list_transform(g.alike, lambda s: {'d': s.d, 'p': k.persons[s.r]}))[1].p,
                    list_max(k.persons) + 1) AS p
    FROM walk k JOIN faces f ON f.file_id = k.file_id AND f.rn = k.rn + 1
         JOIN hints g ON g.file_id = f.file_id AND g.rn = f.rn)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file_id, person ORDER BY confidence DESC, t, idx) AS r,
         count(*) OVER (PARTITION BY file_id, person) AS n, count(*) OVER (PARTITION BY file_id) AS total
  FROM walk
), best AS (
  SELECT file_id, person, idx, n AS n_detections, CASE WHEN total = 1 THEN 'single_detection' ELSE nullif(concat_ws(', ',
           CASE WHEN x < 12 OR y < 10 OR x + w > 240 - 12 OR y + h > 200 - 10 THEN 'near_edge' END,
           CASE WHEN confidence < 0.95 THEN 'low_confidence' END,
           CASE WHEN n = 1 THEN 'single_detection' END), '') END AS review_reason
  FROM ranked WHERE r = 1)"""


@query("track_persons", PERSONS + "\nSELECT file_id, idx, person FROM walk")
def track_persons(spark, sf_dir):
    return tracking.track_persons(faces(spark, sf_dir), emb=0.8).select("file_id", "idx", "person")


def best_faces(spark, sf_dir):
    people = tracking.track_persons(faces(spark, sf_dir), emb=0.8)
    best = aggregates.best_of(people.drop("embedding"), ["file_id", "person"])
    sized = best.withColumns({"frame_width": F.lit(240), "frame_height": F.lit(200)})
    return aggregates.review_flags(sized)


@query("review_flags", PERSONS + """
SELECT file_id, person, idx, review_reason, review_reason IS NOT NULL AS needs_review, n_detections FROM best""")
def review_flags(spark, sf_dir):
    return best_faces(spark, sf_dir).select("file_id", "person", "idx", "review_reason", "needs_review", "n_detections")


@query("face_summary", PERSONS + """
SELECT file_id, sum(n_detections)::BIGINT AS n_detections, count(*)::BIGINT AS n_persons,
       count(review_reason)::BIGINT AS n_review FROM best GROUP BY file_id""")
def face_summary(spark, sf_dir):
    return aggregates.face_summary(best_faces(spark, sf_dir))


# All windows that a scan may come to, each with the best face of every person in it; then the scan itself.
FACE_SCAN = "WITH RECURSIVE " + DETS + """, """ + FILES + """, long AS (SELECT * FROM files WHERE duration > 60), faces AS MATERIALIZED (
  SELECT d.*, e.embedding::DOUBLE[] AS v, l.duration FROM dets d JOIN embeddings e ON e.vec_id = d.idx % (SELECT count(*) FROM embeddings)
    JOIN long l ON l.file_id = d.file_id
), steps AS (SELECT *, unnest(range(greatest(0, floor(t / 10)::BIGINT - 3), floor(t / 10)::BIGINT + 2)) AS step FROM faces
), looks AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY file_id, step, mode ORDER BY t, idx) AS rn FROM (
    SELECT *, 'dense' AS mode FROM steps WHERE t >= step * 10 AND t < least(step * 10 + 30, duration)
    UNION ALL SELECT *, 'sparse' FROM steps WHERE t >= step * 10 + 5.0::DOUBLE - 0.35::DOUBLE AND t <= step * 10 + 5.0::DOUBLE + 0.35::DOUBLE)
  WHERE step * 10 < duration
), hints AS MATERIALIZED (
  SELECT a.file_id, a.step, a.mode, a.rn, coalesce(list(b.rn) FILTER (a.t - b.t <= 5 AND """ + IOU.format(a="a", b="b") + """ >= 0.2), []) AS near,
         coalesce(list({'d': 1 - list_cosine_similarity(a.v, b.v), 'r': b.rn}) FILTER (1 - list_cosine_similarity(a.v, b.v) < 0.5), []) AS alike
  FROM looks a LEFT JOIN looks b ON a.file_id = b.file_id AND a.step = b.step AND a.mode = b.mode AND b.rn < a.rn GROUP BY ALL
), walk AS (
  SELECT file_id, step, mode, rn, idx, t, confidence, v, [0::BIGINT] AS persons, 0::BIGINT AS person FROM looks WHERE rn = 1
  UNION ALL
  SELECT file_id, step, mode, rn, idx, t, confidence, v, list_append(persons, p), p FROM (
    SELECT f.file_id, f.step, f.mode, f.rn, f.idx, f.t, f.confidence, f.v, k.persons,
           coalesce(list_min(list_transform(g.near, lambda r: k.persons[r])),
                    list_sort(list_transform(g.alike, lambda s: {'d': s.d, 'p': k.persons[s.r]}))[1].p, list_max(k.persons) + 1) AS p
    FROM walk k JOIN looks f ON f.file_id = k.file_id AND f.step = k.step AND f.mode = k.mode AND f.rn = k.rn + 1
         JOIN hints g ON g.file_id = f.file_id AND g.step = f.step AND g.mode = f.mode AND g.rn = f.rn)
), seen AS MATERIALIZED (
  SELECT file_id, step, mode, list(v ORDER BY person) AS faces FROM (
    SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY file_id, step, mode, person ORDER BY confidence DESC, t, idx) = 1) GROUP BY ALL
), scan AS (
  SELECT file_id, duration, 0::BIGINT AS number, 0::BIGINT AS step, 'dense' AS mode, 0::BIGINT AS quiet, []::DOUBLE[][] AS known, NULL::BIGINT AS start_step,
         NULL::VARCHAR AS was, NULL::BIGINT AS n_faces, NULL::BIGINT AS n_new FROM long
  UNION ALL
  SELECT file_id, duration, number + 1, step + CASE mode WHEN 'dense' THEN 3 ELSE 1 END,
         CASE WHEN len(fresh) > 0 THEN 'dense' WHEN counts AND quiet + 1 >= 2 THEN 'sparse' ELSE mode END,
         CASE WHEN len(fresh) > 0 THEN 0 WHEN counts THEN quiet + 1 ELSE quiet END, list_concat(known, fresh), step, mode, len(faces), len(fresh)
  FROM (SELECT *, (len(faces) > 0) = (len(known) > 0) AS counts,
               list_filter(faces, lambda v: len(list_filter(known, lambda n: 1 - list_cosine_similarity(n, v) < 0.8)) = 0) AS fresh
        FROM (SELECT s.*, coalesce(w.faces, []) AS faces FROM scan s LEFT JOIN seen w ON w.file_id = s.file_id AND w.step = s.step AND w.mode = s.mode
              WHERE s.step * 10 < s.duration)))
SELECT file_id, number - 1 AS "window", start_step * 10.0::DOUBLE AS "start",
       least(start_step * 10.0::DOUBLE + CASE was WHEN 'dense' THEN 30 ELSE 10 END, duration) AS "end", was AS mode, n_faces, n_new, n_new = 0 AS all_known
FROM scan WHERE number > 0"""


@query("plan_face_scan", FACE_SCAN)
def plan_face_scan(spark, sf_dir):
    return tracking.plan_face_scan(durations(spark, sf_dir), faces(spark, sf_dir), emb=0.8)


@query("text_frames", "WITH " + DETS + """, frames AS (
  SELECT file_id, floor(t)::BIGINT AS t, count(*)::BIGINT AS n_regions,
         count(*) FILTER (h <> 0 AND w::DOUBLE / h BETWEEN 0.2 AND 15 AND w * h BETWEEN 100 AND 50000)::BIGINT AS n_text_like
  FROM (SELECT file_id, t, w * 2 AS w, h * (idx % 3) AS h FROM dets) GROUP BY ALL)
SELECT *, n_regions >= 3 AND n_text_like >= 3 AS has_text FROM frames""")
def text_frames(spark, sf_dir):
    return media.text_frames(regions(spark, sf_dir))


def regions(spark, sf_dir):
    """Text regions per second of a file, a third of them without height."""
    det = detections(spark, sf_dir)
    return det.select(
        "file_id", F.floor("t").alias("t"), (F.col("bbox.width") * 2).alias("width"),
        (F.col("bbox.height") * (F.col("idx") % 3)).cast("int").alias("height"),
    )


@query("prefilter_report", "WITH " + DETS + """, frames AS (
  SELECT file_id, floor(t) AS t, count(*) >= 3 AND count(*) FILTER (
           h <> 0 AND w::DOUBLE / h BETWEEN 0.2 AND 15 AND w * h BETWEEN 100 AND 50000) >= 3 AS has_text
  FROM (SELECT file_id, t, w * 2 AS w, h * (idx % 3) AS h FROM dets) GROUP BY file_id, floor(t))
SELECT file_id, count(*)::BIGINT AS frames_checked, count(*) FILTER (NOT has_text)::BIGINT AS frames_skipped,
       round(count(*) FILTER (NOT has_text) / count(*) * 100, 0) AS skip_pct FROM frames GROUP BY file_id""")
def prefilter_report(spark, sf_dir):
    return aggregates.prefilter_report(media.text_frames(regions(spark, sf_dir)))


@query("l2_normalize", """
SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS length_sq, round(v[1], 6) AS first_value FROM (
  SELECT vec_id, list_transform(scaled, lambda x: x / sqrt(list_sum(list_transform(scaled, lambda y: y * y)))) AS v
  FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS scaled FROM embeddings))""")
def l2_normalize(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    unit = table(spark, sf_dir, "embeddings").select("vec_id", arrays.l2_normalize(scaled).alias("v"))
    return unit.select(
        "vec_id", F.round(arrays.dot("v", "v"), 6).alias("length_sq"), F.round(F.get("v", F.lit(0)), 6).alias("first_value")
    )


@query("cosine_distance", "WITH " + CENTRES + """
SELECT vec_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], c.embedding), 6) AS distance
FROM embeddings e JOIN centres c ON c.idx = e.label""")
def cosine_distance(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "v")
    centres = label_centres(spark, sf_dir).select(F.col("idx").alias("label"), "embedding")
    joined = vectors.join(centres, "label")
    return joined.select("vec_id", F.round(arrays.cosine_distance("v", "embedding"), 6).alias("distance"))


NEAREST = "WITH " + CENTRES + """, scored AS (
  SELECT vec_id, e.label AS own, c.label, c.idx, list_cosine_similarity(e.embedding::DOUBLE[], c.embedding) AS sim
  FROM embeddings e, centres c
), voted AS (
  SELECT vec_id, own, max_by(label, sim) AS label, max(sim) AS sim FROM scored GROUP BY vec_id, own)"""


@query("zero_shot", NEAREST + "\nSELECT vec_id, label, round(sim, 6) AS similarity FROM voted")
def zero_shot(spark, sf_dir):
    frames = table(spark, sf_dir, "embeddings")
    out = similarity.zero_shot(frames, label_centres(spark, sf_dir), "vec_id")
    return out.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("zero_shot_vote", NEAREST + """, counted AS (
  SELECT own, label, count(*) AS n, min(vec_id) AS first_id, sum(count(*)) OVER (PARTITION BY own) AS total
  FROM voted GROUP BY own, label)
SELECT own::BIGINT AS file_id, min_by(label, {'n': -n, 'f': first_id}) AS "primary",
       round(max(n) / max(total), 3) AS confidence, max(total)::BIGINT AS n_frames
FROM counted GROUP BY own""")
def zero_shot_vote(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    votes = similarity.zero_shot(vectors, label_centres(spark, sf_dir), "vec_id")
    files = vectors.select("vec_id", F.col("label").cast("long").alias("file_id"))
    return aggregates.vote(files.join(votes, "vec_id"), order=["vec_id"])


@query("match_known", "WITH " + CENTRES + """
SELECT vec_id, e.label::BIGINT AS file_id,
       1 - list_cosine_similarity(e.embedding::DOUBLE[], c.embedding) < 0.8 AS is_known
FROM embeddings e JOIN centres c ON c.idx = e.label""")
def match_known(spark, sf_dir):
    det = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("file_id"), "embedding")
    known = label_centres(spark, sf_dir).select(F.col("idx").alias("file_id"), "embedding")
    return joins.match_known(det, known, 0.8).drop("embedding")


@query("match_known_all", NEAREST + """
SELECT own::BIGINT AS file_id, bool_and(1 - sim < 0.8) AS all_known, count(*) FILTER (NOT 1 - sim < 0.8)::BIGINT AS n_new
FROM voted GROUP BY own""")
def match_known_all(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    nearest = similarity.nearest_of(vectors, label_centres(spark, sf_dir), "vec_id", "idx")
    flagged = nearest.withColumn("is_known", 1 - F.col("similarity") < 0.8)
    files = vectors.select("vec_id", F.col("label").cast("long").alias("file_id"))
    return joins.all_known(files.join(flagged, "vec_id"))


@query("search", NEAREST + """, ranked AS (
  SELECT idx AS query_id, vec_id, sim, row_number() OVER (PARTITION BY idx ORDER BY sim DESC, vec_id) AS rank FROM scored)
SELECT query_id, vec_id, round(sim, 6) AS similarity, rank FROM ranked WHERE rank <= 10""")
def search(spark, sf_dir):
    queries = label_centres(spark, sf_dir).select(F.col("idx").alias("query_id"), "embedding")
    found = similarity.search(queries, table(spark, sf_dir, "embeddings"), 10)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("voice_match", NEAREST + "\nSELECT vec_id, label AS voice, round(sim, 6) AS similarity FROM voted WHERE 1 - sim < 0.8")
def voice_match(spark, sf_dir):
    voices = label_centres(spark, sf_dir)
    nearest = similarity.zero_shot(table(spark, sf_dir, "embeddings"), voices, "vec_id").filter(1 - F.col("similarity") < 0.8)
    return nearest.select("vec_id", F.col("label").alias("voice"), F.round("similarity", 6).alias("similarity"))


@query("array_picks", """
WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS ts FROM embeddings), q AS (
SELECT vec_id,
       list_transform(range(0, 7), lambda i: ts[(CASE WHEN i = 6 THEN len(ts) - 1 ELSE floor(i * ((len(ts) - 1)::DOUBLE / 6)) END)::INT + 1]) AS lin,
       list_transform(range(0, 7), lambda i: ts[floor(i * (len(ts)::DOUBLE / 7))::INT + 1]) AS stp,
       [ts[1], ts[len(ts) // 2 + 1], ts[len(ts)]] AS ends,
       list_filter(ts, lambda x, i: (i - 1) % 4 = 0) AS fourth
FROM p)
SELECT vec_id, round(list_sum(lin), 6) AS lin_sum, round(lin[4], 6) AS lin_4, round(stp[4], 6) AS stp_4,
       round(list_sum(stp), 6) AS stp_sum, round(list_sum(ends), 6) AS ends_sum, len(fourth)::INT AS n_fourth,
       round(list_sum(fourth), 6) AS fourth_sum FROM q""")
def array_picks(spark, sf_dir):
    """Evenly spaced, stepped and sliced elements of the array in each row."""
    ts = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("ts"))
    picked = ts.select(
        "vec_id", arrays.linspace_pick("ts", 7).alias("lin"), arrays.step_pick("ts", 7).alias("stp"),
        arrays.slice_pick("ts", "ends").alias("ends"), arrays.slice_pick("ts", "fourth").alias("fourth"),
    )

    def total(c):
        return F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6).alias(f"{c}_sum")

    return picked.select(
        "vec_id", total("lin"), F.round(F.get("lin", F.lit(3)), 6).alias("lin_4"),
        F.round(F.get("stp", F.lit(3)), 6).alias("stp_4"), total("stp"), total("ends"),
        F.size("fourth").alias("n_fourth"), total("fourth"),
    )


@query("limit_per_file", "WITH " + DETS + """
SELECT file_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY t, idx) AS r FROM dets) WHERE r <= 25""")
def limit_per_file(spark, sf_dir):
    return sampling.limit_per_file(detections(spark, sf_dir), 25).select("file_id", "idx")


@query("top_k", "WITH " + DETS + """
SELECT label, idx, r AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY confidence DESC, idx) AS r FROM dets) WHERE r <= 10""")
def top_k(spark, sf_dir):
    best = sampling.top_k(detections(spark, sf_dir), ["label"], [F.desc("confidence"), F.col("idx")], 10)
    return best.select("label", "idx", "rank")


ASOF = "WITH " + OBS + """, targets AS (SELECT DISTINCT file_id, t FROM obs WHERE label = 'click'
), frames AS (SELECT DISTINCT file_id, t FROM obs WHERE label = 'view'
), pairs AS (
  SELECT a.file_id, a.t, b.t AS frame_t, row_number() OVER (PARTITION BY a.file_id, a.t ORDER BY abs(a.t - b.t), b.t) AS r
  FROM targets a JOIN frames b ON a.file_id = b.file_id AND {cond})"""


def _targets(spark, sf_dir):
    det = detections(spark, sf_dir)
    return (
        det.filter("label = 'click'").select("file_id", "t").distinct(),
        det.filter("label = 'view'").select("file_id", "t").distinct(),
    )


@query("asof_nearest", ASOF.format(cond="abs(a.t - b.t) <= 0.35") + """
SELECT t.file_id, round(t.t, 6) AS t, round(p.frame_t, 6) AS frame_t
FROM targets t LEFT JOIN pairs p ON p.file_id = t.file_id AND p.t = t.t AND p.r = 1""")
def asof_nearest(spark, sf_dir):
    targets, frames = _targets(spark, sf_dir)
    out = joins.asof_nearest(targets, frames, 0.35)
    return out.withColumns({"t": F.round("t", 6), "frame_t": F.round("frame_t", 6)})


@query("asof_nearest_any", ASOF.format(cond="true") + """
SELECT t.file_id, round(t.t, 6) AS t, round(p.frame_t, 6) AS frame_t
FROM targets t LEFT JOIN pairs p ON p.file_id = t.file_id AND p.t = t.t AND p.r = 1""")
def asof_nearest_any(spark, sf_dir):
    targets, frames = _targets(spark, sf_dir)
    out = joins.asof_nearest(targets, frames, None)
    return out.withColumns({"t": F.round("t", 6), "frame_t": F.round("frame_t", 6)})


@query("subset_frames", ASOF.format(cond="abs(a.t - b.t) <= 0.35") + """
SELECT DISTINCT file_id, round(frame_t, 6) AS t FROM pairs WHERE r = 1""")
def subset_frames(spark, sf_dir):
    targets, frames = _targets(spark, sf_dir)
    return joins.subset_frames(targets, frames, 0.35).withColumn("t", F.round("t", 6))


@query("split_reusable", ASOF.format(cond="abs(a.t - b.t) <= 0.35") + """
SELECT t.file_id, round(t.t, 6) AS t, EXISTS (FROM pairs p WHERE p.file_id = t.file_id AND p.t = t.t) AS reusable FROM targets t""")
def split_reusable(spark, sf_dir):
    targets, frames = _targets(spark, sf_dir)
    return joins.split_reusable(targets, frames).withColumn("t", F.round("t", 6))


@query("in_window", "WITH " + OBS + ", " + FILES + """, windows AS (
  SELECT file_id, i AS "window", i * 30.0 AS "start", least((i + 1) * 30.0, duration) AS "end"
  FROM (SELECT *, unnest(range(0, ceil(duration / 30)::BIGINT + 1)) AS i FROM files) WHERE i * 30.0 < duration)
SELECT o.file_id, idx, "window" FROM obs o JOIN windows w ON o.file_id = w.file_id AND t >= "start" AND t < "end" """)
def in_window(spark, sf_dir):
    files = durations(spark, sf_dir)
    windows = files.select("file_id", "duration", F.explode(F.expr("sequence(0L, cast(ceil(duration / 30) as bigint))")).alias("window"))
    windows = windows.filter(F.col("window") * 30.0 < F.col("duration")).select(
        "file_id", "window", (F.col("window") * 30.0).alias("start"),
        F.least((F.col("window") + 1) * 30.0, "duration").alias("end"),
    )
    times = detections(spark, sf_dir).select("file_id", "idx", "t")
    return joins.in_window(times, windows).select("file_id", "idx", "window")


@query("new_times", "WITH " + OBS + """, a AS (SELECT DISTINCT file_id, round(t, 1) AS t FROM obs WHERE label = 'click'),
b AS (SELECT DISTINCT file_id, round(t, 1) AS t FROM obs WHERE label = 'view')
SELECT * FROM a ANTI JOIN b USING (file_id, t)""")
def new_times(spark, sf_dir):
    targets, frames = [d.withColumn("t", F.round("t", 1)).distinct() for d in _targets(spark, sf_dir)]
    return sampling.new_times(targets, frames)


@query("merge_keep_existing", "WITH " + OBS + """, a AS (
  SELECT file_id, round(t, 1) AS t, min(idx) AS idx FROM obs WHERE label = 'view' GROUP BY ALL
), b AS (SELECT file_id, round(t, 1) AS t, min(idx) AS idx FROM obs WHERE label = 'click' GROUP BY ALL)
SELECT * FROM a UNION ALL SELECT * FROM b ANTI JOIN a USING (file_id, t)""")
def merge_keep_existing(spark, sf_dir):
    det = detections(spark, sf_dir).withColumn("t", F.round("t", 1))
    a, b = [det.filter(F.col("label") == x).groupBy("file_id", "t").agg(F.min("idx").alias("idx")) for x in ("view", "click")]
    return sampling.merge_keep_existing(a, b, ["file_id", "t"])


@query("map_label", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'aerial' WHEN 'de' THEN 'interview' WHEN 'fr' THEN 'b-roll' ELSE 'unknown' END AS shot_type
FROM documents""")
def map_label(spark, sf_dir):
    names = {"en": "aerial drone footage from above", "de": "interview with person talking to camera",
             "fr": "b-roll footage of scenery or environment"}
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labelled = docs.replace(names, subset=["lang"]).withColumnRenamed("lang", "label")
    return joins.map_label(labelled).select("doc_id", "shot_type")
